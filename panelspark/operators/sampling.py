"""Reproducible splits, folds and draws.

Random order is the md5 of the row id, so a split is a cut-off on that hash: finding the cut-off
reads two narrow columns, and applying it shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.hashing import hash_bucket, hash_long, order_hash
from panelspark.operators.joins import attach_one_row, lookup_join
from panelspark.operators.ranks import dense_row_rank, row_positions

DRAWS_PER_TASK = 1_000_000


def hash_cuts(df: DataFrame, row_id: str, group: list[str], take: Column, seed: int | str = 42) -> DataFrame:
    """(group..., _n, _take, _cut): the hash of the ``take``-th row of each group in hash order.

    ``take`` is an expression over ``_n``, the group's row count. ``_cut`` is null when take is 0.
    """
    h = df.select(*group, F.col(row_id), order_hash(F.col(row_id), seed=seed).alias("_h"))
    h = h.withColumn("_hb", hash_bucket(F.col("_h")))
    hist = h.groupBy(*group, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    # the histogram has at most 65,536 rows per group
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_n", F.sum("_c").over(whole)).withColumn("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    hist = hist.withColumn("_take", take.cast("long"))
    edge = hist.where((F.col("_b") < F.col("_take")) & (F.col("_take") <= F.col("_b") + F.col("_c")))
    edge = edge.select(*group, "_hb", (F.col("_take") - F.col("_b")).alias("_at"))
    inside = lookup_join(h, edge, [*group, "_hb"], "inner")
    nth = Window.partitionBy(*group, "_hb").orderBy("_h", row_id)
    cut = inside.withColumn("_rn", F.row_number().over(nth)).where(F.col("_rn") == F.col("_at"))
    sizes = hist.groupBy(*group).agg(F.max("_n").alias("_n"), F.max("_take").alias("_take"))
    if not group:
        return sizes.join(F.broadcast(cut.select(F.col("_h").alias("_cut"))), how="left")
    return sizes.join(cut.select(*group, F.col("_h").alias("_cut")), group, "left")


def mark_sample(
    df: DataFrame, row_id: str, group: list[str], take: Column, out: str = "picked", seed: int | str = 42
) -> DataFrame:
    """Add a boolean: is the row among the first ``take`` of its group in hash order."""
    cuts = hash_cuts(df, row_id, group, take, seed).select(*group, "_cut")
    joined = lookup_join(df, cuts, group) if group else attach_one_row(df, cuts)
    h = order_hash(F.col(row_id), seed=seed)
    return joined.withColumn(out, F.coalesce(h <= F.col("_cut"), F.lit(False))).drop("_cut")


def stratified_split(df: DataFrame, label: str, row_id: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``role`` (train or test): round(test * n) rows of each class are test rows; rows without a label go."""
    out = mark_sample(labelled(df, label), row_id, [label], F.round(F.lit(test) * F.col("_n")), "_t", seed)
    return out.withColumn("role", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def random_split_plain(df: DataFrame, row_id: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    out = mark_sample(df, row_id, [], F.round(F.lit(test) * F.col("_n")), "_t", seed)
    return out.withColumn("role", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def sample_fraction(df: DataFrame, row_id: str, frac: float = 0.3, seed: int = 42) -> DataFrame:
    return mark_sample(df, row_id, [], F.round(F.lit(frac) * F.col("_n")), "_t", seed).where("_t").drop("_t")


def downsample_majority(
    df: DataFrame, label: str, row_id: str, majority: object = 0, frac: float = 0.3, seed: int = 42
) -> DataFrame:
    """All rows of other classes and round(frac * n) rows of the majority class."""
    take = F.when(F.col(label) == majority, F.round(F.lit(frac) * F.col("_n"))).otherwise(F.col("_n"))
    return mark_sample(df, row_id, [label], take, "_t", seed).where("_t").drop("_t")


def stratified_kfold(df: DataFrame, label: str, row_id: str, k: int = 10) -> DataFrame:
    """Add ``fold``: the fold in which the row is a test row; rows stay in order, nothing is shuffled.

    Classes are laid end to end by first appearance; fold i gets as many rows of a class as the
    class has positions congruent to i modulo k, and takes them as one run in row order. Rows without a label go.
    """
    df = labelled(df, label)
    classes = df.groupBy(label).agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per class
    seq = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    bounds = classes.withColumn("_off", F.coalesce(F.sum("_n").over(seq), F.lit(0)))
    fold = F.col("_fold")
    size = F.floor((F.col("_off") + F.col("_n") - 1 - fold) / k) - F.floor((F.col("_off") - 1 - fold) / k)
    bounds = bounds.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_size", size)
    upto = Window.partitionBy(label).orderBy("_fold").rowsBetween(Window.unboundedPreceding, -1)
    starts = bounds.select(label, F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("pos"))
    pos = row_positions(df.select(label, row_id), row_id, [label])
    # the first row of each fold: k rows per class
    cuts = lookup_join(pos, starts, [label, "pos"], "inner").groupBy(label).agg(F.collect_list(row_id).alias("_cuts"))
    out = lookup_join(df, cuts, label)
    return out.withColumn(
        "fold", F.size(F.filter("_cuts", lambda c: c <= F.col(row_id))) - 1
    ).drop("_cuts")


def nested_holdout_kfold(
    df: DataFrame, label: str, row_id: str, k: int = 10, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Stratified hold-out, then folds inside train and inside test: adds ``role`` and ``fold``."""
    split = stratified_split(df, label, row_id, test, seed)
    train = stratified_kfold(split.where(F.col("role") == "train"), label, row_id, k)
    held = stratified_kfold(split.where(F.col("role") == "test"), label, row_id, k)
    return train.unionByName(held)


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is known; a missing one is no class of its own."""
    return df.where(F.col(label).isNotNull())


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, largest first; one row per class comes to the driver."""
    rows = labelled(df, label).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).collect()
    return {r[label]: r["n"] for r in rows}


def draw_rows(
    df: DataFrame, label: str, row_id: str, draws: dict, seed: int | str = 42, per_task: int = DRAWS_PER_TASK
) -> DataFrame:
    """Rows drawn with replacement: ``draws[c]`` of class c, with draw number ``draw``.

    Draw j of class c takes the row at position md5(c, j, seed) mod n_c in hash order. A row of a small class
    may be drawn very often; it is then repeated so that at most about ``per_task`` draws meet one copy.
    """
    spark = df.sparkSession
    kind = df.schema[label].dataType
    sizes = class_counts(df, label)
    parts, copies = [], F.lit(1)
    for c, n in draws.items():
        if n <= 0 or not sizes.get(c):
            continue
        spread = -(-n // (sizes[c] * per_task))
        ids = spark.range(n).select(F.lit(c).cast(kind).alias(label), F.col("id").alias("draw"))
        h = hash_long(order_hash(F.col(label), F.col("draw"), seed=seed))
        parts.append(
            ids.withColumns({"rank": F.pmod(h, F.lit(sizes[c])) + 1, "_copy": F.pmod("draw", F.lit(spread).cast("long"))})
        )
        if spread > 1:
            copies = F.when(F.col(label) == F.lit(c), F.lit(spread)).otherwise(copies)
    if not parts:
        return df.withColumn("draw", F.lit(0).cast("long")).where(F.lit(False))
    want = parts[0]
    for p in parts[1:]:
        want = want.unionByName(p)
    ranked = dense_row_rank(df.select(row_id, label), order_hash(F.col(row_id), seed=seed), row_id, [label])
    pool = df.join(ranked.select(row_id, "rank"), row_id).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))
    )
    return want.join(pool, [label, "rank", "_copy"]).select(*df.columns, "draw")


def class_balanced_bootstrap(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """floor(n / classes) draws with replacement from each class."""
    counts = class_counts(df, label)
    each = sum(counts.values()) // max(1, len(counts))
    return draw_rows(df, label, row_id, dict.fromkeys(counts, each), seed)


def random_batch(df: DataFrame, row_id: str, m: int, seed: int = 42) -> DataFrame:
    """m uniform draws with replacement."""
    one = df.withColumn("_all", F.lit("all"))
    return draw_rows(one, "_all", row_id, {"all": m}, seed).drop("_all")
