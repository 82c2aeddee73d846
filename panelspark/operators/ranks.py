"""Exact global order without a single-task window.

Values are cut into order-preserving buckets, bucket totals give offsets, and the running
count inside each bucket gives the rest. Equal values collapse to one counted row before any
ordering, so a value that holds a third of the table costs one row.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.hashing import hash_bucket
from panelspark.operators.joins import hot_keys
from panelspark.session import materialize

MAX_BUCKETS = 4096
#: size of a quantile sketch, the factor of its rank error, and the distinct values that one task orders
SKETCH = 1024
SKETCH_ERROR = 3.5
#: quantiles read off a sketch, evenly spaced
SKETCH_MARKS = 512
SLICE_ROWS = 1_000_000
HOT_GROUP_ROWS = 1_000_000


def bucket_count(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKETS, n))


def add_buckets(df: DataFrame, cols: list[str], n: int | None = None, suffix: str = "__b") -> DataFrame:
    """Add ``<c>__b``, a bucket number that never decreases as ``c`` grows.

    Bounds are approximate quantiles: they steer balance only, never a result.
    """
    n = n or bucket_count(df)
    doubles = [F.col(c).cast("double").alias(c) for c in cols]
    probs = [i / n for i in range(1, n)]
    bounds = df.select(*doubles).approxQuantile(cols, probs, min(1.0 / n, 0.005))
    out = df
    for c, found in zip(cols, bounds):
        cuts = sorted({b for b in found if math.isfinite(b)})
        if not cuts:
            out = out.withColumn(c + suffix, F.lit(0.0))
            continue
        tmp = c + "__d"
        # adding zero turns -0.0 into 0.0, which the bucket search would tell apart
        out = out.withColumn(tmp, F.col(c).cast("double") + F.lit(0.0))
        out = Bucketizer(
            splits=[-math.inf, *cuts, math.inf], inputCol=tmp, outputCol=c + suffix, handleInvalid="keep"
        ).transform(out)
        out = out.drop(tmp)
    return out


def prefix_sums(
    df: DataFrame, order: list[Column] | Column, weights: dict[str, Column], group: list[str], bucket: str
) -> DataFrame:
    """Add ``before_<w>`` (sum of ``w`` over strictly earlier rows) and ``total_<w>`` per group.

    ``order`` must be unique inside a group and ``bucket`` must not decrease along it.
    """
    order = order if isinstance(order, list) else [order]
    work = df.withColumns({f"_w_{k}": c for k, c in weights.items()})
    totals = work.groupBy(*group, bucket).agg(*[F.sum(f"_w_{k}").alias(f"_t_{k}") for k in weights])
    # at most one row per (group, bucket): the number of buckets is bounded
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"_t_{k}").over(upto), F.lit(0)).alias(f"_o_{k}") for k in weights],
        *[F.sum(f"_t_{k}").over(whole).alias(f"total_{k}") for k in weights],
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = work.withColumns(
        {f"_b_{k}": F.coalesce(F.sum(f"_w_{k}").over(inside), F.lit(0)) for k in weights}
    )
    out = local.join(offsets, [*group, bucket])
    out = out.withColumns({f"before_{k}": F.col(f"_o_{k}") + F.col(f"_b_{k}") for k in weights})
    return out.drop(*[p + k for k in weights for p in ("_w_", "_b_", "_o_")])


def long_values(df: DataFrame, cols: list[str], keep: list[str] = (), n: int | None = None) -> DataFrame:
    """(keep..., column, value, bucket), one row per non-missing cell of ``cols``."""
    b = add_buckets(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]), cols, n)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.col(c + "__b").alias("bucket")) for c in cols
    ]
    return (
        b.select(*keep, F.explode(F.array(*cells)).alias("_c"))
        .select(*keep, "_c.column", "_c.value", "_c.bucket")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def column_ranks(
    df: DataFrame, cols: list[str], group: list[str] = (), split: dict[str, Column] | None = None, n: int | None = None
) -> DataFrame:
    """One row per (group, column, distinct value): cnt, before, total and avg_rank.

    ``split`` adds conditional counts, for example the rows of one class at each value.
    """
    group, split = list(group), split or {}
    extra = df.withColumns({f"_s_{k}": c.cast("long") for k, c in split.items()})
    cells = long_values(extra, list(cols), [*group, *[f"_s_{k}" for k in split]], n)
    counts = cells.groupBy(*group, "column", "bucket", "value").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(f"_s_{k}").alias(k) for k in split]
    )
    out = prefix_sums(counts, F.col("value"), {"cnt": F.col("cnt")}, [*group, "column"], "bucket")
    return out.select(
        *group,
        "column",
        "bucket",
        "value",
        "cnt",
        *split,
        F.col("before_cnt").alias("before"),
        F.col("total_cnt").alias("total"),
        (F.col("before_cnt") + (F.col("cnt") + 1) / 2).alias("avg_rank"),
    )


def row_ranks(
    df: DataFrame, cols: list[str], group: list[str], n: int | None = None, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """(group..., ``{c}__rank`` per column): average ranks at row level, null for a missing value.

    Groups of ordinary size are shuffled once and ranked by windows; groups above ``hot_rows`` rows go
    through the bucketed order, so that no task holds a whole one.
    """
    group = list(group)
    work = df.select(*group, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    hot = hot_keys(df.select(*group), group, hot_rows)
    if hot is None:
        return _window_ranks(work, cols, group)
    marks = F.broadcast(hot.select(*group))
    cold = _window_ranks(work.join(marks, group, "left_anti"), cols, group)
    return cold.unionByName(_bucket_ranks(work.join(marks, group, "left_semi"), cols, group, n))


def window_rank(c: Column, group: list[str]) -> Column:
    """Average rank = (rank + rows up to and including the peers) / 2; both frames only grow. Missing values stand last."""
    w = Window.partitionBy(*group).orderBy(c.asc_nulls_last())
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(c.isNotNull(), (F.rank().over(w) + F.count(c).over(upto)) / 2)


def _window_ranks(work: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    out = work.repartition(*group)
    for c in cols:
        out = out.withColumn(f"{c}__rank", window_rank(F.col(c), group))
    return out.select(*group, *[f"{c}__rank" for c in cols])


def _bucket_ranks(work: DataFrame, cols: list[str], group: list[str], n: int | None) -> DataFrame:
    """One counted rank table and one join per column.

    A value that many rows share is a skewed join key; adaptive execution splits that partition.
    """
    out = add_buckets(work, cols, n)
    for c in cols:
        b = c + "__b"
        counts = out.where(F.col(c).isNotNull()).groupBy(*group, b, c).agg(F.count(F.lit(1)).alias("cnt"))
        ranked = prefix_sums(counts, F.col(c), {"cnt": F.col("cnt")}, group, b)
        ranked = ranked.select(*group, b, c, (F.col("before_cnt") + (F.col("cnt") + 1) / 2).alias(f"{c}__rank"))
        out = out.join(ranked, [*group, b, c], "left")
    return out.select(*group, *[f"{c}__rank" for c in cols])


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: dict[str, float], group: list[str] = (), n: int = SKETCH, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(group..., column, one column per name in ``probs``): linear-interpolated exact quantiles.

    One scan makes a mergeable sketch of size ``n`` per group and column; it gives bounds around each wanted position. A
    second scan counts the values below and between the bounds, where only the few between are shuffled and ordered. Bounds
    that miss their position are widened, and a slice of more than ``slice_rows`` distinct values is sketched and narrowed
    again, so a task's share does not grow with the table. ``group`` must have few values, such as a class label.
    """
    group, size = list(group), max(8, n)
    by = [*group, "column"]
    parts = [F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") + F.lit(0.0)).alias("value")) for c in cols]
    cells = df.select(*group, F.explode(F.array(*parts)).alias("_c")).select(*group, "_c.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    names = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    marks = F.array(*[F.lit(i / SKETCH_MARKS) for i in range(SKETCH_MARKS + 1)])
    sketch = [F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("value", F.lit(size)), marks).alias("_s"), F.count(F.lit(1)).alias("_m")]
    whole = cells.groupBy(*by).agg(*sketch).withColumn("_q", F.explode(names))
    pos = F.col("_q.p") * (F.col("_m") - 1)
    ends = [F.floor(pos).cast("long").alias("_lo"), F.ceil(pos).cast("long").alias("_hi")]
    nothing = [F.lit(None).cast("double").alias("_a"), F.lit(None).cast("double").alias("_z"), F.lit(0).cast("long").alias("_below")]
    # groups x columns x quantiles rows
    whole = materialize(whole.select(*by, "_q.name", pos.alias("_pos"), *ends, *nothing, "_s", "_m"), "sketches")
    slack, found, held = SKETCH_ERROR / size**0.9, whole, None
    while True:
        at = [(F.col("_lo") - F.col("_below")) / F.col("_m") - slack, (F.col("_hi") + 1 - F.col("_below")) / F.col("_m") + slack]
        at = [F.floor(at[0] * SKETCH_MARKS).cast("int"), F.ceil(at[1] * SKETCH_MARKS).cast("int")]
        low = F.when(at[0] > 0, F.get("_s", at[0])).otherwise(F.col("_a"))
        high = F.when(at[1] < SKETCH_MARKS, F.get("_s", at[1])).otherwise(F.col("_z"))
        wanted = materialize(found.select(*by, "name", "_pos", "_lo", "_hi", low.alias("_a"), high.alias("_z")), "bounds")
        met = cells.join(F.broadcast(wanted), by).where(F.col("_z").isNull() | (F.col("value") <= F.col("_z")))
        inside = F.col("_a").isNull() | (F.col("value") >= F.col("_a"))
        # one row for all that is below the slice, one per value in it
        counts = met.groupBy(*by, "name", F.when(inside, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("_c"))
        counts = materialize(counts, "slices")
        shape = counts.groupBy(*by, "name").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_c"))), F.lit(0)).alias("_below"), F.sum("_c").alias("_upto"), F.count("value").alias("_rows")
        )
        shape = materialize(wanted.join(shape, [*by, "name"]), "shape")
        missed = (F.col("_lo") < F.col("_below")) | (F.col("_hi") >= F.col("_upto"))
        worst = shape.agg(F.max(missed.cast("int")), F.max("_rows")).first()
        if worst[0]:
            slack, found = 4 * slack, whole
        elif (worst[1] or 0) > slice_rows and (held is None or worst[1] < held):
            held = worst[1]
            keep = (F.col("_a").isNull() | (F.col("value") >= F.col("_a"))) & (F.col("_z").isNull() | (F.col("value") <= F.col("_z")))
            again = cells.join(F.broadcast(shape), by).where(keep).groupBy(*by, "name").agg(*sketch)
            found = materialize(shape.join(again, [*by, "name"]), "sketches")
        else:
            break
    order = Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_u", F.sum("_c").over(order)).where("value is not null").join(F.broadcast(wanted.drop("_a", "_z")), [*by, "name"])
    first = F.min(F.when(F.col("_u") > F.col("_lo"), F.col("value"))).alias("_first")
    last = F.min(F.when(F.col("_u") > F.col("_hi"), F.col("value"))).alias("_last")
    q = placed.groupBy(*by, "name", "_pos").agg(first, last)
    value = F.col("_first") + (F.col("_last") - F.col("_first")) * (F.col("_pos") - F.floor("_pos"))
    # equal ends stay as they are, infinite ones too
    value = F.when(F.col("_first") == F.col("_last"), F.col("_first")).otherwise(value)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, value)).alias(k) for k in probs])


def dense_row_rank(df: DataFrame, order_hash: Column, row_id: str, group: list[str]) -> DataFrame:
    """Add ``rank`` (1-based, in hash order) and ``group_n`` for rows of each group."""
    h = df.withColumn("_h", order_hash).withColumn("_hb", hash_bucket(F.col("_h")))
    out = prefix_sums(h, [F.col("_h"), F.col(row_id)], {"one": F.lit(1).cast("long")}, list(group), "_hb")
    return (
        out.withColumn("rank", F.col("before_one") + 1)
        .withColumnRenamed("total_one", "group_n")
        .drop("_h", "_hb", "before_one")
    )


def row_positions(df: DataFrame, row_id: str, group: list[str], n: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based, in ``row_id`` order) and ``group_n`` for rows of each group; ids are of any type that has an order.

    Ids that are no numbers are bucketed by the ranges that a sample of them gives, and written, as another run may find others.
    """
    if isinstance(df.schema[row_id].dataType, T.NumericType):
        b = add_buckets(df, [row_id], n)
    else:
        ranged = df.repartitionByRange(n or bucket_count(df), row_id)
        b = materialize(ranged.withColumn(row_id + "__b", F.spark_partition_id()), "ranges")
    out = prefix_sums(b, F.col(row_id), {"one": F.lit(1).cast("long")}, list(group), row_id + "__b")
    return (
        out.withColumnRenamed("before_one", "pos").withColumnRenamed("total_one", "group_n").drop(row_id + "__b")
    )
