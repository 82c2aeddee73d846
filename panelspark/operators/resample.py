"""Class rebalancing.

Frames hold (id long, vec array<double>, label). Over-samplers lift every smaller class to the largest
class; synthetic rows have a null id and ``synthetic`` = true. Under-samplers cut every larger class
towards the smallest one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.hashing import hash_bucket, hash_long, hash_unit, order_hash
from panelspark.operators import lloyd
from panelspark.operators.joins import BROADCAST_BYTES
from panelspark.operators.neighbors import knn_join, routed
from panelspark.operators.ranks import dense_row_rank, prefix_sums
from panelspark.operators.sampling import class_counts, draw_rows, labelled, mark_sample
from panelspark.session import materialize

K_NEIGHBORS = 5
M_NEIGHBORS = 10
#: rounds of K-means, and the move below which they end
ROUNDS = 30
TOLERANCE = 1e-4
#: bytes of centroids that go to every task
CENTER_BYTES = BROADCAST_BYTES
#: broadcasts of that size which the rounds of K-means take at most, one at a time
LLOYD_CHUNKS = 16
_REPEAT_STEP = 65_536


def _shortfall(counts: dict) -> dict:
    top = max(counts.values(), default=0)
    return {c: top - n for c, n in counts.items()}


def _original(df: DataFrame) -> DataFrame:
    return labelled(df, "label").select("id", "vec", "label").withColumn("synthetic", F.lit(False))


def _class_neighbors(df: DataFrame, c: object, k: int, **kw) -> DataFrame:
    mine = df.where(F.col("label") == F.lit(c))
    return knn_join(mine, mine, k, exclude_self=True, **kw)


def _foreign_share(df: DataFrame, c: object, m: int, **kw) -> DataFrame:
    """(id, n_other, n_seen): neighbours of another class among the m nearest rows of the whole frame."""
    df = labelled(df, "label")
    mine = df.where(F.col("label") == F.lit(c))
    nn = knn_join(mine, df, m, exclude_self=True, **kw)
    tags = df.select(F.col("id").alias("nn_id"), F.col("label").alias("_l"))
    return nn.join(tags, "nn_id").groupBy("id").agg(
        F.count_if(F.col("_l") != F.lit(c)).alias("n_other"), F.count(F.lit(1)).alias("n_seen")
    )


def _seed_table(df: DataFrame, seeds: DataFrame, nn: DataFrame, nominal_from: int | None = None) -> DataFrame:
    """(id, step, vec, far, codes): each seed with the vectors of its at most k neighbours in rank order.

    Everything a synthetic row needs sits on its seed, so rows drawn from a seed need no further join.
    """
    vecs = df.select("id", "vec")
    far = (
        nn.join(vecs.select(F.col("id").alias("nn_id"), F.col("vec").alias("_v")), "nn_id")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_v"))).alias("_s"))
        .select("id", F.transform("_s", lambda s: s["_v"]).alias("far"))
    )
    out = seeds.join(far, "id").join(vecs, "id")
    if nominal_from is None:
        return out
    votes = (
        far.select("id", F.explode("far").alias("_v"))
        .select("id", F.posexplode(F.slice("_v", F.lit(nominal_from + 1), F.greatest(F.size("_v") - nominal_from, F.lit(0)))).alias("at", "v"))
        .groupBy("id", "at", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("id", "at")
        .agg(F.min(F.struct(-F.col("cnt"), F.col("v"))).getField("v").alias("v"))
        .groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("codes"))
    )
    return out.join(votes, "id")


def _interpolate(draws: DataFrame, c: object, kind, seed: int, nominal_from: int | None = None) -> DataFrame:
    """One synthetic row per drawn seed: vec + step * lambda * (neighbour - vec)."""
    h = lambda tag: order_hash(F.col("id"), F.col("draw"), F.lit(tag), seed=seed)
    pick = F.pmod(hash_long(h("nn")), F.size("far")).cast("int")
    work = draws.withColumns({"_far": F.get("far", pick), "_lam": hash_unit(h("lambda")) * F.col("step")})
    new = F.zip_with("vec", "_far", lambda a, b: a + F.col("_lam") * (b - a))
    if nominal_from is not None:
        new = F.concat(F.slice(new, 1, nominal_from), F.col("codes"))
    return work.select(
        F.lit(None).cast("long").alias("id"), new.alias("vec"), F.lit(c).cast(kind).alias("label"), F.lit(True).alias("synthetic")
    )


def _smote(df, c, need: int, seeds: DataFrame, nn: DataFrame, seed: int, nominal_from: int | None = None) -> DataFrame:
    """``need`` synthetic rows of class c from (id, step) seeds drawn with replacement."""
    # written once: counting, ranking and drawing below would repeat the neighbour search
    table = materialize(_seed_table(df, seeds, nn, nominal_from).withColumn("_all", F.lit("all")), "seeds")
    draws = draw_rows(table, "_all", "id", {"all": need}, seed)
    return _interpolate(draws, c, df.schema["label"].dataType, seed, nominal_from)


def over_random(df: DataFrame, seed: int = 42) -> DataFrame:
    """Original rows plus duplicates of smaller classes drawn at random."""
    extra = draw_rows(df.select("id", "vec", "label"), "label", "id", _shortfall(class_counts(df, "label")), seed)
    return _original(df).unionByName(extra.drop("draw").withColumn("synthetic", F.lit(True)))


def over_smote_borderline(df: DataFrame, seed: int = 42, k: int = K_NEIGHBORS, m: int = M_NEIGHBORS, **kw) -> DataFrame:
    """Synthetic rows start only from rows whose m neighbours are at least half, but not all, foreign."""
    out = _original(df)
    for c, need in _shortfall(class_counts(df, "label")).items():
        if not need:
            continue
        danger = _foreign_share(df, c, m, **kw).where(
            (F.col("n_other") >= F.col("n_seen") / 2) & (F.col("n_other") < F.col("n_seen"))
        )
        seeds = danger.select("id", F.lit(1.0).alias("step"))
        out = out.unionByName(_smote(df, c, need, seeds, _class_neighbors(df, c, k, **kw), seed))
    return out


def over_smote_svm(df: DataFrame, seed: int = 42, k: int = K_NEIGHBORS, m: int = M_NEIGHBORS, **kw) -> DataFrame:
    """Seeds are rows inside the margin of a linear classifier and not surrounded by foreign rows.

    Seeds with mostly foreign neighbours interpolate; the others step half way outwards.
    """
    out = _original(df)
    for c, need in _shortfall(class_counts(df, "label")).items():
        if not need:
            continue
        train = df.select("id", array_to_vector("vec").alias("_x"), (F.col("label") == F.lit(c)).cast("double").alias("_y"))
        margin = vector_to_array(F.col("rawPrediction")).getItem(1)
        scored = LinearSVC(featuresCol="_x", labelCol="_y", maxIter=50).fit(train).transform(train.where("_y = 1"))
        near = scored.where(F.abs(margin) <= 1).select("id")
        share = _foreign_share(df, c, m, **kw).where(F.col("n_other") < F.col("n_seen")).join(near, "id")
        step = F.when(F.col("n_other") >= F.col("n_seen") / 2, 1.0).otherwise(-0.5)
        seeds = share.select("id", step.alias("step"))
        out = out.unionByName(_smote(df, c, need, seeds, _class_neighbors(df, c, k, **kw), seed))
    return out


def over_smote_nc(df: DataFrame, nominal_from: int, seed: int = 42, k: int = K_NEIGHBORS, **kw) -> DataFrame:
    """Coordinates from ``nominal_from`` on are codes: they take the neighbours' most frequent value.

    A differing code adds half the squared median of the numeric standard deviations to the distance.
    """
    out = _original(df)
    for c, need in _shortfall(class_counts(df, "label")).items():
        if not need:
            continue
        mine = df.where(F.col("label") == F.lit(c))
        spreads = mine.agg(*[F.stddev_pop(F.col("vec")[i]).alias(str(i)) for i in range(nominal_from)]).first()
        ordered = sorted(s or 0.0 for s in spreads)
        half = len(ordered) // 2
        med = ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2
        nn = _class_neighbors(df, c, k, nominal_from=nominal_from, penalty=med * med / 2, **kw)
        seeds = mine.select("id", F.lit(1.0).alias("step"))
        out = out.unionByName(_smote(df, c, need, seeds, nn, seed, nominal_from))
    return out


def repeat_rows(df: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times with ``draw`` 0..n-1; two steps keep the generated arrays short.

    The pieces of rows that repeat very often are dealt over all tasks before the second step.
    """
    last = F.floor((F.col(n) - 1) / _REPEAT_STEP)
    often = df.where(F.col(n) > _REPEAT_STEP).withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = often.repartition(tasks, F.xxhash64(*[F.col(c) for c in df.columns], "_hi"))
    wide = df.where((F.col(n) > 0) & (F.col(n) <= _REPEAT_STEP)).withColumn("_hi", F.lit(0).cast("long")).unionByName(often)
    upto = F.least(F.lit(_REPEAT_STEP).cast("long"), F.col(n) - F.col("_hi") * _REPEAT_STEP) - 1
    return wide.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), upto.cast("long")))).withColumn(
        "draw", F.col("_hi") * _REPEAT_STEP + F.col("_lo")
    ).drop("_hi", "_lo")


def adasyn_counts(df: DataFrame, c: object, need: int, k: int = K_NEIGHBORS, **kw) -> DataFrame:
    """(id, n): synthetic rows per seed, proportional to its share of foreign neighbours, half to even."""
    share = materialize(_foreign_share(df, c, k, **kw).withColumn("r", F.col("n_other") / F.lit(k)), "density")
    total = share.agg(F.sum("r").alias("_sum"))
    return share.crossJoin(F.broadcast(total)).where(F.col("_sum") > 0).select(
        "id", F.bround(F.col("r") / F.col("_sum") * F.lit(need), 0).cast("long").alias("n")
    )


def over_adasyn(df: DataFrame, seed: int = 42, k: int = K_NEIGHBORS, **kw) -> DataFrame:
    out = _original(df)
    for c, need in _shortfall(class_counts(df, "label")).items():
        if not need:
            continue
        seeds = adasyn_counts(df, c, need, k, **kw).withColumn("step", F.lit(1.0))
        table = _seed_table(df, seeds, _class_neighbors(df, c, k, **kw))
        out = out.unionByName(_interpolate(repeat_rows(table, "n"), c, df.schema["label"].dataType, seed))
    return out


def under_random(df: DataFrame, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, first rows in hash order."""
    df = labelled(df, "label")
    low = min(class_counts(df, "label").values(), default=0)
    return mark_sample(df, "id", ["label"], F.least(F.col("_n"), F.lit(low)), "_t", seed).where("_t").drop("_t")


def tomek_links(df: DataFrame, **kw) -> DataFrame:
    """(id, nn_id): mutual nearest neighbours of different classes, both directions."""
    nn = materialize(knn_join(df, df, 1, exclude_self=True, **kw).select("id", "nn_id"), "nearest")
    back = nn.select(F.col("nn_id").alias("id"), F.col("id").alias("nn_id"))
    mutual = nn.join(back, ["id", "nn_id"])
    tags = df.select("id", F.col("label").alias("_a"))
    other = df.select(F.col("id").alias("nn_id"), F.col("label").alias("_b"))
    return mutual.join(tags, "id").join(other, "nn_id").where("_a <> _b").select("id", "nn_id")


def under_tomek(df: DataFrame, **kw) -> DataFrame:
    """Drop the members of Tomek links that do not belong to the smallest class."""
    df = labelled(df, "label")
    counts = class_counts(df, "label")
    if not counts:
        return df
    minority = min(counts, key=lambda c: (counts[c], str(c)))
    doomed = tomek_links(df, **kw).select("id")
    return df.join(doomed.withColumn("_link", F.lit(True)), "id", "left").where(
        F.col("_link").isNull() | (F.col("label") == F.lit(minority))
    ).drop("_link")


def nearest_center(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """``rows`` (id, vec) with ``center``, the cid of the nearest of ``centers`` (cid, vec); ties go to the smallest.

    Centres whose bytes, counted first, are within the broadcast bound go to the tasks; more of them meet the rows
    through the neighbour join, where a row meets only the cells that can hold its nearest one.
    """
    k, dims = centers.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if 8 * (k or 0) * (dims or 0) > CENTER_BYTES:
        near, _ = routed(rows.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), centers.select(F.col("cid").alias("id"), "vec"), 1)
        return rows.join(near.select("id", F.col("nn_id").alias("center")), "id")
    known = sorted((r["cid"], r["vec"]) for r in centers.collect())
    names, at = np.array([c for c, _ in known]), np.array([v for _, v in known], dtype=float).reshape(len(known), -1)

    @F.pandas_udf("long")
    def own(v: pd.Series) -> pd.Series:
        return pd.Series(names[lloyd.nearest(np.stack(v.to_numpy()).astype(float), at)])

    return rows.withColumn("center", own("vec"))


def center_means(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(cid, n, mean) of the rows nearest to each of ``centers``; a centre without rows is left out."""
    dims = centers.agg(F.max(F.size("vec"))).first()[0] or 0
    owned = nearest_center(rows, centers)
    mean = F.array(*[F.avg(F.col("vec")[i]) for i in range(dims)])
    return owned.groupBy(F.col("center").alias("cid")).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"))


def centroids(df: DataFrame, k: int, seed: int = 42, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """(cid, vec): ``k`` K-means centroids of the rows (id, vec) of ``df``, at any k.

    Lloyd's rounds: every row finds its nearest centroid, which then moves to the mean of its rows. Centroids of up to
    ``LLOYD_CHUNKS`` broadcasts meet blocks of rows, see ``lloyd``; more of them are a table, and means grouped sums. They start
    from ``k`` distinct vectors in hash order and end after ``rounds``, or when none moves by more than ``tol``. With fewer
    distinct vectors than ``k`` each is a centroid of its own, and they repeat.
    """
    rows = df.select("id", "vec")
    ones = rows.groupBy("vec").agg(F.min("id").alias("id"))
    ranked = materialize(dense_row_rank(ones, order_hash(F.col("id"), seed=seed), "id", []).select(F.col("rank").alias("cid"), "vec"), "starts")
    distinct = ranked.count()
    if distinct <= k:
        times = F.lit(k // max(distinct, 1)) + (F.col("cid") <= k % max(distinct, 1)).cast("int")
        again = repeat_rows(ranked.withColumn("n", times.cast("long")), "n")
        return again.select((F.col("cid") + F.col("draw") * distinct).alias("cid"), "vec")
    centers = materialize(ranked.where(F.col("cid") <= k), "centers")
    dims, gaps = ranked.agg(F.max(F.size("vec")), F.max(F.exists("vec", F.isnull))).first()
    # means leave null coordinates out, which blocks of numbers do not tell from NaN
    if rounds and not gaps and 0 < 8 * k * (dims or 0) <= LLOYD_CHUNKS * CENTER_BYTES:
        start = np.array([r["vec"] for r in centers.orderBy("cid").collect()], dtype=float).reshape(k, dims)
        return lloyd.table(df.sparkSession, lloyd.lloyd(rows, start, rounds, tol))
    for _ in range(rounds):
        moved = centers.join(center_means(rows, centers).drop("n"), "cid", "left").withColumn("mean", F.coalesce("mean", "vec"))
        step = F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        moved = materialize(moved.select("cid", F.col("mean").alias("vec"), step.alias("step")), "centers")
        centers = moved.select("cid", "vec")
        if (moved.agg(F.max("step")).first()[0] or 0.0) <= tol * tol:
            break
    return centers


def under_centroids(df: DataFrame, seed: int = 42, clusters: int | None = None, **kw) -> DataFrame:
    """Replace each larger class by as many K-means centroids as the smallest class has rows, by one scheme at every size.

    More ``clusters`` than the largest class has rows are an error; an empty table stays empty.
    """
    counts = class_counts(df, "label")
    low = clusters or min(counts.values(), default=0)
    if counts and low > max(counts.values()):
        raise ValueError(f"{low} centroids per class; the largest class has {max(counts.values())} rows")
    out = _original(df.where(F.lit(False)))
    for c, n in counts.items():
        mine = df.where(F.col("label") == F.lit(c))
        if n <= low:
            out = out.unionByName(_original(mine))
            continue
        kind = df.schema["label"].dataType
        out = out.unionByName(centroids(mine, low, seed, **kw).select(
            F.lit(None).cast("long").alias("id"), "vec", F.lit(c).cast(kind).alias("label"), F.lit(True).alias("synthetic")
        ))
    return out


def under_one_sided(df: DataFrame, seed: int = 42, **kw) -> DataFrame:
    """Keep the smallest class, one seed row per other class and the rows 1-NN gets wrong; then Tomek removal."""
    df = labelled(df, "label")
    counts = class_counts(df, "label")
    if not counts:
        return df
    minority = min(counts, key=lambda c: (counts[c], str(c)))
    small = df.where(F.col("label") == F.lit(minority))
    kept = small
    for c in counts:
        if c == minority:
            continue
        mine = mark_sample(df.where(F.col("label") == F.lit(c)), "id", [], F.lit(1), "_seed", seed)
        core = small.unionByName(mine.where("_seed").drop("_seed"))
        rest = mine.where("not _seed").drop("_seed")
        nn = knn_join(rest, core, 1, **kw).select("id", "nn_id")
        wrong = nn.join(small.select(F.col("id").alias("nn_id")), "nn_id", "left_semi").select("id")
        kept = kept.unionByName(mine.where("_seed").drop("_seed")).unionByName(rest.join(wrong, "id", "left_semi"))
    # written once: the index of the removal reads these rows many times
    return under_tomek(materialize(kept.select(*df.columns), "kept"), **kw)


OVER = {
    "ros": over_random,
    "border_smote": over_smote_borderline,
    "svmsmote": over_smote_svm,
    "cate_smote": over_smote_nc,
    "adasyn": over_adasyn,
}
UNDER = {"rus": under_random, "tomek": under_tomek, "centroid": under_centroids, "one_sided": under_one_sided}


def rebalance(df: DataFrame, types: str, over: str | None = None, under: str | None = None, **kw) -> DataFrame:
    """``over``, ``under``, ``both`` (over, then under on the result) or ``None``; new rows get fresh ids."""
    if types == "None":
        return df
    df = out = labelled(df, "label")
    if types in ("over", "both"):
        grown = OVER[over](out, **kw)
        # original ids are kept; synthetic rows follow them without gaps, in hash order of their content
        top = df.agg(F.max("id")).first()[0] or 0
        dup = grown.where("synthetic").groupBy("vec", "label").agg(F.count(F.lit(1)).alias("n"))
        dup = dup.withColumn("_h", order_hash(F.to_json("vec"), F.col("label")))
        dup = prefix_sums(dup.withColumn("_hb", hash_bucket(F.col("_h"))), F.col("_h"), {"n": F.col("n")}, [], "_hb")
        fresh = F.col("before_n") + F.col("draw") + F.lit(top + 1)
        made = repeat_rows(materialize(dup, "synthetic"), "n").select(fresh.alias("id"), "vec", "label")
        out = grown.where("not synthetic").select("id", "vec", "label").unionByName(made)
    if types in ("under", "both"):
        out = UNDER[under](out)
    return out
