"""Feature selectors and their vote. Every selector returns (feature, selector, picked, score)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import correlation
from panelspark.operators import boost
from panelspark.operators.encode import ordinal_first_seen
from panelspark.operators.evaluate import balanced_class_weights
from panelspark.operators.joins import lookup_join
from panelspark.operators.stats import cells
from panelspark.session import materialize

TOP_K = 500
TREES = 500
FOREST_BINS = 32
RFE_STEP = 10
RATIO = 1.25
VOTES_NEEDED = 5
# Column names of the vote table.
SELECTORS = ("Pearson", "Chi-2", "Logistic", "Random Forest", "Recursive", "LightGBM")


def _unpivot_row(one: DataFrame, cols: list[str], prefix: str = "") -> DataFrame:
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"{prefix}{c}").alias("score")) for c in cols]
    return one.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def _top(scores: DataFrame, selector: str, k: int) -> DataFrame:
    """Mark the k best; the score table has one row per feature."""
    best = scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k).select("feature", F.lit(True).alias("_p"))
    out = scores.join(F.broadcast(best), "feature", "left")
    return out.select("feature", F.lit(selector).alias("selector"), F.coalesce("_p", F.lit(False)).alias("picked"), "score")


def correlation_scores(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """|Pearson(x, y)| per feature; a constant column scores 0."""
    one = df.agg(*[correlation(F.col(c), F.col(label)).alias(c) for c in cols])
    s = F.abs(F.col("score"))
    return _unpivot_row(one, cols).select(
        "feature", F.when(s.isNull() | F.isnan(s), F.lit(0.0)).otherwise(s).alias("score")
    )


def select_correlation(df: DataFrame, cols: list[str], label: str, k: int = TOP_K) -> DataFrame:
    return _top(correlation_scores(df, cols, label), "Pearson", k)


def anova_scores(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way F per feature over any number of classes, from per-class n, mean and variance."""
    per = cells(df, cols, [label]).groupBy("column", label).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    whole = per.groupBy("column").agg(
        F.sum(n).alias("tn"), F.sum(n * m).alias("tm"), F.sum(n * v).alias("within"), F.count(F.lit(1)).alias("k")
    )
    tot = whole.select("column", (F.col("tm") / F.col("tn")).alias("grand"))
    between = per.join(tot, "column").groupBy("column").agg(
        F.sum(n * (m - F.col("grand")) * (m - F.col("grand"))).alias("between")
    )
    f = F.try_divide(F.col("between") * (F.col("tn") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return whole.join(between, "column").select(F.col("column").alias("feature"), f.alias("score"))


def select_anova_f(df: DataFrame, cols: list[str], label: str, k: int = TOP_K) -> DataFrame:
    return _top(anova_scores(df, cols, label), "Chi-2", k)


def assemble(df: DataFrame, cols: list[str], label: str, weights: DataFrame | None = None) -> DataFrame:
    """(features, label, weight); weights default to balanced class weights."""
    w = weights if weights is not None else balanced_class_weights(df, label)
    tagged = lookup_join(df.select(label, *cols), w, label, "inner")
    return VectorAssembler(inputCols=cols, outputCol="features").transform(tagged).select(
        "features", F.col(label).cast("double").alias("label"), "weight"
    )


def _above_median(df: DataFrame, cols: list[str], scores: list[float], selector: str) -> DataFrame:
    """Mark features whose score reaches RATIO times the median score."""
    ordered = sorted(scores)
    h = len(ordered) // 2
    med = ordered[h] if len(ordered) % 2 else (ordered[h - 1] + ordered[h]) / 2
    rows = [(c, selector, bool(s >= RATIO * med), float(s)) for c, s in zip(cols, scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, selector string, picked boolean, score double")


def _logistic(n: int) -> LogisticRegression:
    return LogisticRegression(
        weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=100
    )


def select_logistic(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    data = assemble(df, cols, label).persist()
    try:
        model = _logistic(data.count()).fit(data)
    finally:
        data.unpersist()
    return _above_median(df, cols, [abs(x) for x in model.coefficients.toArray()], "Logistic")


def select_rfe(df: DataFrame, cols: list[str], label: str, keep: int = TOP_K, step: int = RFE_STEP) -> DataFrame:
    """Refit and drop the weakest ``step`` features until ``keep`` are left; score is the round survived."""
    data = assemble(df, cols, label).persist()
    left, survived, rounds = list(range(len(cols))), {}, 0
    try:
        n = data.count()
        while len(left) > keep:
            part = VectorSlicer(inputCol="features", outputCol="_f", indices=left).transform(data)
            model = _logistic(n).setFeaturesCol("_f").fit(part)
            weak = sorted(range(len(left)), key=lambda i: (abs(model.coefficients[i]), i))
            rounds += 1
            for i in sorted(weak[: min(step, len(left) - keep)], reverse=True):
                survived[left.pop(i)] = rounds
    finally:
        data.unpersist()
    rows = [(c, "Recursive", i in left, float(survived.get(i, rounds + 1))) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, selector string, picked boolean, score double")


def _fit_importances(model, data: DataFrame) -> list[float]:
    return [float(x) for x in model.fit(data).featureImportances.toArray()]


def select_forest(df: DataFrame, cols: list[str], label: str, trees: int = TREES, depth: int = 5) -> DataFrame:
    model = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=42)
    return _above_median(df, cols, _fit_importances(model, assemble(df, cols, label)), "Random Forest")


def boosted(df: DataFrame, cols: list[str], label: str, settings: boost.Boosting, weight: str | None = None) -> list[boost.Tree]:
    """Trees over the bins of ``cols``; see ``boost`` for what a pass costs."""
    cuts = boost.bin_cuts(df, cols)
    return boost.fit_trees(boost.binned_blocks(df, cols, label, cuts, weight, merge=True), len(cols), max(map(len, cuts)) + 1, settings)


def select_boosting(df: DataFrame, cols: list[str], label: str, trees: int = TREES, depth: int = 5) -> DataFrame:
    """Split counts of boosting with balanced classes and a rate of 0.0001."""
    weighted = lookup_join(df.select(label, *cols), balanced_class_weights(df, label).withColumnRenamed("weight", "_weight"), label, "inner")
    settings = boost.Boosting(trees, depth, 1e-4, min_rows=20, min_curvature=1e-3)
    found = boosted(weighted, cols, label, settings, "_weight")
    return _above_median(df, cols, boost.tree_importance(found, len(cols), "splits"), "LightGBM")


def vote_features(votes: list[DataFrame] | DataFrame, needed: int = VOTES_NEEDED) -> DataFrame:
    """One row per feature: a 0/1 column per selector, the total and whether it is chosen."""
    table = votes if isinstance(votes, DataFrame) else reduce(DataFrame.unionByName, votes)
    out = table.groupBy("feature").agg(
        *[F.max(F.when(F.col("selector") == s, F.col("picked").cast("int"))).alias(s) for s in SELECTORS],
        F.sum(F.col("picked").cast("int")).alias("total"),
    )
    out = out.withColumns({s: F.coalesce(F.col(s), F.lit(0)) for s in SELECTORS})
    return out.withColumn("chosen", F.col("total") >= needed).orderBy(F.desc("total"), F.desc("feature"))


def _ranked(df: DataFrame, cols: list[str], scores: list[float]) -> DataFrame:
    """Importances in falling order with 1-based position."""
    order = sorted(zip(cols, scores), key=lambda x: (-x[1], x[0]))
    rows = [(i, c, float(s)) for i, (c, s) in enumerate(order, start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, importance double")


def weighted_matrix(df: DataFrame, cols: list[str], label: str, positive: float = 20.0) -> DataFrame:
    """(features, label, weight) with positives weighted 20 : 1."""
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).select(
        "features",
        F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, positive).otherwise(1.0).alias("weight"),
    )


def forest_importance_rank(df: DataFrame, cols: list[str], label: str, trees: int = TREES) -> DataFrame:
    """Gini gains times the weight of their node, as a share of their tree, averaged over the trees; see ``boost.Forest``.

    Like the library's forest it takes whole labels from 0 on and no missing value.
    """
    y = F.col("label")
    whole = F.when(y.isNotNull() & (y >= 0) & (y == F.floor(y)) & (y < 256), y).otherwise(F.raise_error(F.lit("labels must be whole numbers from 0 on")))
    rows = weighted_matrix(df, cols, label).select(vector_to_array("features").alias("x"), whole.alias("label"), "weight")
    rows = rows.select(*[F.col("x")[i].alias(f"_{i}") for i in range(len(cols))], "label", "weight")
    names = rows.columns[: len(cols)]
    top = rows.agg(F.max("label")).first()[0]
    if top is None:
        raise ValueError("a forest needs rows")
    cuts = boost.weighted_cuts(rows, names, "label", "weight", FOREST_BINS)
    blocks = boost.binned_blocks(rows, names, "label", cuts, "weight", merge=True, classes=True)
    found = boost.fit_forest(blocks, len(cols), max(map(len, cuts)) + 1, boost.Forest(trees, int(top) + 1))
    return _ranked(df, cols, boost.tree_importance(found, len(cols), "share"))


def boosting_importance_rank(
    df: DataFrame, cols: list[str], label: str, trees: int = TREES, rate: float = 0.5, depth: int = 3
) -> DataFrame:
    """Unweighted gradient boosting; gains as a share of their tree, averaged over the trees."""
    found = boosted(df, cols, label, boost.Boosting(trees, depth, rate, newton=False))
    return _ranked(df, cols, boost.tree_importance(found, len(cols), "share"))


def importance_report(
    df: DataFrame, continuous: list[str], codes: list[str], label: str, row_id: str, trees: int = TREES
) -> DataFrame:
    """(kind, model, position, feature, importance): forest and boosting on continuous, then on code columns.

    Codes are mode-filled and numbered by first appearance.
    """
    coded = df
    for c in codes:
        coded = ordinal_first_seen(coded, c, row_id).drop(c).withColumnRenamed(f"{c}_code", c)
    jobs = []
    for kind, cols, rows in (("continuous", continuous, df), ("code", codes, materialize(coded, "codes"))):
        for name, rank in (("forest", forest_importance_rank), ("boosting", boosting_importance_rank)):
            jobs.append((kind, name, partial(rank, rows, cols, label, trees)))
    # the models know nothing of each other, and each of them is a row of small jobs
    with ThreadPoolExecutor(len(jobs)) as pool:
        ranks = list(pool.map(lambda job: job[2](), jobs))
    outs = [out.select(F.lit(kind).alias("kind"), F.lit(name).alias("model"), "*") for (kind, name, _), out in zip(jobs, ranks)]
    return reduce(DataFrame.unionByName, outs)


def xgb_importance_rank(df: DataFrame, cols: list[str], label: str, trees: int = 100, rate: float = 1.2, depth: int = 6) -> DataFrame:
    """Boosting by Newton steps with an L2 penalty of 1; mean gain of a column's splits, scaled to a sum of 1."""
    found = boosted(df, cols, label, boost.Boosting(trees, depth, rate, l2=1.0, min_curvature=1.0))
    return _ranked(df, cols, boost.tree_importance(found, len(cols), "mean"))


def adaboost_rounds(df: DataFrame, cols: list[str], label: str, rounds: int = 500, rate: float = 1.0, bins: int = boost.BINS) -> DataFrame:
    """(round, feature, bound, below, above, error, stage): the stumps in order; ``below`` is the class up to the bound."""
    cuts, found = _stumps(df, cols, label, rounds, rate, bins)
    rows = [(i, cols[s.feature], cuts[s.feature][s.cut], s.left, s.right, s.error, s.stage) for i, s in enumerate(found, start=1)]
    return df.sparkSession.createDataFrame(rows, "round int, feature string, bound double, below int, above int, error double, stage double")


def adaboost_importance_rank(
    df: DataFrame, cols: list[str], label: str, rounds: int = 500, rate: float = 1.0, bins: int = boost.BINS
) -> DataFrame:
    """Boosted stumps: misclassified rows gain weight each round; a column's importance is its share of the stage weights."""
    _, found = _stumps(df, cols, label, rounds, rate, bins)
    return _ranked(df, cols, boost.stump_importance(found, len(cols)))


def _stumps(df: DataFrame, cols: list[str], label: str, rounds: int, rate: float, bins: int) -> tuple[list[list[float]], list[boost.Stump]]:
    cuts = boost.bin_cuts(df, cols, bins)
    return cuts, boost.fit_stumps(boost.binned_blocks(df, cols, label, cuts), len(cols), max(map(len, cuts)) + 1, rounds, rate)
