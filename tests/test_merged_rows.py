"""Trees over merged rows: the same trees from fewer rows and few jobs, and a forest like the library's."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from panelspark.operators import boost, select

COLS = ["a", "b", "c"]


def frame(spark, n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b, c = round(rng.gauss(0, 1), 1), rng.randint(0, 4), rng.randint(0, 6)
        rows.append((i, a, float(b), float(c), int(a + 0.5 * b + 0.1 * c + rng.gauss(0, 0.7) > 3)))
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int").repartition(3)


def jobs(spark, group, call):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_trees(spark):
    df = frame(spark, 2000)
    for rank in (select.boosting_importance_rank, select.forest_importance_rank):
        out, n = jobs(spark, f"few {rank.__name__}", lambda rank=rank: rank(df, COLS, "y", 60).collect())
        assert n < 40 and sum(r["importance"] for r in out) == pytest.approx(1)


@pytest.mark.parametrize("block_rows", [1 << 14, 200])
def test_merged_rows_give_the_same_trees(spark, monkeypatch, block_rows):
    df = frame(spark, 1500).withColumns({"a": F.when(F.col("row_id") % 17 > 0, F.col("a")), "_weight": F.when(F.col("y") == 1, 0.7).otherwise(1.3)})
    cuts = boost.bin_cuts(df, COLS, 8)
    monkeypatch.setattr(boost, "BLOCK_ROWS", block_rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block_rows)
    try:
        merged = boost.binned_blocks(df, COLS, "y", cuts, "_weight", merge=True)
        rows, held = boost.binned_blocks(df, COLS, "y", cuts, "_weight"), merged.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (len(held) == 1) == (block_rows > 1000)
    n = np.concatenate([np.frombuffer(r["n"]) for r in held])
    assert n.sum() == 1500 and len(n) < 700
    s = boost.Boosting(27, 2, 0.4, min_rows=5)
    a, b = boost.fit_trees(rows, 3, 8, s), boost.fit_trees(merged, 3, 8, s)
    assert len(a) == 27 and [{i: v[:2] for i, v in t.split.items()} for t in a] == [{i: v[:2] for i, v in t.split.items()} for t in b]
    assert all(x.value == pytest.approx(y.value) for x, y in zip(a, b))


@pytest.mark.parametrize("block_rows", [1 << 14, 100])
def test_forest_is_like_the_librarys(spark, monkeypatch, request, block_rows):
    monkeypatch.setattr(boost, "BLOCK_ROWS", block_rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block_rows)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    df = frame(spark, 1500)
    got = {r["feature"]: r["importance"] for r in select.forest_importance_rank(df, COLS, "y", 100).collect()}
    model = RandomForestClassifier(weightCol="weight", numTrees=100, seed=42).fit(select.weighted_matrix(df, COLS, "y"))
    assert [got[c] for c in COLS] == pytest.approx(model.featureImportances.toArray().tolist(), abs=0.04)
    again = {r["feature"]: r["importance"] for r in select.forest_importance_rank(df.repartition(5), COLS, "y", 100).collect()}
    assert again == (got if block_rows > 1500 else pytest.approx(got, abs=0.04))


def test_forest_without_a_choice_of_class(spark):
    """Where every leaf says the same class, the library prunes its trees to their roots."""
    df = spark.createDataFrame([(float(i % 9), float(i % 4), int(i % 3 == 0)) for i in range(900)], "a double, b double, y int")
    flat = df.withColumn("a", F.lit(1.0))
    model = RandomForestClassifier(weightCol="weight", numTrees=20, seed=42).fit(select.weighted_matrix(flat, ["a", "b"], "y"))
    assert model.featureImportances.toArray().tolist() == [0.0, 0.0]
    assert [r["importance"] for r in select.forest_importance_rank(flat, ["a", "b"], "y", 20).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("row", [(math.nan, 1), (None, 1), (1.0, None)])
def test_forest_takes_no_missing_value(spark, row):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)] + [row], "a double, y int")
    with pytest.raises(Exception, match="null|NaN|whole"):
        select.forest_importance_rank(df, ["a"], "y", 5).collect()


def test_cuts_by_weight(spark):
    rng = np.random.default_rng(2)
    v, y = rng.normal(size=4000), (rng.random(4000) < 0.2).astype(int)
    v = v + 2 * y
    df = spark.createDataFrame([(float(a), float(int(b)), float(i % 7), 20.0 if b else 1.0) for i, (a, b) in enumerate(zip(v, y))], "v double, y double, few double, w double")
    cuts, few = boost.weighted_cuts(df.repartition(4), ["v", "few"], "y", "w", 32)
    assert few == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(cuts) == 31
    w = np.where(y == 1, 20.0, 1.0)
    assert [w[v <= c].sum() / w.sum() for c in cuts] == pytest.approx([i / 32 for i in range(1, 32)], abs=0.01)
