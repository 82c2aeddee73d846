"""Boosting over blocks against plain loops over rows."""

import math
import random

import numpy as np
import pytest

from panelspark.operators import boost, select

COLS = ["a", "b", "c"]


def frame(spark, seed, n, missing=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.randint(0, 4), rng.random()
        y = int(a + 0.5 * b + rng.gauss(0, 0.7) > 1.2)
        rows.append((i, None if missing and i % 17 == 0 else a, float(b), math.nan if missing and i % 23 == 0 else c, None if missing and i % 41 == 0 else y))
    return rows, spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int").repartition(3)


def binned(rows, cuts):
    kept = [r for r in rows if r[4] is not None]
    x = [[len(c) if v is None or math.isnan(v) else sum(k < v for k in c) for v in (r[j + 1] for r in kept)] for j, c in enumerate(cuts)]
    return np.array(x), np.array([r[4] for r in kept])


def test_stumps_against_rows(spark):
    rows, df = frame(spark, 1, 400)
    cuts = boost.bin_cuts(df, COLS, 16)
    got = boost.fit_stumps(boost.binned_blocks(df, COLS, "y", cuts), 3, 16, 60)
    x, y = binned(rows, cuts)
    w = np.ones(len(y)) / len(y)
    assert len(got) == 60 > boost.KEEP
    for s in got:
        best = max(
            (sum((sum(w[m & (y == k)]) ** 2 for k in (0, 1))) / sum(w[m]) + sum((sum(w[~m & (y == k)]) ** 2 for k in (0, 1))) / sum(w[~m]))
            for j in range(3) for c in range(len(cuts[j])) if 0 < (m := x[j] <= c).sum() < len(y)
        )
        m = x[s.feature] <= s.cut
        own = sum(sum(w[m & (y == k)]) ** 2 for k in (0, 1)) / sum(w[m]) + sum(sum(w[~m & (y == k)]) ** 2 for k in (0, 1)) / sum(w[~m])
        assert own == pytest.approx(best, abs=1e-9)
        wrong = np.where(m, s.left, s.right) != y
        assert s.error == pytest.approx(w[wrong].sum(), abs=1e-9) and s.stage == pytest.approx(math.log((1 - s.error) / s.error))
        w = w * np.exp(s.stage * wrong)
        w /= w.sum()


@pytest.mark.parametrize("newton, l2", [(True, 1.0), (False, 0.0)])
def test_trees_against_rows(spark, newton, l2):
    rows, df = frame(spark, 2, 300)
    cuts = boost.bin_cuts(df, COLS, 8)
    s = boost.Boosting(30, 3, 0.4, l2=l2, newton=newton, min_rows=5)
    got = boost.fit_trees(boost.binned_blocks(df, COLS, "y", cuts), 3, 8, s)
    x, y = binned(rows, cuts)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))

    def grow(node, at, g, h, depth, tree):
        def score(m):
            under = (h[m].sum() if newton else m.sum()) + l2
            return g[m].sum() ** 2 / under

        best = max(
            ((score(at & (x[j] <= c)) + score(at & (x[j] > c)) - score(at), j, c) for j in range(3) for c in range(len(cuts[j]))
             if min((at & (x[j] <= c)).sum(), (at & (x[j] > c)).sum()) >= s.min_rows),
            default=(0, 0, 0), key=lambda v: v[0],
        )
        if depth == s.depth or best[0] <= 1e-9:
            value = 0.0 if node == 1 else -s.rate * g[at].sum() / (h[at].sum() + l2)
            assert tree.value[node] == pytest.approx(value, abs=1e-9)
            margin[at] += tree.value[node]
            return
        j, c, gain = tree.split[node]
        assert gain == pytest.approx(best[0], rel=1e-6)
        m = x[j] <= c
        assert score(at & m) + score(at & ~m) - score(at) == pytest.approx(gain, rel=1e-6)
        grow(2 * node, at & m, g, h, depth + 1, tree)
        grow(2 * node + 1, at & ~m, g, h, depth + 1, tree)

    assert len(got) == s.trees > boost.KEEP
    for tree in got:
        p = 1 / (1 + np.exp(-margin))
        grow(1, np.ones(len(y), bool), p - y, p * (1 - p), 0, tree)


def test_importances_add_up_and_find_the_signal(spark):
    _, df = frame(spark, 3, 500)
    for rank in (
        select.boosting_importance_rank(df, COLS, "y", trees=20), select.xgb_importance_rank(df, COLS, "y", trees=20),
        select.adaboost_importance_rank(df, COLS, "y", rounds=20),
    ):
        got = rank.collect()
        assert [r["position"] for r in got] == [1, 2, 3] and sum(r["importance"] for r in got) == pytest.approx(1)
        assert got[0]["feature"] == "a"
        assert [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)


def test_small_blocks_and_weights_change_nothing(spark, monkeypatch):
    rows, df = frame(spark, 4, 300, missing=False)
    cuts = boost.bin_cuts(df, COLS, 8)
    whole = boost.fit_stumps(boost.binned_blocks(df, COLS, "y", cuts), 3, 8, 10)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        cut = boost.fit_stumps(boost.binned_blocks(df, COLS, "y", cuts), 3, 8, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(s.feature, s.cut) for s in cut] == [(s.feature, s.cut) for s in whole]
    # a row of weight two counts like two rows
    from pyspark.sql import functions as F

    twice = df.unionByName(df.where("row_id % 3 = 0"))
    weighted = df.withColumn("_weight", F.when(F.col("row_id") % 3 == 0, 2).otherwise(1))
    a = boost.fit_trees(boost.binned_blocks(twice, COLS, "y", cuts), 3, 8, boost.Boosting(5, 2, 0.3))
    b = boost.fit_trees(boost.binned_blocks(weighted, COLS, "y", cuts, "_weight"), 3, 8, boost.Boosting(5, 2, 0.3))
    assert [{i: s[:2] for i, s in t.split.items()} for t in a] == [{i: s[:2] for i, s in t.split.items()} for t in b]


@pytest.mark.parametrize("rows", [[], [(0, 1.0, 1.0, 1.0, 1)], [(i, 1.0, None, math.nan, i % 2) for i in range(6)], [(i, float(i), 0.0, 0.0, None) for i in range(4)]])
def test_tables_without_a_split(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int")
    for rank in (select.boosting_importance_rank, select.xgb_importance_rank, select.adaboost_importance_rank):
        got = rank(df, COLS, "y", 3).collect()
        assert [r["feature"] for r in got] == COLS and all(r["importance"] == 0 for r in got)
    assert select.select_boosting(df, COLS, "y", 3).count() == 3


def test_blocks_are_dealt_evenly_over_the_cores(spark, monkeypatch):
    """A table of one task must not make every pass one task."""
    monkeypatch.setattr(boost, "BLOCK_ROWS", 10)
    rows = [(i, float(i % 7), i % 2) for i in range(320)]
    df = spark.createDataFrame(rows, "row_id long, a double, y int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        blocks = boost.binned_blocks(df, ["a"], "y", boost.bin_cuts(df, ["a"], 8))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = boost._blocks(blocks, 1).glom().map(len).collect()
    assert sum(held) == 32 and max(held) - min(held) <= 1 and len(held) == spark.sparkContext.defaultParallelism


def test_shares_of_columns_send_only_their_splits(monkeypatch):
    """Splits of shares lead to the split of the whole histogram, and their size has nothing to do with the bins."""
    rng = np.random.default_rng(5)
    hist = np.abs(rng.normal(1, 0.3, (6, 2, 64, 4))) + [9, 9, 0, 1]
    hist[4] = hist[1]
    s = boost.Boosting(1, 1, 0.1)
    whole = boost.best_splits([boost.near_best_splits(0, hist, s)])
    shares = [boost.near_best_splits(lo, hist[lo : lo + 2], s) for lo in (0, 2, 4)]
    assert boost.best_splits(shares) == whole and sum(len(n) for p in shares for n in p) < 20
    flat = hist[:, 0, :, :2]
    assert boost.best_stump([boost.stump_split(lo, flat[lo : lo + 3]) for lo in (0, 3)], 1.0) == boost.best_stump([boost.stump_split(0, flat)], 1.0)


def test_a_worker_replays_only_new_trees():
    done = []
    block = boost.Block("b", np.zeros((1, 3), np.uint8), np.zeros(3), np.ones(3), np.zeros(3))
    replay = lambda b, m, trees: done.append(len(trees)) or m + sum(trees)
    for n in (1, 4, 4, 2):
        assert boost._replayed("run", block, list(range(n)), replay).tolist() == [sum(range(n))] * 3
    assert done == [1, 3, 0, 2]
