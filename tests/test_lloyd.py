"""Lloyd's rounds over blocks against plain loops over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import lloyd, resample


def plain(x, at, rounds):
    for _ in range(rounds):
        own = ((x[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
        at = np.array([x[own == j].mean(axis=0) if (own == j).any() else at[j] for j in range(len(at))])
    return at


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>").repartition(3)


def test_a_round_is_a_job_and_rounds_end_when_no_row_changes(spark, monkeypatch):
    """Sums that round otherwise from round to round do not keep the rounds going, and jobs are few."""
    x = np.random.default_rng(5).normal(size=(600, 3)) / 3
    df, group = frame(spark, x), "few jobs of centroids"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = resample.centroids(df, 40, rounds=200, tol=0).orderBy("cid").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    at = np.array([r["vec"] for r in got])
    rounds = next(r for r in range(1, 200) if np.allclose(plain(x, np.array(start_of(df, 40)), r), at, atol=1e-12))
    assert rounds > 5 and np.allclose(plain(x, at, 1), at, atol=1e-12)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 30 + 2 * rounds


def start_of(df, k):
    return [r["vec"] for r in resample.centroids(df, k, rounds=0).orderBy("cid").collect()]


@pytest.mark.parametrize("rounds", [1, 2, 7])
def test_small_blocks_broadcasts_and_writes_change_nothing(spark, monkeypatch, rounds):
    monkeypatch.setattr(lloyd, "POINT_ROWS", 40)
    monkeypatch.setattr(lloyd, "BROADCAST_BYTES", 8 * 4 * 7)
    monkeypatch.setattr(lloyd, "SHARE_BYTES", 200)
    monkeypatch.setattr(lloyd, "KEEP", 2)
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(500, 4)) + 3 * rnd.integers(0, 3, (500, 1))
    start = np.concatenate([x[:29], [[99.0] * 4]])
    got = lloyd.lloyd(frame(spark, x), start, rounds, 0.0)
    assert np.allclose(got, plain(x, start, rounds), atol=1e-12) and got[29].tolist() == [99.0] * 4


def test_ties_go_to_the_first(spark):
    x = np.array([[i, j] for i in range(12) for j in range(12)], dtype=float)
    start = np.array([[i, j] for i in range(0, 12, 2) for j in range(0, 12, 2)], dtype=float)[::-1]
    assert np.allclose(lloyd.lloyd(frame(spark, x), start, 1, 0.0), plain(x, start, 1))
    own = ((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert lloyd.nearest(x, start).tolist() == own.tolist()
    assert lloyd.nearest(np.array([[np.nan, 1.0]]), start).tolist() == [0]


def test_bounds_never_hide_a_nearer_centre():
    """Rounds of one block, each centre moved or not by chance, against all distances."""
    rnd = np.random.default_rng(3)
    x, at = rnd.normal(size=(300, 5)), rnd.normal(size=(25, 5))
    none = np.full(300, -1)
    p, moved = lloyd.Points("p", x, none, none, np.zeros(300), np.zeros(300)), np.ones(25, dtype=bool)

    class Sent:
        def __init__(self, value):
            self.value = value

    for r in range(40):
        p = lloyd._assigned(p, [Sent((at[:9], moved[:9])), Sent((at[9:], moved[9:]))])
        d = np.sqrt(((x[:, None] - at[None]) ** 2).sum(axis=2))
        assert p.own.tolist() == d.argmin(axis=1).tolist()
        d[np.arange(300), p.own] = np.inf
        assert (p.second <= d.min(axis=1) + 1e-12).all()
        moved = rnd.random(25) < (0.0, 0.1, 0.5)[r % 3]
        at = at + moved[:, None] * rnd.normal(size=at.shape) * (0.02, 0.3)[r % 2]


def test_null_coordinates_stay_out_of_the_means(spark):
    rows = [(i, [float(i % 5), float(i % 7)]) for i in range(40)] + [(100, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert resample.centroids(df, 4, rounds=2).select(F.explode("vec").alias("v")).where("v is null or isnan(v)").count() == 0
