"""Neighbour search through pivots against comparison of all pairs, and how many cells a query meets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import neighbors as nb

SCHEMA = "id long, vec array<double>"


def distance(a, b, nominal_from=None, penalty=0.0, gaps=False):
    total, seen = 0.0, 0
    for j, (x, y) in enumerate(zip(a, b)):
        if nominal_from is not None and j >= nominal_from:
            total += penalty * (x != y)
        elif not (math.isnan(x) or math.isnan(y)):
            total += (x - y) ** 2
            seen += 1
        elif not gaps:
            return None
    if gaps:
        return math.sqrt(total * len(a) / seen) if seen else None
    return math.sqrt(total)


def brute(queries, data, k, exclude_self=False, **kw):
    out = {}
    for i, q in queries:
        found = sorted((d, j) for j, v in data if (j != i or not exclude_self) and (d := distance(q, v, **kw)) is not None)
        out[i] = [(j, pytest.approx(d, abs=1e-9)) for d, j in found[:k]]
    return {i: v for i, v in out.items() if v}


def rows_of(found):
    out = {}
    for r in found.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["nn_id"], r["dist"]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], SCHEMA)


def clustered(seed, n, dims, clusters=20, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-5, 5, (clusters, dims))
    v = centers[rng.integers(0, clusters, n)] + rng.normal(0, spread, (n, dims))
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 8)


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_exact_with_copies_and_ties(spark, block_rows):
    rows = clustered(1, 300, 3)
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, [float(i % 3), 0.0, 0.0]) for i in range(30)]
    df = frame(spark, rows)
    assert rows_of(nb.knn_join(df, df, 4, exclude_self=True, block_rows=block_rows)) == brute(rows, rows, 4, True)
    others = clustered(2, 50, 3)
    assert rows_of(nb.knn_join(frame(spark, others), df, 3, block_rows=block_rows)) == brute(others, rows, 3)


@pytest.mark.parametrize("patterns", [2, 64])
def test_exact_with_gaps(spark, monkeypatch, patterns):
    monkeypatch.setattr(nb, "PATTERNS", patterns)
    rng = np.random.default_rng(3)
    rows = []
    for i, v in clustered(3, 400, 5):
        kind = i % 10
        gone = [] if kind < 5 else [1] if kind < 7 else [0, 3] if kind < 9 else rng.choice(5, rng.integers(1, 6), replace=False)
        rows.append((i, [math.nan if j in gone else x for j, x in enumerate(v)]))
    df = frame(spark, rows)
    assert rows_of(nb.knn_join(df, df, 3, exclude_self=True, gaps=True)) == brute(rows, rows, 3, True, gaps=True)


@pytest.mark.parametrize("nominal_from", [0, 2, 3])
def test_exact_with_codes(spark, nominal_from):
    rng = np.random.default_rng(4)
    rows = [(i, v[:nominal_from] + rng.integers(0, 3, 4 - nominal_from).astype(float).tolist()) for i, v in clustered(4, 250, 3)]
    df = frame(spark, rows)
    got = nb.knn_join(df, df, 3, exclude_self=True, nominal_from=nominal_from, penalty=0.3)
    assert rows_of(got) == brute(rows, rows, 3, True, nominal_from=nominal_from, penalty=0.3)


def test_few_and_no_rows(spark):
    df, none = frame(spark, [(1, [0.0]), (2, [1.0])]), spark.createDataFrame([], SCHEMA)
    assert nb.knn_join(df, df, 5, exclude_self=True).count() == 2
    assert nb.knn_join(df, none, 2).count() == 0 == nb.knn_join(none, df, 2).count()
    blind = frame(spark, [(1, [math.nan, math.nan]), (2, [1.0, math.nan]), (3, [2.0, 5.0])])
    assert rows_of(nb.knn_join(blind, blind, 2, exclude_self=True, gaps=True)) == {2: [(3, pytest.approx(math.sqrt(2)))], 3: [(2, pytest.approx(math.sqrt(2)))]}


@pytest.mark.parametrize("gaps, nominal_from", [(False, None), (True, None), (False, 4)])
def test_queries_meet_few_cells(spark, monkeypatch, gaps, nominal_from):
    """20,000 clustered rows in 128-row cells: about 140 of them, of which a query meets a handful, not all."""
    monkeypatch.setattr(nb, "CELL_ROWS", 128)
    rows = clustered(5, 20_000, 4, clusters=60)
    if gaps:
        rows = [(i, [math.nan if i % 4 == j else x for j, x in enumerate(v)]) for i, v in rows]
    if nominal_from:
        rows = [(i, [*v, float(i % 3)]) for i, v in rows]
    df = frame(spark, rows)
    asked = df.where("id % 40 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    _, met = nb.routed(asked, df, 4, nominal_from, 0.001, gaps)
    mean, most = met.agg(F.avg("cells"), F.max("cells")).first()
    assert met.count() == 500 and mean < (20 if gaps else 8) and most < 60


def test_imputation_fills_nan(spark):
    rows = [(i, float(i), math.nan if i == 3 else None if i == 5 else 2.0 * i, i) for i in range(10)]
    got = nb.impute_knn(spark.createDataFrame(rows, "row_id long, a double, b double, c int"), ["a", "b", "c"], k=2).orderBy("row_id").collect()
    assert [got[3]["b"], got[5]["b"]] == [pytest.approx(6), pytest.approx(10)] and isinstance(got[0]["c"], int)


def test_far_queries_are_sent_once_a_group(spark, monkeypatch):
    """Vectors without structure need nearly every cell; a query goes to a few groups of cells, not to each cell."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (1200, 16)))]
    df, seen, whole = frame(spark, rows), [], nb._grouped
    monkeypatch.setattr(nb, "_grouped", lambda far, *a: seen.append(far) or whole(far, *a))
    assert rows_of(nb.knn_join(df, df, 3, exclude_self=True, block_rows=64)) == brute(rows, rows, 3, True)
    cells, groups = seen[0].agg(F.avg("cells"), F.max(F.size("groups"))).first()
    assert cells > 4 * nb.GROUPS and groups <= 2 * nb.GROUPS, (cells, groups)


def test_groups_hold_a_bounded_number_of_rows():
    index = nb.Index(np.zeros((2, 1)), np.zeros((6, 1)), np.array([0, 1, 0, 1, 0, 1]), np.array([3, 0, 4, 25, 2, 5]))
    share, group = index.groups(10)
    assert sorted(set(share.tolist())) == [0, 2, 3, 4, 5] and group.tolist() == sorted(group.tolist())
    assert share.tolist().count(3) == 3 and len(set(group[share == 3].tolist())) == 3
    held = {g: sum(-(-int(index.sizes[c]) // share.tolist().count(c)) for c in share[group == g]) for g in set(group.tolist())}
    assert max(held.values()) <= 10


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_rounding_of_matrix_products_loses_no_neighbour(offset):
    """Far from zero the products keep few digits of a distance; the exact one decides."""
    rng = np.random.default_rng(7)
    q, d = (offset + rng.integers(0, 4, (n, 3)).astype(float) for n in (40, 90))
    found = nb.Nearest(np.full(40, np.inf), 5)
    for lo in range(0, 90, 32):
        found.meet(np.arange(40), q, d[lo : lo + 32], np.arange(lo, min(lo + 32, 90)))
    dist = np.sqrt(((q[:, None] - d[None]) ** 2).sum(axis=2))
    assert found.ids.reshape(40, 5).tolist() == np.argsort(dist, axis=1, kind="stable")[:, :5].tolist()
    assert nb.nearest_of(q, d).tolist() == dist.argmin(axis=1).tolist()
