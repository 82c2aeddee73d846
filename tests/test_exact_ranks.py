"""Quantiles, row order, rank correlation and tail probabilities against plain computation."""

import math
import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import special
from panelspark.operators import encode, ranks, sampling, stats

PROBS = {"lo": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "hi": 1.0}


@pytest.mark.parametrize("n, slice_rows", [(1024, 10**6), (8, 50), (200, 40)])
def test_quantiles_at_every_sketch_size(spark, n, slice_rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25), [math.inf, -math.inf]])
    rows = [(int(i % 3), float(v), None if i % 4 else float(round(v, 1)) if math.isfinite(v) else math.nan) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(5)
    got = {(r["g"], r["column"]): r for r in ranks.exact_quantiles(df, ["x", "y"], PROBS, ["g"], n=n, slice_rows=slice_rows).collect()}
    for g in range(3):
        for j, c in enumerate(("x", "y"), start=1):
            v = np.sort([r[j] for r in rows if r[0] == g and r[j] is not None and not math.isnan(r[j])])
            for k, p in PROBS.items():
                at = p * (len(v) - 1)
                a, b = v[math.floor(at)], v[math.ceil(at)]
                want = a if a == b else a + (b - a) * (at - math.floor(at))
                assert got[g, c][k] == pytest.approx(want, abs=1e-12), (g, c, k)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, math.nan)] * 3, "x double, y double")
    assert ranks.exact_quantiles(df, ["x", "y"], PROBS).collect() == []
    assert ranks.exact_quantiles(df.where("false"), ["x"], PROBS).collect() == []


def ids(kind):
    rng = random.Random(2)
    made = {
        "string": [f"{rng.randint(0, 99)}-{i}" for i in range(200)],
        "decimal(20,2)": [Decimal(10**17 + i * 3) / 100 for i in range(200)],
        "date": [date(2020, 1, 1) + timedelta(days=i) for i in range(200)],
    }[kind]
    return rng.sample(made, len(made))


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "date"])
def test_order_of_ids_of_any_type(spark, kind):
    rows = [(v, i % 3, "abcde"[i % 5] if i % 11 else None) for i, v in enumerate(ids(kind))]
    df = spark.createDataFrame(rows, f"id {kind}, y int, code string").repartition(4)
    order = sorted(rows)
    got = {r["id"]: r["pos"] for r in ranks.row_positions(df, "id", [], 5).collect()}
    assert got == {r[0]: i for i, r in enumerate(order)}
    first = list(dict.fromkeys(r[2] for r in order if r[2] is not None))
    codes = {r["id"]: r["code_code"] for r in encode.factorize(df, "code", "id").collect()}
    assert codes == {r[0]: first.index(r[2]) if r[2] is not None else -1 for r in rows}
    folds = {r["id"]: r["fold"] for r in sampling.stratified_kfold(df, "y", "id", 4).collect()}
    for y in range(3):
        mine = [folds[r[0]] for r in order if r[1] == y]
        assert mine == sorted(mine) and max(mine.count(f) for f in range(4)) - min(mine.count(f) for f in range(4)) <= 1
    nested = sampling.nested_holdout_kfold(df, "y", "id", 3).collect()
    assert len(nested) == 200 and {r["fold"] for r in nested} == {0, 1, 2}


def test_kendall_of_all_pairs_at_once(spark):
    rng = random.Random(3)
    rows = [(i % 2, rng.randint(0, 6), rng.random() if i % 9 else None, float(rng.randint(0, 30)) if i % 7 else math.nan, rng.gauss(0, 1)) for i in range(160)]
    df = spark.createDataFrame(rows, "f int, a int, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    got = {(r["column"], r["column2"], r["f"]): r for r in stats.test_kendall(df, cols, "f").collect()}
    assert len(got) == 12
    for (x, y, f), r in got.items():
        i, j = cols.index(x) + 1, cols.index(y) + 1
        v = [(p[i], p[j]) for p in rows if p[0] == f and None not in (p[i], p[j]) and not any(math.isnan(z) for z in (p[i], p[j]))]
        n, s = len(v), 0
        for k in range(n):
            for m in range(k):
                s += ((v[k][0] > v[m][0]) - (v[k][0] < v[m][0])) * ((v[k][1] > v[m][1]) - (v[k][1] < v[m][1]))
        ties = [[sum(1 for z in v if z[q] == u) for u in {z[q] for z in v}] for q in (0, 1)]
        pairs, (tx, ty) = n * (n - 1) / 2, [sum(t * (t - 1) / 2 for t in g) for g in ties]
        v1 = [sum(t * (t - 1) * (2 * t + 5) for t in g) for g in ties]
        v0 = [sum(t * (t - 1) * (t - 2) for t in g) for g in ties]
        var = (n * (n - 1) * (2 * n + 5) - sum(v1)) / 18 + 2 * tx * ty / (n * (n - 1)) + v0[0] * v0[1] / (9 * n * (n - 1) * (n - 2))
        assert r["con"] - r["dis"] == s and r["statistic"] == pytest.approx(s / math.sqrt((pairs - tx) * (pairs - ty)))
        assert r["z"] == pytest.approx(s / math.sqrt(var)) and r["p_value"] == pytest.approx(math.erfc(abs(s) / math.sqrt(2 * var)), abs=1e-12)


def test_kendall_counts_from_one_written_table(spark, tmp_path):
    """Sizes, bounds and cells read the input; the counting of ten pairs reads the cells alone."""
    path = str(tmp_path / "input")
    spark.range(300).select((F.col("id") % 2).alias("f"), *[(F.col("id") * k % 17).cast("double").alias(f"c{k}") for k in range(3, 8)]).write.parquet(path)
    out = stats.test_kendall(spark.read.parquet(path), [f"c{k}" for k in range(3, 8)], "f")
    assert out.count() == 20 and not [f for f in out.inputFiles() if path in f]


@pytest.mark.parametrize("dof", [1, 2, 3, 10, 99, 1e4, 2.1e4, 1e6, 1e9, 1e12, 1e15])
def test_t_tail_from_one_to_1e15_degrees(dof):
    """Against Simpson's rule over the density, which needs no special function but the gamma ratio."""
    scale = special._log_gamma_ratio(dof / 2, 0.5) + 0.5 * math.log(dof / 2) - 0.5 * math.log(dof * math.pi) if dof > 300 else (
        math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi))
    density = lambda t: math.exp(scale - (dof + 1) / 2 * math.log1p(t * t / dof))
    for t in (1e-6, 0.3, 2.0, 4.0):
        n = 4000
        h = t / n
        inside = h / 3 * (density(0) + density(t) + sum((4 if i % 2 else 2) * density(i * h) for i in range(1, n)))
        assert special.t_two_sided(t, dof) == pytest.approx(1 - 2 * inside, abs=1e-9)


def test_known_tails():
    assert special.t_two_sided(2.0, 1e15) == pytest.approx(0.045500263896358, abs=1e-12)
    assert special.t_two_sided(2.0, 1) == pytest.approx(1 - 2 * math.atan(2) / math.pi, abs=1e-12)
    assert special.f_sf(3.0, 4, 1e12) == pytest.approx(special.chi2_sf(12.0, 4), rel=1e-9)
    assert special.f_sf(2.5, 2, 30) == pytest.approx((1 + 5 / 30) ** -15, rel=1e-12)
    assert special.f_sf(1.0, 2e5, 2e5) == pytest.approx(0.5, abs=1e-9)


def test_expansion_meets_the_fraction(monkeypatch):
    for a in (1e4, 1e5):
        for b in (0.5, 1.0, 3.0, 9.0):
            for far in (0.1, 1.0, 4.0):
                y = far * b / a
                wide = special._beta_large(a, b, -math.log1p(-y))
                monkeypatch.setattr(special, "LARGE", 1e99)
                assert special.beta_inc(a, b, 1 - y, y) == pytest.approx(wide, rel=1e-8, abs=1e-12)
                monkeypatch.undo()
