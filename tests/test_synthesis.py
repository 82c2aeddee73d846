"""Missing numbers, transforms and folded aggregates of feature synthesis; imputers kept and used again."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from panelspark.operators import impute, rolling, synth
from panelspark.roles import Roles

NAN = float("nan")


def test_nan_is_missing_in_every_aggregate(spark):
    rows = [("a", 1.0, 2.0, 7.0), ("a", NAN, 3.0, 7.0), ("a", 4.0, NAN, NAN), ("a", 6.0, 1.0, None), ("b", NAN, 1.0, NAN), ("b", None, 2.0, NAN)]
    df = spark.createDataFrame(rows, "k string, x double, y double, c double")
    feats = [synth.Feature(f, ("x",)) for f in ("min", "max", "mean", "sum", "std", "range", "num_unique", "mode")]
    feats += [synth.Feature("pearson", ("x", "y")), synth.Feature("spearman", ("x", "y")), synth.Feature("num_unique", ("c",)), synth.Feature("mode", ("c",))]
    got = {r["k"]: r.asDict() for r in synth.compute_features(df, "k", feats).collect()}
    assert [got["a"][f"{f}__x"] for f in ("min", "max", "sum", "range", "num_unique", "mode")] == [1.0, 6.0, 11.0, 5.0, 3, 1.0]
    assert got["a"]["mean__x"] == pytest.approx(11 / 3) and got["a"]["pearson__x__y"] == pytest.approx(-1) == got["a"]["spearman__x__y"]
    assert (got["a"]["num_unique__c"], got["a"]["mode__c"]) == (1, 7.0)
    assert all(got["b"][f"{f}__x"] is None for f in ("min", "max", "mean", "sum", "std", "range", "mode")) and got["b"]["num_unique__x"] == 0
    direct = synth.aggregate_by_key(df, "k", ["max", "sum"], ["x"]).where("k = 'a'").first()
    assert (direct["max__x"], direct["sum__x"]) == (6.0, 11.0)


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_nan_is_missing_in_windows(spark, hot_rows):
    rows = [(i, "u", f"2024-01-0{i + 1} 00:00:00", v) for i, v in enumerate([1.0, NAN, 2.0, NAN, NAN])] + [(9, "w", "2024-01-01 00:00:00", NAN)]
    df = spark.createDataFrame(rows, "row_id int, u string, t string, x double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    specs = [rolling.Spec("u", "x", f, 2) for f in ("sum", "mean", "min", "max", "cnt")]
    got = {r["row_id"]: r for r in rolling.rolling_features(df, specs, "t", "row_id", hot_rows=hot_rows).collect()}
    want = {0: [1, 1, 1, 1, 1], 1: [1, 1, 1, 1, 1], 2: [2, 2, 2, 2, 1], 3: [2, 2, 2, 2, 1], 4: [0, 0, 0, 0, 0], 9: [0, 0, 0, 0, 0]}
    for i, v in want.items():
        assert [got[i][s.name] for s in specs] == v, i


def test_percentiles_of_many_columns(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5) if i % 6 else None, rng.choice([0.0, -0.0, 1.5, NAN, None]), "x") for i in range(200)]
    got = synth.percentile_ranks(spark.createDataFrame(rows, "id int, a int, b double, s string").repartition(3), ["a", "b"]).collect()
    for j, c in ((1, "a"), (2, "b")):
        v = [r[j] for r in rows if r[j] is not None and not math.isnan(r[j])]
        for r in got:
            x = rows[r["id"]][j]
            want = None if x is None or math.isnan(x) else (sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2) / len(v)
            assert r[f"percentile__{c}"] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("cols", [["a", "b"], ["b"]])
@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_percentiles_that_are_no_broadcast(spark, cols, hot_rows):
    rng = random.Random(2)
    rows = [(i % 150, rng.randint(0, 5) if i % 6 else None, rng.choice([0.0, -0.0, 1.5, math.inf, NAN, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a int, b double").repartition(3)
    want = synth.percentile_ranks(df, cols).collect()
    got = synth.percentile_ranks(df, cols, max_bytes=0, hot_rows=hot_rows)
    assert got.columns == ["id", "a", "b", *[f"percentile__{c}" for c in cols]]
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 200


def shuffled_widths(df):
    """Numbers of columns that the shuffles of a plan carry."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [int(n) for n in re.findall(r"\) Exchange\s+Input \[(\d+)\]", text)]


def test_synthesis_shuffles_rows_and_no_states(spark):
    rng = random.Random(3)
    rows = [(i % 40, rng.random(), rng.randint(0, 9), rng.random(), bool(i % 3), "xyz"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "item int, a double, b int, c double, f boolean, code string")
    out = synth.feature_synthesis(df, "item", Roles(amounts=("a", "b", "c"), flags=("f",), codes=("code",)))
    # the item, three numbers, their percentiles and the flag
    assert 0 < max(shuffled_widths(out)) <= 8


@pytest.mark.parametrize("hot_rows", [3, 10])
def test_keys_of_many_rows_have_the_same_features(spark, hot_rows):
    rng = random.Random(4)
    rows = [
        (rng.choice("aaaabbcde") if i % 20 else None, rng.randint(0, 9), rng.choice([0.5, 1.5, NAN, None, 7.0]), rng.random() if i % 4 else None, rng.choice(["u", "v", None]))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "k string, x int, y double, z double, c string").repartition(3)
    feats = synth.plan_features(["x", "y", "z"], [], ["c"])
    whole, spread = ({r["k"]: r for r in synth.compute_features(df, "k", feats, hot_rows=n).collect()} for n in (10**6, hot_rows))
    assert set(whole) == set(spread) == set("abcde")
    pairs = {r["k"]: r for r in synth.spearman_by_key(df, "k", [f.cols for f in feats if f.agg == "spearman"]).collect()}
    for k, r in whole.items():
        for f in feats:
            for other in (spread[k][f.name], pairs[k][f.name]) if f.agg == "spearman" else (spread[k][f.name],):
                assert r[f.name] == (pytest.approx(other, abs=1e-9) if isinstance(other, float) else other), (k, f.name)


def test_synthesis_plans_transforms(spark):
    rows = [("i", 1.0, 52.0, 13.0, 48.0, 11.0), ("i", 3.0, 52.0, 13.0, 52.0, 13.0), ("j", 2.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "item string, a double, lat double, lon double, to_lat double, to_lon double")
    out = synth.feature_synthesis(df, "item", Roles(amounts=("a",), points=(("lat", "lon"), ("to_lat", "to_lon"))))
    got = {r["item"]: r for r in out.collect()}
    assert got["i"]["mean__percentile__a"] == pytest.approx((1 / 3 + 1) / 2) and got["j"]["max__percentile__a"] == pytest.approx(2 / 3)
    assert got["i"]["min__haversine__lat__to_lat"] == 0 and got["j"]["sum__haversine__lat__to_lat"] == pytest.approx(69.09, abs=0.01)
    assert "spearman__percentile__a__haversine__lat__to_lat" in out.columns


def test_folded_aggregate_never_sees_a_hot_key(spark):
    seen = []

    def partial(values):
        assert len(values) <= 50
        return sorted(v for v in values if v is not None)[-2:]

    fold = synth.Folded(partial, lambda a, b: sorted(a + b)[-2:], lambda s: s[0] if len(s) == 2 else None)
    synth.register_aggregate("second", 1, fold)
    rows = [("hot" if i % 10 else f"k{i}", float(i * 37 % 1000)) for i in range(1000)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {r["k"]: r["second__x"] for r in synth.compute_features(df, "k", synth.plan_features(["x"], [], [])).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        del synth.AGGREGATES["second"]
    assert not seen and got["hot"] == sorted(v for k, v in rows if k == "hot")[-2]
    assert got["k10"] is None and None not in got


def test_an_aggregate_without_a_plan_is_refused():
    with pytest.raises(ValueError):
        synth.register_aggregate("nothing", 1, None)


def chain_frame(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        c = 2 * a - b + rng.gauss(0, 0.01)
        rows.append((i, a if i % 5 else None, b if i % 7 else NAN, c if i % 3 else None, None))
    return rows, spark.createDataFrame(rows, "row_id int, a double, b double, c double, gone double")


def test_chain_is_kept_and_applied_to_other_rows(spark, tmp_path):
    cols = ["a", "b", "c", "gone"]
    rows, df = chain_frame(spark, 1, 400)
    path = str(tmp_path / "chain")
    fitted = impute.fit_linear(df, cols, "row_id", path)
    again = {r["row_id"]: r for r in impute.apply_saved(df, path).collect()}
    for r in fitted.collect():
        for c in cols[:3]:
            assert again[r["row_id"]][c] == pytest.approx(r[c], rel=1e-9)
        assert r["gone"] is None is again[r["row_id"]]["gone"]
    later, other = chain_frame(spark, 2, 90)
    full = {r["row_id"]: r for r in impute.apply_saved(other, path).collect()}
    for i, a, b, c, _ in later:
        if c is None and a is not None and not math.isnan(b):
            assert full[i]["c"] == pytest.approx(2 * a - b, abs=0.3)
        assert None not in (full[i]["a"], full[i]["b"], full[i]["c"])


def test_forest_is_kept(spark, tmp_path):
    _, df = chain_frame(spark, 3, 120)
    path = str(tmp_path / "forest")
    fitted = {r["row_id"]: r["c"] for r in impute.fit_forest(df, ["a", "c"], "row_id", path, trees=5, rounds=2).collect()}
    again = {r["row_id"]: r["c"] for r in impute.apply_saved(df, path).collect()}
    assert again == pytest.approx(fitted)


@pytest.mark.parametrize("method", ["mean", "median", "most", "linear_reg"])
def test_amounts_are_kept_whatever_the_method(spark, tmp_path, method):
    _, df = chain_frame(spark, 4, 60)
    path = str(tmp_path / method)
    fitted = {r["row_id"]: (r["a"], r["c"]) for r in impute.impute_amounts(df, ["a", "c"], method, path).collect()}
    again = {r["row_id"]: (r["a"], r["c"]) for r in impute.apply_saved(df, path).collect()}
    assert all(again[i] == pytest.approx(v) for i, v in fitted.items())


def test_columns_without_any_value(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, None), (2, None, NAN, None)], "row_id int, a double, b double, code string")
    assert [tuple(r)[1:3] for r in impute.impute_linear(df, ["a", "b"], "row_id").select("row_id", "a").collect()] == [(None,), (None,)]
    assert impute.impute_forest_code(df, "code", ["a", "b"]).count() == 2
