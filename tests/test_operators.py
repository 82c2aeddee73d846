"""Operators against brute force, on small frames with nulls, ties, edges and forced hot paths."""

import math
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar, special
from panelspark.operators import clean, encode, evaluate, impute, joins, quantile, ranks, resample, sampling, scale, select, stats, synth, text
from panelspark.operators import rolling
from panelspark.operators.neighbors import impute_knn, knn_join
from panelspark.operators.rolling import Spec, rolling_features
from panelspark.roles import Roles
from panelspark.session import scratch_dir

T0 = datetime(2024, 1, 1)


# ---- rolling -----------------------------------------------------------------------------------


def panel_rows(n=300, seed=1, span_days=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + timedelta(seconds=rnd.randrange(span_days * 86400) // 3600 * 3600)
        key = None if rnd.random() < 0.05 else ("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}")
        amt = None if rnd.random() < 0.15 else round(rnd.uniform(-50, 50), 2)
        code = None if rnd.random() < 0.15 else rnd.choice("abcdef")
        rows.append((i, key, None if rnd.random() < 0.03 else t, amt, code))
    return rows


def brute_rolling(rows, specs):
    out = {}
    for i, key, t, _, _ in rows:
        for s in specs:
            frame = [
                r for r in rows
                if key is not None and t is not None and r[1] == key and r[2] is not None and t - timedelta(days=s.days) < r[2] <= t
            ]
            vals = [r[3 if s.col == "amt" else 4] for r in frame]
            vals = [v for v in vals if v is not None]
            if s.func == "cnt":
                v = len(set(vals))
            elif not vals:
                v = 0
            else:
                v = {"sum": sum, "mean": lambda x: sum(x) / len(x), "min": min, "max": max}[s.func](vals)
            out[i, s.name] = v
    return out


SPECS = [Spec("key", "amt", f, 7) for f in ("sum", "mean", "min", "max")] + [Spec("key", "amt", "sum", 15)]
SPECS += [Spec("key", "code", "cnt", 7), Spec("key", "amt", "cnt", 15)]


@pytest.mark.parametrize("hot_rows,blocks", [(10**6, 256), (50, 256), (1, 7), (50, 1)])
def test_rolling_matches_brute_force(spark, hot_rows, blocks):
    rows = panel_rows()
    df = spark.createDataFrame(rows, "row_id long, key string, t timestamp_ntz, amt double, code string")
    out = rolling_features(df, SPECS, "t", "row_id", hot_rows=hot_rows, blocks=blocks)
    assert dict(out.dtypes)["key_n_code_cnt_7"] == "bigint"
    got = out.collect()
    want = brute_rolling(rows, SPECS)
    assert len(got) == len(rows)
    for r in got:
        for s in SPECS:
            assert r[s.name] == pytest.approx(want[r["row_id"], s.name], abs=1e-9), (r["row_id"], s.name)


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_rolling_window_is_open_on_the_left(spark, hot_rows):
    edge, inside = T0 + timedelta(days=7), T0 + timedelta(days=7) - timedelta(microseconds=1)
    rows = [(1, "a", T0, 1.0), (2, "a", inside, 2.0), (3, "a", edge, 4.0), (4, "a", edge, 8.0)]
    df = spark.createDataFrame(rows, "row_id long, key string, t timestamp_ntz, amt double")
    out = rolling_features(df, [Spec("key", "amt", "sum", 7), Spec("key", "amt", "cnt", 7)], "t", "row_id", hot_rows=hot_rows)
    got = {r["row_id"]: (r["key_n_amt_sum_7"], r["key_n_amt_cnt_7"]) for r in out.collect()}
    # row 1 is exactly seven days before the edge, rows of one instant see each other
    assert got == {1: (1.0, 1), 2: (3.0, 2), 3: (14.0, 3), 4: (14.0, 3)}


def test_rolling_names_and_grid():
    grid = rolling.feature_grid(["user", "code"], ["code", "amt"], [7, 15], ["sum", "max"])
    assert len(grid) == 3 * 2 * 2 and all(s.key != s.col for s in grid)
    assert Spec("user", "amt", "sum", 7).name == "user_n_amt_sum_7"


def test_rolling_plan_has_one_shuffle_per_key(spark):
    df = spark.createDataFrame(panel_rows(), "row_id long, key string, t timestamp_ntz, amt double, code string")
    plan = rolling_features(df, SPECS, "t", "row_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---- joins -------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    rows = spark.createDataFrame(
        [(i, None if i % 7 == 0 else ("hot" if i % 3 else f"k{i % 11}")) for i in range(500)], "row_id long, k string"
    )
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(8)], "k string, v int")
    plain = sorted(map(tuple, rows.join(table, "k", how).select("row_id", "k", "v").collect()), key=repr)
    for kw in ({}, {"max_bytes": 0, "hot_rows": 50}, {"max_bytes": 0, "hot_rows": 10**9}):
        got = joins.lookup_join(rows, table, "k", how, **kw).select("row_id", "k", "v").collect()
        assert sorted(map(tuple, got), key=repr) == plain


def test_fetch_bounded_checks_size(spark):
    df = spark.range(1000)
    assert joins.fetch_bounded(df, 1000) is None
    assert joins.fetch_bounded(df, 10**6).count() == 1000


# ---- order and quantiles -----------------------------------------------------------------------


def test_ranks_match_pandas(spark):
    rnd = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rnd.integers(0, 3, 400), "a": np.where(rnd.random(400) < 0.4, 0.0, rnd.normal(size=400).round(1)), "b": rnd.integers(-5, 5, 400)})
    df = spark.createDataFrame(pdf)
    r = ranks.column_ranks(df, ["a", "b"], ["g"], n=5).toPandas()
    for (g, c), part in r.groupby(["g", "column"]):
        want = pdf[pdf.g == g][c].rank()
        got = part.set_index("value")["avg_rank"]
        assert np.allclose(pdf[pdf.g == g][c].astype(float).map(got), want)
    for hot in (10**6, 140, 1):
        w = ranks.row_ranks(df, ["a", "b"], ["g"], n=5, hot_rows=hot).toPandas()
        for g in range(3):
            assert sorted(w[w.g == g]["a__rank"]) == sorted(pdf[pdf.g == g]["a"].rank())
        assert len(w) == len(pdf)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 10, list(range(101)), [0.0] * 50 + [1.5, -2.0, 9.0]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v), 0) for v in values] + [(None, 0), (float("nan"), 0)], "x double, g int")
    probs = {"p1": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = ranks.exact_quantiles(df, ["x"], probs, n=7).first()
    for k, p in probs.items():
        assert got[k] == pytest.approx(np.quantile(values, p))
    per = ranks.exact_quantiles(df, ["x"], probs, ["g"]).first()
    assert per["p50"] == pytest.approx(np.quantile(values, 0.5))


def test_quantiles_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row_id long, x double")
    out = quantile.quantile_bands(df, ["x"]).collect()
    assert len(out) == 2 and all(r["x_1st_yn"] == 0 and r["x_4th_yn"] == 0 and r["x_50"] is None for r in out)
    assert quantile.quantile_bands(df.limit(0), ["x"]).count() == 0


def test_bands_split_the_rows(spark):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)] + [(None,)], "x double")
    b = quantile.quantile_bands(df, ["x"])
    total = F.col("x_1st_yn") + F.col("x_2nd_yn") + F.col("x_3rd_yn") + F.col("x_4th_yn")
    assert b.where((total != 1) & F.col("x").isNotNull()).count() == 0
    assert b.where(F.col("x").isNull() & (total != 0)).count() == 0
    assert b.where("x_4th_yn = 1").agg(F.min("x")).first()[0] > b.first()["x_75"]


# ---- cleaning ----------------------------------------------------------------------------------


def test_noise_rows_treat_null_as_different(spark):
    df = spark.createDataFrame([("a", None, None, None), (None, None, None, None), ("z", "b", None, "bad"), ("z", "b", None, None)], "p string, q string, r string, s string")
    out = clean.drop_noise_rows(df, [("p", "a"), ("q", "b"), ("r", "c")], [("s", "bad")])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", None, None, None), ("z", "b", None, None)], key=repr)


def test_labels(spark):
    df = spark.createDataFrame([("x", "y"), ("x", None), (None, None)], "a string, b string")
    out = clean.label_multiclass(df, [F.col("a") == "x", F.col("b") == "y", F.col("b") == "q"], drop=["a"])
    assert [r["target"] for r in out.collect()] == [2, 1, 0] and out.columns == ["b", "target"]
    assert dict(out.dtypes)["target"] == "int"
    assert [r[0] for r in df.select(clean.code_label(F.col("b"), "y")).collect()] == [0, 1, 1]


def test_sparse_columns_threshold(spark):
    df = spark.createDataFrame([(1, 1 if i < 4 else None, 1 if i < 2 else None) for i in range(10)], "a int, b int, c int")
    assert clean.drop_sparse_columns(df, 0.7).columns == ["a", "b"]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 2**40, 2.0, 2.5, None)], "a long, b long, c long, d long, e double, f double, g long")
    got = dict(clean.narrow_types(df).dtypes)
    assert got == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "tinyint", "f": "double", "g": "bigint"}


def test_select_columns_order_and_difference(spark):
    assert clean.columns_containing(["ab", "b", "ca", "ab"], ["a", "b"]) == ["ab", "ca", "b"]
    assert clean.columns_minus(["a", "b", "c"], ["b"]) == ["a", "c"]


def test_scalars(spark):
    df = spark.createDataFrame([(-1.0, "00082x"), (0.0, "00083"), (99.0, "82"), (None, None)], "x double, i string")
    got = df.select(
        scalar.log_transform(F.col("x")).alias("l"), scalar.add_sign(F.col("x")).alias("s"), scalar.amt_log(F.col("x")).alias("a"),
        scalar.business_code_flag(F.col("i")).alias("b"),
    ).collect()
    assert [r["l"] for r in got] == [None, 0.0, 2.0, None]
    assert [r["s"] for r in got] == [1, 0, 0, 0]
    assert [r["b"] for r in got] == [1, 1, 0, 0]
    back = df.where("x >= 0").select(scalar.de_log_transform(scalar.log_transform(F.col("x"))).alias("x")).collect()
    assert [r["x"] for r in back] == [0.0, 99.0]


def test_micros_ignores_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 1, 250001),)], "t timestamp_ntz")
    want = int((datetime(2024, 3, 10, 2, 30, 1, 250001) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.select(scalar.micros(F.col("t"))).first()[0] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---- encoding and imputation -------------------------------------------------------------------


def test_encodings_with_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "row_id long, c string")
    for kw in ({}, {"max_bytes": 0, "hot_rows": 1}):
        assert {r["row_id"]: r["c_code"] for r in encode.factorize(df, "c", "row_id", **kw).collect()} == {1: 0, 2: -1, 3: 1, 4: 0}
        assert {r["row_id"]: r["c"] for r in encode.frequency_encode(df, ["c"], **kw).collect()} == {1: 0.5, 2: None, 3: 0.25, 4: 0.5}
    assert {r["row_id"]: r["c_code"] for r in encode.ordinal_first_seen(df, "c", "row_id").collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_mode_tie_takes_the_smallest_by_value(spark):
    df = spark.createDataFrame([(10, "b", 1.5), (9, "a", None), (None, None, float("nan"))], "n long, s string, x double")
    got = impute.fit_fill(df, ["n", "s", "x"], "most").first()
    assert (got["n"], got["s"], got["x"]) == (9, "a", 1.5)
    assert impute.impute(df, ["x"], "mean").where("x = 1.5").count() == 3


def test_chained_regression_recovers_linear_columns(spark):
    rnd = np.random.default_rng(3)
    a, b = rnd.normal(size=200), rnd.normal(size=200)
    c = 2 * a - b + 1
    rows = [(i, float(a[i]), None if i % 10 == 1 else float(b[i]), None if i % 10 == 2 else float(c[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    out = {r["row_id"]: r for r in impute.impute(df, ["a", "b", "c"], "linear_reg").collect()}
    for i in range(200):
        assert out[i]["c"] == pytest.approx(c[i], abs=0.05) and out[i]["b"] == pytest.approx(b[i], abs=0.05)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        impute.impute(spark.range(1), ["id"], "nope")


# ---- neighbours --------------------------------------------------------------------------------


def brute_knn(q, d, k, self_):
    out = {}
    for i, v in q:
        near = sorted((round(math.dist(v, w), 9), j) for j, w in d if not (self_ and i == j))[:k]
        out[i] = near
    return out


@pytest.mark.parametrize("block_rows", [4096, 40, 9])
def test_knn_join_is_exact(spark, block_rows):
    rnd = np.random.default_rng(5)
    pts = np.vstack([rnd.normal(size=(120, 3)), np.tile([[5.0, 5.0, 5.0]], (60, 1)), rnd.normal(size=(60, 3)) + 8])
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in knn_join(df, df, 4, exclude_self=True, block_rows=block_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], round(r["dist"], 9), r["nn_id"]))
    want = brute_knn(rows, rows, 4, True)
    assert {i: [x[1:] for x in sorted(v)] for i, v in got.items()} == want


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vec array<double>")
    assert knn_join(df, df, 5, exclude_self=True).count() == 2
    assert knn_join(df.where("id = 1"), df.where("id = 1"), 5, exclude_self=True).count() == 0


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_knn_imputation_by_hand(spark, block_rows):
    rows = [(1, 1.0, 2.0, None), (2, 3.0, 4.0, 3.0), (3, None, 6.0, 5.0), (4, 8.0, 8.0, 7.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    got = {r["row_id"]: r for r in impute_knn(df, ["a", "b", "c"], k=2, block_rows=block_rows).collect()}
    # published example of this imputer: the gaps become 4.0 and 5.5
    assert got[1]["c"] == 4.0 and got[3]["a"] == 5.5


# ---- statistics --------------------------------------------------------------------------------


def test_tail_probabilities():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-10)
    assert special.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.kolmogorov_sf(1.358 / math.sqrt(10_000), 10_000) == pytest.approx(0.05, abs=2e-3)


def test_shapiro_published_example():
    w, p = special.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=5e-3) and p == pytest.approx(0.0067, abs=5e-4)


def kendall_brute(x, y):
    con = dis = 0
    for i in range(len(x)):
        for j in range(i):
            s = (x[i] - x[j]) * (y[i] - y[j])
            con += s > 0
            dis += s < 0
    return con, dis


def test_kendall_counts_with_ties(spark):
    rnd = np.random.default_rng(7)
    x, y, f = rnd.integers(0, 12, 240), rnd.integers(0, 9, 240), rnd.integers(0, 2, 240)
    df = spark.createDataFrame([(int(a), int(b), int(g)) for a, b, g in zip(x, y, f)], "x int, y int, f int")
    for r in stats.test_kendall(df, ["x", "y"], "f").collect():
        m = f == r["f"]
        assert (r["con"], r["dis"]) == kendall_brute(x[m], y[m])
        assert 0 <= r["p_value"] <= 1
    lab = stats.label_kendall(df, ["x"], "f").first()
    con, dis = kendall_brute(x, f)
    n = len(x)
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    assert lab["statistic"] == pytest.approx((con - dis) / math.sqrt((n * (n - 1) / 2 - ties(x)) * (n * (n - 1) / 2 - ties(f))))


def test_textbook_rank_tests(spark):
    a, b = [19, 22, 16, 29, 24], [20, 11, 17, 12]
    df = spark.createDataFrame([(float(v), 1) for v in a] + [(float(v), 0) for v in b], "x double, f int")
    u = stats.test_mannwhitney(df, ["x"], "f").first()
    assert u["statistic"] == 17.0 and u["p_value"] == pytest.approx(0.11134688, abs=1e-6)
    h = stats.test_kruskal(spark.createDataFrame([(float(v), 1) for v in (1, 3, 5, 7, 9)] + [(float(v), 0) for v in (2, 4, 6, 8, 10)], "x double, f int"), ["x"], "f").first()
    assert h["statistic"] == pytest.approx(0.27272727) and h["p_value"] == pytest.approx(0.60150813, abs=1e-6)


def test_chi2_two_by_two_is_corrected(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 25
    df = spark.createDataFrame([(p, q, 1) for p, q in rows], "p string, q string, f int")
    n, (r1, r2), (c1, c2) = 85, (30, 55), (40, 45)
    d = abs(10 * 25 - 20 * 30) / n
    want = (d - 0.5) ** 2 * n * (1 / r1 + 1 / r2) * (1 / c1 + 1 / c2)
    got = stats.test_chi2(df, ["p", "q"], "f").first()
    assert got["statistic"] == pytest.approx(want) and got["dof"] == 1


def test_normality_direction(spark):
    rnd = np.random.default_rng(11)
    df = spark.createDataFrame([(float(v), 1) for v in rnd.normal(size=500)] + [(float(v), 0) for v in rnd.exponential(size=500)], "x double, f int")
    got = {(r["grp"], r["test"]): r["verdict"] for r in stats.normality_report(df, ["x"], "f").collect()}
    assert got["fraud", "shapiro"] == "normal" and got["normal", "shapiro"] == "not normal"
    assert got["fraud", "dagostino"] == "normal" and got["normal", "dagostino"] == "not normal"
    assert got["fraud", "anderson_5.0"] == "normal" and got["normal", "anderson_5.0"] == "not normal"


def test_constant_columns_give_no_statistic(spark):
    df = spark.createDataFrame([(1.0, float(i), i % 2) for i in range(20)], "c double, x double, f int")
    assert all(r["statistic"] is None for r in stats.test_spearman(df, ["c", "x"], "f", hot_rows=1).collect())
    for t in (stats.test_pearson, stats.test_spearman, stats.test_kendall):
        assert all(r["statistic"] is None for r in t(df, ["c", "x"], "f").collect())
    for t in (stats.label_pearson, stats.label_spearman, stats.label_kendall, stats.test_anova, stats.test_levene, stats.test_ttest, stats.test_kruskal):
        assert {r["column"]: r["statistic"] for r in t(df, ["c", "x"], "f").collect()}["c"] is None
    assert all(r["verdict"] for r in stats.significance_report(df, ["c", "x"], "f").collect())


def test_ttest_follows_levene(spark):
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v), 1) for v in rnd.normal(0, 1, 200)] + [(float(v), 0) for v in rnd.normal(0.1, 5, 100)], "x double, f int")
    assert not stats.test_ttest(df, ["x"], "f").first()["equal_var"]


# ---- synthesis ---------------------------------------------------------------------------------


def test_small_group_rules(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 3.0, 2.0), ("three", 1.0, 1.0), ("three", 2.0, 4.0), ("three", 9.0, 2.0)], "k string, a double, b double")
    got = {r["k"]: r for r in synth.aggregate_by_key(df, "k", ["std", "skew", "range"], ["a"]).collect()}
    assert got["one"]["std__a"] is None and got["one"]["skew__a"] is None and got["two"]["skew__a"] is None
    assert got["three"]["skew__a"] == pytest.approx(pd.Series([1.0, 2.0, 9.0]).skew())
    rho = {r["k"]: r["spearman__a__b"] for r in synth.spearman_by_key(df, "k", [("a", "b")]).collect()}
    assert rho["one"] is None and rho["two"] is None and rho["three"] == pytest.approx(0.5)


def test_first_row_wins_even_when_null(spark):
    df = spark.createDataFrame([(2, "k", T0, "late"), (1, "k", T0, None), (3, "k", T0 + timedelta(1), "later")], "row_id long, k string, t timestamp_ntz, a string")
    assert synth.normalize_dimension(df, "k", ["a"], "t", "row_id").first()["a"] is None


def test_label_never_becomes_a_feature_and_limit_holds(spark):
    df = spark.createDataFrame([(1, "i", 1.0, 1), (2, "i", 2.0, 0)], "row_id long, item string, a double, target int")
    parent = spark.createDataFrame([("i", 5.0, 1)], "item string, p double, target int")
    roles = Roles(amounts=("a", "target"), label="target")
    out = synth.feature_synthesis(df, "item", roles, parent, "item")
    assert not [c for c in out.columns if "target" in c] and "mean__parent__p" in out.columns
    assert len(synth.feature_synthesis(df, "item", roles, max_features=4).columns) == 5


def test_user_aggregate_joins_the_synthesis(spark):
    synth.register_aggregate("spread2", 1, lambda x: (F.max(x) - F.min(x)) * 2)
    try:
        df = spark.createDataFrame([("i", 1.0), ("i", 4.0)], "item string, a double")
        assert synth.feature_synthesis(df, "item", Roles(amounts=("a",))).first()["spread2__a"] == 6.0
    finally:
        del synth.AGGREGATES["spread2"]


# ---- scaling, selection ------------------------------------------------------------------------


@pytest.mark.parametrize("kind", scale.KINDS)
def test_scaler_inverse_and_constant(spark, kind):
    df = spark.createDataFrame([(float(i), 4.0) for i in range(9)], "a double, c double")
    p = scale.fit_scaler(df, ["a", "c"], kind)
    s = scale.apply_scaler(df, ["a", "c"], p)
    assert {r["c"] for r in s.collect()} == {0.0}
    back = scale.invert_scaler(s, ["a", "c"], p).collect()
    assert sorted(round(r["a"], 9) for r in back) == [float(i) for i in range(9)]


def test_scaler_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    test = spark.createDataFrame([(20.0,)], "a double")
    _, out = scale.fit_apply_scaler(train, test, ["a"], "minmax", scratch_dir(spark, "t"))
    assert out.first()["a"] == 2.0


def test_constant_column_scores_zero(spark):
    df = spark.createDataFrame([(float(i), 1.0, i % 2) for i in range(10)], "a double, c double, y int")
    got = {r["feature"]: (r["picked"], r["score"]) for r in select.select_correlation(df, ["a", "c"], "y", 1).collect()}
    assert got["c"] == (False, 0.0) and got["a"][0]


def test_votes_sort_and_threshold(spark):
    rows = [(f, s, n > i) for f, n in (("a", 6), ("b", 5), ("c", 5), ("d", 1)) for i, s in enumerate(select.SELECTORS)]
    v = select.vote_features(spark.createDataFrame(rows, "feature string, selector string, picked boolean"))
    got = [(r["feature"], r["total"], r["chosen"]) for r in v.collect()]
    assert got == [("a", 6, True), ("c", 5, True), ("b", 5, True), ("d", 1, False)]


def test_adaboost_finds_the_informative_column(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a > 0.2)) for a, b in x], "a double, b double, y int")
    assert select.adaboost_importance_rank(df, ["a", "b"], "y", rounds=3).first()["feature"] == "a"


# ---- splits and draws --------------------------------------------------------------------------


def labelled(spark, sizes):
    rows, i = [], 0
    for c, n in sizes.items():
        for _ in range(n):
            rows.append(((i * 37) % 1009, c))
            i += 1
    return spark.createDataFrame(rows, "row_id long, y int"), rows


def test_split_sizes_and_disjointness(spark):
    df, rows = labelled(spark, {0: 200, 1: 33, 2: 1})
    out = sampling.stratified_split(df, "y", "row_id").collect()
    assert len(out) == len({r["row_id"] for r in out}) == len(rows)
    count = lambda c: sum(r["role"] == "test" and r["y"] == c for r in out)
    assert (count(0), count(1), count(2)) == (40, 7, 0)


def test_folds_of_a_worked_example(spark):
    """Classes by first appearance: b fills places 0-4, a 5-7, c 8-9; a class's places modulo 3 say how many rows a fold gets."""
    rows = list(enumerate("babbabcbac"))
    df = spark.createDataFrame(rows, "row_id long, y string").repartition(3)
    got = {r["row_id"]: r["fold"] for r in sampling.stratified_kfold(df, "y", "row_id", 3).collect()}
    # b (rows 0 2 3 5 7): two, two, one; a (1 4 8): one each; c (6 9): one, none, one
    assert got == {0: 0, 2: 0, 3: 1, 5: 1, 7: 2, 1: 0, 4: 1, 8: 2, 6: 0, 9: 2}


def test_draws_with_replacement(spark):
    df, _ = labelled(spark, {0: 40, 1: 5})
    out = sampling.class_balanced_bootstrap(df, "y", "row_id")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 22, 1: 22}
    again = sampling.class_balanced_bootstrap(df.repartition(7), "y", "row_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert sampling.random_batch(df, "row_id", 100).count() == 100


def test_often_drawn_rows_are_spread(spark):
    df, _ = labelled(spark, {0: 40, 1: 2})
    plain = sampling.draw_rows(df, "y", "row_id", {0: 10, 1: 90}).collect()
    split = sampling.draw_rows(df, "y", "row_id", {0: 10, 1: 90}, per_task=7).collect()
    assert len(plain) == 100 and sorted(map(tuple, plain)) == sorted(map(tuple, split))


# ---- rebalancing -------------------------------------------------------------------------------


def blobs(spark, n0=60, n1=12, seed=0):
    rnd = np.random.default_rng(seed)
    pts = np.vstack([rnd.normal(size=(n0, 2)), rnd.normal(size=(n1, 2)) + 1.0])
    rows = [(i, [float(a), float(b)], int(i >= n0)) for i, (a, b) in enumerate(pts)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int"), rows


@pytest.mark.parametrize("name", ["ros", "border_smote", "svmsmote"])
def test_over_samplers_balance(spark, name):
    df, _ = blobs(spark)
    out = resample.OVER[name](df)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 60, 1: 60}
    assert out.where("not synthetic").count() == 72


def test_smote_points_lie_between_neighbours(spark):
    df, rows = blobs(spark)
    lo, hi = (np.array([f([r[1][i] for r in rows if r[2] == 1]) for i in range(2)]) for f in (min, max))
    for r in resample.over_smote_borderline(df).where("synthetic").collect():
        assert np.all(np.array(r["vec"]) >= lo - 1e-9) and np.all(np.array(r["vec"]) <= hi + 1e-9)


def test_nominal_codes_stay_codes(spark):
    df, _ = blobs(spark)
    coded = df.withColumn("vec", F.concat("vec", F.array((F.col("id") % 4).cast("double"))))
    out = resample.over_smote_nc(coded, 2).where("synthetic").collect()
    assert len(out) == 48 and {r["vec"][2] for r in out} <= {0.0, 1.0, 2.0, 3.0}


def test_single_minority_row_has_no_neighbour(spark):
    df, _ = blobs(spark, 10, 1)
    assert resample.over_smote_borderline(df).where("synthetic").count() == 0


def test_tomek_pair_by_construction(spark):
    rows = [(1, [0.0], 0), (2, [0.1], 1), (3, [5.0], 0), (4, [5.3], 0), (5, [9.0], 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    assert sorted(r["id"] for r in resample.under_tomek(df).collect()) == [2, 3, 4, 5]


def test_under_samplers(spark):
    df, _ = blobs(spark)
    n = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert n(resample.under_random(df)) == {0: 12, 1: 12}
    assert n(resample.under_centroids(df)) == {0: 12, 1: 12}
    assert n(resample.under_one_sided(df))[1] == 12
    with pytest.raises(ValueError):
        resample.under_centroids(df, clusters=10**6)


def test_rebalance_both_and_fresh_ids(spark):
    df, _ = blobs(spark)
    out = resample.rebalance(df, "both", "border_smote", "tomek")
    ids = [r["id"] for r in out.select("id").collect()]
    assert len(ids) == len(set(ids)) and None not in ids
    assert resample.rebalance(df, "None").count() == 72


def test_repeat_rows_counts(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 70_000)], "id long, n long")
    out = resample.repeat_rows(df, "n")
    assert {r["id"]: (r["c"], r["m"]) for r in out.groupBy("id").agg(F.count("*").alias("c"), F.max("draw").alias("m")).collect()} == {2: (3, 2), 3: (70_000, 69_999)}


# ---- text and evaluation -----------------------------------------------------------------------


def test_token_ids_are_adler32(spark):
    words = ["not", "exist", "größe", "漢字", "a" * 300]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["i"] for r in df.select("w", text.token_id(F.col("w")).alias("i")).collect()}
    assert got == {w: zlib.adler32(w.encode()) % 32000 for w in words}


def test_all_tokens_of_the_document_survive(spark):
    df = spark.createDataFrame([(1, "Hello, World! x2"), (2, ""), (3, None), (4, "...")], "row_id long, text string")
    got = {r["row_id"]: r["text_tokens"] for r in text.tokenize_columns(df, ["text"]).collect()}
    assert got[1] == ["hello", "world", "x2"] and got[2] == got[3] == got[4] == ["not", "exist"]


def test_missing_topics_share_the_rest(spark):
    df = spark.createDataFrame([([0.9, 0.095, 0.004, 0.001],), ([0.25] * 4,)], "v array<double>")
    got = [r[0] for r in df.select(text.spread_missing(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.9, 0.095, 0.0025, 0.0025]) and got[1] == [0.25] * 4


def test_metrics_without_positives_are_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "f int, s double")
    r = evaluate.binary_metrics(df, "f", "s").first()
    assert r["recall"] is None and r["precision"] is None and r["f1"] is None
    assert evaluate.auc(df, "f", "s").first()["auc"] is None


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "f int, s double")
    assert evaluate.auc(df, "f", "s").first()["auc"] == pytest.approx(0.875)


# ---- missing labels, NaN, tails ------------------------------------------------------------------


def labelled_rows(spark):
    rows = [(i, float(i % 7), 0) for i in range(50)] + [(50 + i, float(i % 5), 1) for i in range(20)] + [(90, 1.0, None), (91, 2.0, None)]
    return spark.createDataFrame(rows, "id long, x double, label int")


def test_missing_labels_are_no_class(spark):
    df = labelled_rows(spark)
    assert sampling.class_counts(df, "label") == {0: 50, 1: 20}
    vecs = df.select("id", F.array("x", F.col("id").cast("double")).alias("vec"), "label")
    assert {r.label: r["count"] for r in resample.under_random(vecs).groupBy("label").count().collect()} == {0: 20, 1: 20}
    assert resample.under_tomek(vecs).where("label is null").count() == 0
    split = sampling.stratified_split(df, "label", "id")
    assert split.count() == 70 and split.where("role = 'test'").count() == 14
    assert sampling.stratified_kfold(df, "label", "id", 5).where("fold is null or label is null").count() == 0
    drawn = sampling.class_balanced_bootstrap(df, "label", "id")
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {0: 35, 1: 35}


def test_auc_sees_labelled_rows(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95), (None, 0.05)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()[0] == 1.0


def test_statistics_without_group_or_value(spark):
    nan = float("nan")
    rows = [(float(i), float(i * i % 11), i % 2) for i in range(40)] + [(nan, 1.0, 0), (1.0, nan, 1), (3.0, 3.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, f int")
    got = {r.f: r.statistic for r in stats.test_pearson(df, ["a", "b"], "f").collect()}
    for f in (0, 1):
        pairs = np.array([r[:2] for r in rows if r[2] == f and not math.isnan(r[0] + r[1])])
        assert got[f] == pytest.approx(np.corrcoef(pairs.T)[0, 1])
    assert set(got) == {0, 1}
    small = spark.createDataFrame([(float(i), 0) for i in range(5)] + [(float(i % 9), 1) for i in range(20)], "a double, f int")
    got = {r.f: r.statistic for r in stats.test_dagostino(small, ["a"], "f").collect()}
    assert got[0] is None and got[1] is not None


def test_anderson_keeps_far_outliers(spark):
    values = [math.sin(i) for i in range(5000)] + [1e6]
    df = spark.createDataFrame([(v, 1) for v in values], "a double, f int")
    got = stats.test_anderson(df, ["a"], "f").first().statistic
    m, s = np.mean(values), np.std(values, ddof=1)
    z = np.sort((np.array(values) - m) / s)
    log_phi = lambda x: math.log(0.5 * math.erfc(-x / math.sqrt(2))) if x > -30 else -x * x / 2 - math.log(-x * math.sqrt(2 * math.pi)) - 1 / x**2
    n = len(z)
    want = -n - sum((2 * i + 1) * (log_phi(z[i]) + log_phi(-z[n - 1 - i])) for i in range(n)) / n
    assert got == pytest.approx(want, rel=1e-6)


def test_normal_cdf_array():
    x = np.concatenate([np.linspace(-37, 8, 400), [0.0, -0.0]])
    assert special.normal_cdf(x) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rel=1e-9)
    assert math.isnan(special.normal_cdf(np.array([float("nan")]))[0])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (3.0, None)], "x double, k int")
    assert {r.column: r.n_null for r in clean.null_profile(df).collect()} == {"x": 1, "k": 1, "__total__": 2}
    assert [r.x for r in scale.scale(df, ["x"], "minmax").orderBy("k").collect() if r.x is not None and not math.isnan(r.x)] == [1.0, 0.0]


def test_a_saved_topic_model_is_used_again(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"][: i % 3 + 1]) for i in range(20)], "id int, toks array<string>")
    path = scratch_dir(spark, "lda")
    first = text.lda_fit(df, "toks", 2, path, max_iter=2)
    again = text.lda_fit(df.limit(1), "toks", 5, path)
    assert again.vocabSize() == first.vocabSize() == text.ID_RANGE and again.topicsMatrix().numCols == 2
    assert text.lda_load(spark, path + "/none") is None


def test_bag_counts_every_token(spark):
    rows = [(1, ["x", "y", "x"]), (2, []), (3, None), (4, ["z"] * 500)]
    df = spark.createDataFrame(rows, "id int, toks array<string>")
    got = {(r.id, r.token_id): r.cnt for r in text.hashed_bow(df, "id", "toks").collect()}
    want = {}
    for i, toks in rows:
        for t in toks or []:
            k = (i, zlib.adler32(t.encode()) % text.ID_RANGE)
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_rolling_tasks_grow_with_rows_and_columns(spark, monkeypatch):
    df = spark.range(600).selectExpr("id AS row_id", "id % 60 AS k", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) AS t", "id * 1.0 AS x", "id % 3 AS c")
    specs = [rolling.Spec("k", "x", f, 7) for f in ("sum", "max")] + [rolling.Spec("c", "x", "sum", 7), rolling.Spec("c", "x", "min", 7)]
    whole = rolling.rolling_features(df, specs, "t", "row_id").orderBy("row_id").collect()
    monkeypatch.setattr(rolling, "TASK_CELLS", 40)
    assert rolling.rolling_features(df, specs[:2], "t", "row_id").rdd.getNumPartitions() == 30
    # 200 rows a key are too many for two columns, not for one
    monkeypatch.setattr(rolling, "HOT_HISTORY_ROWS", 300)
    seen, hot = [], rolling.hot_keys
    monkeypatch.setattr(rolling, "hot_keys", lambda *a: seen.append(hot(*a)) or seen[-1])
    assert rolling.rolling_features(df, specs, "t", "row_id").orderBy("row_id").collect() == whole
    assert [h if h is None else h.count() for h in seen] == [None, 3]
    rolling.rolling_features(df, specs[2:3], "t", "row_id")
    assert seen[2] is None


def test_bags_are_written_once_for_all_passes(spark, monkeypatch):
    names, write = [], text.materialize
    monkeypatch.setattr(text, "materialize", lambda df, name: names.append(name) or write(df, name))
    df = spark.createDataFrame([(i, ["a", "b", f"w{i % 5}"]) for i in range(20)], "row_id long, toks array<string>")
    text.lda_fit(df, "toks", 2, max_iter=2)
    assert names == ["bags"]


@pytest.mark.parametrize("min_count", [1, 2])
def test_doc_embedding_takes_contexts_inside_the_row(spark, monkeypatch, min_count):
    import hashlib
    from collections import Counter

    docs = [["a", "b", None, "c", "a"], [], ["c"], None, ["b", "a", "x", "b", "c", "a", "a", "c", "b"], ["y", "y"]]
    df = spark.createDataFrame(list(enumerate(docs)), "row_id long, toks array<string>")
    if min_count == 1:
        # no row per token
        monkeypatch.delattr(text.F, "posexplode")
    out = text.doc_embedding(df, "toks", "vec", 3, window=2, min_count=min_count)
    n = Counter(w for d in docs for w in d or [] if w)
    kept = [[w for w in d or [] if w and n[w] >= min_count] for d in docs]
    sign = lambda w: np.array([1.0 if h >= "8" else -1.0 for h in hashlib.md5(f"{w}~42~0".encode()).hexdigest()[:3]])
    total, places = {w: np.zeros(3) for w in n}, Counter()
    for d in kept:
        for i, w in enumerate(d):
            for j in range(max(0, i - 2), min(len(d), i + 3)):
                if j != i:
                    total[w] += sign(d[j])
                    places[w] += 1
    got = {r["row_id"]: r["vec"] for r in out.collect()}
    for i, d in enumerate(kept):
        want = np.mean([total[w] / places[w] if places[w] else np.zeros(3) for w in d], axis=0) if d else np.zeros(3)
        assert got[i] == pytest.approx(want.tolist())
