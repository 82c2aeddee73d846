"""Rolling windows, aggregation and feature synthesis."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F


from panelspark.operators import rolling, synth
from panelspark.operators.rolling import Spec, feature_grid
from panelspark.queries.base import ITEMS, ORDERS, PANEL, PANEL_NULLS, query, rounded
from panelspark.roles import Roles

DAY = 86_400_000_000
PERIODS = (7, 15, 30)


def win(key: str, days: int, time: str = "t") -> str:
    return f"(PARTITION BY {key} ORDER BY epoch_us({time}) RANGE BETWEEN {days * DAY - 1} PRECEDING AND CURRENT ROW)"


def col_sql(s: Spec, time: str = "t") -> str:
    fn = {"sum": "sum({})", "mean": "avg({})", "min": "min({})", "max": "max({})", "cnt": "count(DISTINCT {})"}[s.func].format(s.col)
    body = f"coalesce({fn} OVER {win(s.key, s.days, time)}, 0)"
    return f"{body if s.func == 'cnt' else f'round({body} + 1e-7, 4)'} AS {s.name}"


def rolling_query(name: str, func: str, col: str):
    specs = [Spec("key", col, func, d) for d in PERIODS]
    fixture = ORDERS if func != "cnt" else PANEL_NULLS
    if func == "cnt":
        sql = f"WITH {fixture} SELECT row_id, {', '.join(col_sql(s) for s in specs)} FROM panel"
    else:
        sql = f"WITH {fixture} SELECT row_id, {', '.join(col_sql(s) for s in specs)} FROM panel"

    @query(name, sql)
    def run(t):
        df = t.orders_panel if func != "cnt" else t.panel_nulls
        out = rolling.rolling_features(df.select("row_id", "key", "t", col), specs, "t", "row_id")
        names = [s.name for s in specs]
        out = out.select("row_id", *names)
        return out.withColumns({n: F.col(n).cast("long") for n in names}) if func == "cnt" else rounded(out, 4, *names)


rolling_query("rolling_distinct", "cnt", "code")
for _f in ("sum", "mean", "min", "max"):
    rolling_query(f"rolling_{_f}", _f, "amt")

_GAPS = [Spec("key", "amt", f, 7) for f in ("sum", "mean", "min", "max", "cnt")]


@query("rolling_missing", f"WITH {PANEL_NULLS} SELECT row_id, {', '.join(col_sql(s) for s in _GAPS)} FROM panel")
def rolling_missing(t):
    """NaN where the SQL has null: both are missing in every window."""
    panel = t.panel.withColumn("amt", F.when(F.col("row_id") % 7 != 0, F.col("amt")).otherwise(F.lit(float("nan"))))
    out = rolling.rolling_features(panel, _GAPS, "t", "row_id").select("row_id", *[s.name for s in _GAPS])
    out = out.withColumn("key_n_amt_cnt_7", F.col("key_n_amt_cnt_7").cast("long"))
    return rounded(out, 4, *[s.name for s in _GAPS if s.func != "cnt"])


GRID = feature_grid(["key", "code"], ["amt", "code"], list(PERIODS), ["sum", "mean", "min", "max"])
GRID = [s for s in GRID if s.col == "amt"] + feature_grid(["key", "code"], ["code", "key"], list(PERIODS), ["cnt"])


@query("rolling_feature_grid", f"WITH {PANEL_NULLS}, p AS (SELECT row_id, t, amt, key, coalesce(code, 'none') AS code FROM panel) "
       f"SELECT row_id, {', '.join(col_sql(s) for s in GRID)} FROM p")
def rolling_feature_grid(t):
    p = t.panel_nulls.withColumn("code", F.coalesce("code", F.lit("none")))
    out = rolling.rolling_features(p, GRID, "t", "row_id").select("row_id", *[s.name for s in GRID])
    out = rounded(out, 4, *[s.name for s in GRID if s.func != "cnt"])
    return out.withColumns({s.name: F.col(s.name).cast("long") for s in GRID if s.func == "cnt"})


_BACK = [Spec("key", "amt", "sum", 7), Spec("key", "amt", "min", 7)]


@query(
    "rolling_join_back",
    f"WITH {PANEL_NULLS}, p AS (SELECT row_id, t, CASE WHEN row_id % 19 <> 0 THEN key END AS key, amt, code FROM panel), "
    f"w AS (SELECT row_id, {', '.join(col_sql(s) for s in _BACK)} FROM p WHERE key IS NOT NULL) "
    "SELECT row_id, p.key, p.amt, p.code, coalesce(key_n_amt_sum_7, 0) AS key_n_amt_sum_7, coalesce(key_n_amt_min_7, 0) AS key_n_amt_min_7 FROM p LEFT JOIN w USING (row_id)",
)
def rolling_join_back(t):
    p = t.panel_nulls.withColumn("key", F.when(F.col("row_id") % 19 != 0, F.col("key")))
    return rounded(rolling.rolling_features(p, _BACK, "t", "row_id").drop("t"), 4, *[s.name for s in _BACK])


rolling.register_window_aggregate(
    "rms",
    rolling.WindowAggregate(
        {"squares": ("sum", lambda x: x * x), "rows": ("sum", lambda x: x.isNotNull().cast("int"))},
        lambda p: F.when(p["rows"] > 0, F.sqrt(p["squares"] / p["rows"])),
    ),
)


@query(
    "rolling_user",
    f"WITH {PANEL_NULLS} SELECT row_id, "
    + ", ".join(f"round(sqrt(avg(amt * amt) OVER {win('key', d)}) + 1e-9, 6) AS key_n_amt_rms_{d}" for d in PERIODS)
    + " FROM panel",
)
def rolling_user(t):
    """A registered aggregate, the root mean square, over three windows."""
    out = rolling.rolling_user(t.panel_nulls, "rms", "key", "amt", list(PERIODS), "t", "row_id")
    names = [f"key_n_amt_rms_{d}" for d in PERIODS]
    return rounded(out.select("row_id", *names), 6, *names)


_FLAG = [Spec("key", "amt", "sum", 7), Spec("key", "amt", "mean", 7), Spec("key", "code", "cnt", 7)]


@query(
    "panel_features",
    f"WITH {PANEL}, q AS (SELECT quantile_cont(amt, 0.25) AS a, quantile_cont(amt, 0.5) AS b, quantile_cont(amt, 0.75) AS c FROM panel) "
    "SELECT row_id, key, round(log10(abs(amt) + 1) + 1e-12, 9) AS amt_log, CASE WHEN amt <= a THEN 1 ELSE 0 END AS amt_1st_yn, "
    "CASE WHEN amt > a AND amt <= b THEN 1 ELSE 0 END AS amt_2nd_yn, CASE WHEN amt > b AND amt <= c THEN 1 ELSE 0 END AS amt_3rd_yn, "
    f"CASE WHEN amt > c THEN 1 ELSE 0 END AS amt_4th_yn, {', '.join(col_sql(s) for s in _FLAG)}, CASE WHEN code = 'error' THEN 1 ELSE 0 END AS f FROM panel, q",
)
def panel_features(t):
    from panelspark.plans.panel import panel_features as plan

    out = plan(t.panel, Roles(keys=("key",), time="t", amounts=("amt",), codes=("code",)), _FLAG, F.col("code") == "error")
    bands = [f"amt_{n}_yn" for n in ("1st", "2nd", "3rd", "4th")]
    names = [s.name for s in _FLAG]
    out = out.select("row_id", "key", F.round(F.col("amt_log") + 1e-12, 9).alias("amt_log"), *bands, *names, "f")
    return rounded(out, 4, *names[:2]).withColumn(names[2], F.col(names[2]).cast("long"))


# ---- aggregation -------------------------------------------------------------------------------


@query(
    "entity_base",
    f"WITH {ORDERS} SELECT row_id, key, t, amt, row_id AS target_id FROM panel",
)
def entity_base(t):
    return synth.entity_base(t.orders_panel.select("row_id", "key", "t", "amt"), "row_id", "t")


@query(
    "normalize_dimension",
    f"WITH {PANEL_NULLS} SELECT key, arg_min_null(amt, (t, row_id)) AS amt, arg_min_null(code, (t, row_id)) AS code FROM panel GROUP BY key",
)
def normalize_dimension(t):
    return synth.normalize_dimension(t.panel_nulls, "key", ["amt", "code"], "t", "row_id")


_NUM = ("qty", "price", "disc")
_AGG_SQL = {
    "min": "min({})", "max": "max({})", "mean": "avg({})", "sum": "sum({})", "std": "stddev_samp({})",
    "skew": "skewness({})", "range": "max({0}) - min({0})",
}


def agg_query(func: str):
    digits = 4 if func != "skew" else 6
    cols = ", ".join(f"round({_AGG_SQL[func].format(c)} + 1e-{digits + 3}, {digits}) AS {func}__{c}" for c in _NUM)

    @query(f"agg_{func}", f"WITH {ITEMS} SELECT item, {cols} FROM items GROUP BY item")
    def run(t):
        return rounded(synth.aggregate_by_key(t.items, "item", [func], list(_NUM)), digits, *[f"{func}__{c}" for c in _NUM])


for _f in _AGG_SQL:
    agg_query(_f)


def bool_query(func: str, sql: str, digits: int | None):
    cols = ", ".join(f"{sql.format(c)} AS {func}__{c}" for c in ("is_r", "deep"))

    @query(f"agg_{func}", f"WITH {ITEMS} SELECT item, {cols} FROM items GROUP BY item")
    def run(t):
        out = synth.aggregate_by_key(t.items, "item", [func], ["is_r", "deep"])
        return rounded(out, digits, f"{func}__is_r", f"{func}__deep") if digits else out


bool_query("percent_true", "round(avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END) + 1e-9, 6)", 6)
bool_query("all", "bool_and({})", None)
bool_query("any", "bool_or({})", None)


@query(
    "agg_num_unique",
    f"WITH {ITEMS} SELECT item, count(DISTINCT business) AS num_unique__business, count(DISTINCT flag) AS num_unique__flag, count(DISTINCT qty) AS num_unique__qty FROM items GROUP BY item",
)
def agg_num_unique(t):
    return synth.code_aggregates(t.items, "item", ["business", "flag", "qty"], ["num_unique"])


def _mode_sql(c):
    return (
        f"m_{c} AS (SELECT item, {c} AS v FROM (SELECT item, {c}, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, {c}) AS rn "
        f"FROM items WHERE {c} IS NOT NULL GROUP BY item, {c}) WHERE rn = 1)"
    )


@query(
    "agg_mode",
    f"WITH {ITEMS}, {_mode_sql('business')}, {_mode_sql('flag')}, {_mode_sql('qty')} "
    "SELECT item, m_business.v AS mode__business, m_flag.v AS mode__flag, m_qty.v AS mode__qty FROM m_business JOIN m_flag USING (item) JOIN m_qty USING (item)",
)
def agg_mode(t):
    return synth.code_aggregates(t.items, "item", ["business", "flag", "qty"], ["mode"])


@query(
    "agg_pearson",
    f"WITH {ITEMS} SELECT item, round(corr(qty, price) + 1e-9, 6) AS pearson__qty__price, round(corr(qty, disc) + 1e-9, 6) AS pearson__qty__disc, round(corr(price, disc) + 1e-9, 6) AS pearson__price__disc FROM items GROUP BY item",
)
def agg_pearson(t):
    feats = [synth.Feature("pearson", p) for p in (("qty", "price"), ("qty", "disc"), ("price", "disc"))]
    return rounded(synth.compute_features(t.items, "item", feats), 6, *[f.name for f in feats])


def _rank_sql(key: str, c: str) -> str:
    return f"rank() OVER (PARTITION BY {key} ORDER BY {c}) + (count(*) OVER (PARTITION BY {key}, {c}) - 1) / 2.0"


@query(
    "agg_spearman",
    f"WITH {ITEMS}, r AS (SELECT item, {_rank_sql('item', 'qty')} AS rq, {_rank_sql('item', 'price')} AS rp, {_rank_sql('item', 'disc')} AS rd FROM items) "
    "SELECT item, round(corr(rq, rp) + 1e-9, 6) AS spearman__qty__price, round(corr(rq, rd) + 1e-9, 6) AS spearman__qty__disc FROM r GROUP BY item",
)
def agg_spearman(t):
    out = synth.spearman_by_key(t.items, "item", [("qty", "price"), ("qty", "disc")])
    return rounded(out, 6, "spearman__qty__price", "spearman__qty__disc")


@query(
    "transform_features",
    f"WITH {ORDERS} SELECT row_id, day(t)::INT AS day__t, (isodow(t) - 1)::INT AS weekday__t, month(t)::INT AS month__t, year(t)::INT AS year__t, "
    "round((rank() OVER (ORDER BY amt) + (count(*) OVER (PARTITION BY amt) - 1) / 2.0) / count(*) OVER () + 1e-12, 9) AS percentile__amt, "
    "round((rank() OVER (ORDER BY key) + (count(*) OVER (PARTITION BY key) - 1) / 2.0) / count(*) OVER () + 1e-12, 9) AS percentile__key, "
    "round(2 * 3958.7613 * asin(least(sqrt(pow(sin(radians((row_id % 180 - 90) - (key % 180 - 90)) / 2), 2) + cos(radians(key % 180 - 90)) * "
    "cos(radians(row_id % 180 - 90)) * pow(sin(radians((row_id % 360 - 180) - (key % 360 - 180)) / 2), 2)), 1.0)) + 1e-9, 6) AS haversine__lat__to_lat FROM panel",
)
def transform_features(t):
    points = {"lat": F.col("key") % 180 - 90, "lon": F.col("key") % 360 - 180, "to_lat": F.col("row_id") % 180 - 90, "to_lon": F.col("row_id") % 360 - 180}
    out = t.orders_panel.withColumns(points | synth.transform_columns("t"))
    distances = synth.point_distances([("lat", "lon"), ("to_lat", "to_lon")])
    out = synth.percentile_ranks(out.withColumns(distances), ["amt", "key"])
    out = out.select("row_id", *synth.transform_columns("t"), *distances, "percentile__amt", "percentile__key")
    return rounded(rounded(out, 9, "percentile__amt", "percentile__key"), 6, *distances)


ROLES = Roles(
    keys=("item",), time="t", amounts=("qty", "price"), flags=("is_r", "deep"), codes=("flag",), points=(("lat", "lon"), ("to_lat", "to_lon"))
)
_PERCENTILE_SQL = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count({0}) OVER ()"


def _synth_rows(t):
    parent = t.supplier.select(F.col("s_suppkey").alias("business"), F.col("s_acctbal").alias("acct"), F.col("s_nationkey").cast("string").alias("nation"))
    places = {"lat": F.col("business") % 180 - 90, "lon": F.col("business") % 360 - 180, "to_lat": F.col("item") % 180 - 90, "to_lon": F.col("item") % 360 - 180}
    return t.items.drop("disc").withColumns(places), parent


def _synth_sql() -> str:
    numerics = ["qty", "price", "percentile__qty", "percentile__price", "haversine__lat__to_lat", "parent__acct"]
    bools = ["is_r", "deep"]
    codes = ["flag", "day__t", "weekday__t", "month__t", "year__t", "parent__nation"]
    base = (
        f"WITH {ITEMS.replace('items AS', 'raw AS')}, items AS (SELECT raw.*, s_acctbal AS parent__acct, s_nationkey::VARCHAR AS parent__nation, "
        f"{_PERCENTILE_SQL.format('qty')} AS percentile__qty, {_PERCENTILE_SQL.format('price')} AS percentile__price, "
        "2 * 3958.7613 * asin(least(sqrt(pow(sin(radians((item % 180 - 90) - (business % 180 - 90)) / 2), 2) + cos(radians(business % 180 - 90)) * "
        "cos(radians(item % 180 - 90)) * pow(sin(radians((item % 360 - 180) - (business % 360 - 180)) / 2), 2)), 1.0)) AS haversine__lat__to_lat, "
        "day(t)::INT AS day__t, (isodow(t) - 1)::INT AS weekday__t, month(t)::INT AS month__t, year(t)::INT AS year__t "
        "FROM raw LEFT JOIN supplier ON business = s_suppkey)"
    )
    cols = []
    for f in synth.plan_features(numerics, bools, codes):
        if f.agg in _AGG_SQL:
            cols.append(f"round({_AGG_SQL[f.agg].format(f.cols[0])} + 1e-7, 4) AS {f.name}")
        elif f.agg == "pearson":
            cols.append(f"round(corr({f.cols[0]}, {f.cols[1]}) + 1e-8, 5) AS {f.name}")
        elif f.agg == "percent_true":
            cols.append(f"round(avg({f.cols[0]}::INT) + 1e-9, 6) AS {f.name}")
        elif f.agg in ("all", "any"):
            cols.append(f"{'bool_and' if f.agg == 'all' else 'bool_or'}({f.cols[0]}) AS {f.name}")
        elif f.agg == "num_unique":
            cols.append(f"count(DISTINCT {f.cols[0]}) AS {f.name}")
    pairs = list(combinations(numerics, 2))
    ranks = ", ".join(
        f"{_rank_sql('item', c)} AS r_{c}" for c in numerics
    )
    rho = ", ".join(f"round(corr(r_{a}, r_{b}) + 1e-8, 5) AS spearman__{a}__{b}" for a, b in pairs)
    modes = ", ".join(_mode_sql(c) for c in codes)
    joins = " ".join(f"JOIN m_{c} USING (item)" for c in codes)
    picks = ", ".join(f"m_{c}.v AS mode__{c}" for c in codes)
    return (
        f"{base}, a AS (SELECT item, {', '.join(cols)} FROM items GROUP BY item), rk AS (SELECT item, {ranks} FROM items), "
        f"sp AS (SELECT item, {rho} FROM rk GROUP BY item), {modes} SELECT a.*, sp.* EXCLUDE (item), {picks} FROM a JOIN sp USING (item) {joins}"
    )


@query("feature_synthesis", _synth_sql())
def feature_synthesis(t):
    rows, parent = _synth_rows(t)
    out = synth.feature_synthesis(rows, "item", ROLES, parent, "business")
    digits = {}
    for c in out.columns:
        head = c.split("__")[0]
        if head in _AGG_SQL:
            digits[c] = 4
        elif head in ("pearson", "spearman"):
            digits[c] = 5
        elif head == "percent_true":
            digits[c] = 6
    for c, d in digits.items():
        out = rounded(out, d, c)
    return out


def _folded_gmean() -> synth.Folded:
    """Geometric mean of the positive values: a state of (sum of logarithms, number)."""

    def partial(values):
        logs = [math.log(v) for v in values if v is not None and v > 0]
        return sum(logs), len(logs)

    return synth.Folded(partial, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: math.exp(s[0] / s[1]) if s[1] else None)


@query(
    "agg_folded",
    "WITH p AS (SELECT user_id AS key, value - 50 AS amt FROM events) "
    "SELECT key, round(exp(avg(ln(CASE WHEN amt > 0 THEN amt END))) + 1e-9, 6) AS gmean__amt FROM p GROUP BY key",
)
def agg_folded(t):
    """An aggregate in the caller's own Python, folded from partial states."""
    synth.register_aggregate("gmean", 1, _folded_gmean())
    try:
        out = synth.compute_features(t.panel.withColumn("amt", F.col("amt") - 50), "key", [synth.Feature("gmean", ("amt",))])
    finally:
        del synth.AGGREGATES["gmean"]
    return rounded(out, 6, "gmean__amt")


_NAN_ITEMS = ITEMS.replace("l_extendedprice AS price", "CASE WHEN l_orderkey % 7 <> 0 AND l_partkey % 50 <> 0 THEN l_extendedprice END AS price")


@query(
    "agg_missing",
    f"WITH {_NAN_ITEMS}, m AS (SELECT item, price AS v, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, price) AS rn FROM items WHERE price IS NOT NULL GROUP BY item, price) "
    + "SELECT i.item, " + ", ".join(f"round({sql.format('price')} + 1e-7, 4) AS {f}__price" for f, sql in _AGG_SQL.items())
    + ", round(corr(qty, price) + 1e-8, 5) AS pearson__qty__price, count(DISTINCT price) AS num_unique__price, max(m.v) AS mode__price "
    "FROM items i LEFT JOIN m ON m.item = i.item AND rn = 1 GROUP BY i.item",
)
def agg_missing(t):
    """NaN is missing in every aggregate; a key without a value has null."""
    keep = (F.col("l_orderkey") % 7 != 0) & (F.col("l_partkey") % 50 != 0)
    rows = t.lineitem.select(
        F.col("l_partkey").alias("item"), F.col("l_quantity").alias("qty"),
        F.when(keep, F.col("l_extendedprice")).otherwise(F.lit(float("nan"))).alias("price"),
    )
    feats = [synth.Feature(f, ("price",)) for f in (*_AGG_SQL, "num_unique", "mode")] + [synth.Feature("pearson", ("qty", "price"))]
    out = synth.compute_features(rows, "item", feats)
    return rounded(rounded(out, 4, *[f"{f}__price" for f in _AGG_SQL]), 5, "pearson__qty__price")


@query(
    "attach_features",
    f"WITH {ORDERS}, f AS (SELECT key, round(avg(amt) + 1e-7, 4) AS mean__amt, count(*) AS n FROM panel GROUP BY key) SELECT row_id, key, t, amt, mean__amt, n FROM panel LEFT JOIN f USING (key)",
)
def attach_features(t):
    base = synth.entity_base(t.orders_panel.select("row_id", "key", "t", "amt"), "row_id", "t")
    feats = base.groupBy("key").agg(F.round(F.avg("amt") + 1e-7, 4).alias("mean__amt"), F.count("*").alias("n"), F.max("amt").alias("amt"))
    return synth.attach_features(base, feats, "key", drop=["target_id"])


@query("crosstab", f"WITH {ITEMS} SELECT flag, business, count(*) AS n_rows FROM items GROUP BY flag, business")
def crosstab(t):
    return synth.crosstab(t.items, "flag", "business")
