"""Cleaning, scalar functions, encoding, imputation and quantile features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar
from panelspark.operators import clean, encode, impute, quantile, synth
from panelspark.operators.neighbors import impute_knn
from panelspark.queries.base import DIM, ITEMS, MATRIX, ORDERS, PANEL, PANEL_LABEL, PANEL_NULLS, query, rounded

SPARSE = (
    "panel AS (SELECT event_id AS row_id, value AS amt, CASE WHEN event_id % 5 = 0 THEN value END AS rare, "
    "CASE WHEN event_id % 2 = 0 THEN value END AS half FROM events)"
)


@query(
    "drop_noise_rows",
    f"WITH {PANEL_NULLS}, s AS (SELECT *, CASE WHEN row_id % 3 = 0 THEN 'x' END AS mark FROM panel) SELECT * FROM s "
    "WHERE (code IS NOT DISTINCT FROM 'error' OR code IS NOT DISTINCT FROM 'signup' OR key IS NOT DISTINCT FROM 7) "
    "AND NOT (mark IS NOT DISTINCT FROM 'x')",
)
def drop_noise_rows(t):
    p = t.panel_nulls.withColumn("mark", F.when(F.col("row_id") % 3 == 0, "x"))
    return clean.drop_noise_rows(p, [("code", "error"), ("code", "signup"), ("key", 7)], [("mark", "x")])


@query(
    "label_multiclass",
    f"WITH {PANEL_NULLS} SELECT row_id, key, t, CASE WHEN amt > 150 THEN 3 WHEN code = 'purchase' THEN 2 WHEN code = 'error' THEN 1 ELSE 0 END AS target FROM panel",
)
def label_multiclass(t):
    tests = [F.col("code") == "error", F.col("code") == "purchase", F.col("amt") > 150]
    return clean.label_multiclass(t.panel_nulls, tests, drop=["amt", "code"])


@query(
    "label_binary",
    f"WITH {PANEL_LABEL}, n AS (SELECT row_id, target, CASE WHEN row_id % 11 <> 0 THEN code END AS code FROM panel) "
    "SELECT row_id, CASE WHEN target <> 0 THEN 1 ELSE 0 END AS y, CASE WHEN code IS NOT DISTINCT FROM 'view' THEN 0 ELSE 1 END AS f FROM n",
)
def label_binary(t):
    p = t.panel_label.withColumn("code", F.when(F.col("row_id") % 11 != 0, F.col("code")))
    return p.select("row_id", clean.collapse_label(F.col("target")).alias("y"), clean.code_label(F.col("code"), "view").alias("f"))


@query("drop_sparse_columns", f"WITH {SPARSE} SELECT row_id, amt, half FROM panel")
def drop_sparse_columns(t):
    p = t.panel.select(
        "row_id", "amt", F.when(F.col("row_id") % 5 == 0, F.col("amt")).alias("rare"), F.when(F.col("row_id") % 2 == 0, F.col("amt")).alias("half")
    )
    return clean.drop_sparse_columns(p, 0.7)


@query("drop_named_columns", f"WITH {PANEL} SELECT row_id, t, amt FROM panel")
def drop_named_columns(t):
    return clean.drop_named_columns(t.panel, ["key", "code", "absent"])


@query("drop_string_columns", f"WITH {ORDERS} SELECT row_id, key, t, amt FROM panel")
def drop_string_columns(t):
    return clean.drop_string_columns(t.orders_panel)


@query("select_columns_containing", "SELECT l_discount, l_tax, l_partkey, l_suppkey, l_orderkey FROM lineitem")
def select_columns_containing(t):
    return clean.select_columns_containing(t.lineitem, ["disc", "tax", "key", "ship"], without=["l_shipdate"])


@query(
    "null_profile",
    f"WITH {PANEL_NULLS}, c AS (SELECT count(*) FILTER (row_id IS NULL) AS a, count(*) FILTER (key IS NULL) AS b, count(*) FILTER (t IS NULL) AS c, "
    "count(*) FILTER (amt IS NULL) AS d, count(*) FILTER (code IS NULL) AS e FROM panel) "
    "SELECT 'row_id' AS \"column\", a AS n_null FROM c UNION ALL SELECT 'key', b FROM c UNION ALL SELECT 't', c FROM c UNION ALL SELECT 'amt', d FROM c "
    "UNION ALL SELECT 'code', e FROM c UNION ALL SELECT '__total__', a + b + c + d + e FROM c",
)
def null_profile(t):
    return clean.null_profile(t.panel_nulls)


@query("fill_constant", f"WITH {PANEL_NULLS} SELECT row_id, key, coalesce(amt, 0) AS amt, coalesce(code, 'Not exist') AS code FROM panel")
def fill_constant(t):
    return clean.fill_constant(t.panel_nulls.drop("t"), texts=["code"])


@query(
    "coerce_numeric",
    "SELECT o_orderkey, o_totalprice, trunc(o_totalprice)::BIGINT AS price_text, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS cust_text, (o_orderstatus = 'F')::INT::BIGINT AS closed FROM orders",
)
def coerce_numeric(t):
    o = t.orders
    df = o.select(
        "o_orderkey", "o_totalprice", F.col("o_totalprice").cast("string").alias("price_text"),
        F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("cust_text"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )
    return clean.coerce_numeric(df)


@query(
    "cast_by_role",
    "SELECT o_orderkey, (o_custkey % 2 = 1) AS odd, o_totalprice AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders",
)
def cast_by_role(t):
    df = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 2).alias("odd"), F.col("o_totalprice").cast("string").alias("price"),
        F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
    )
    return clean.cast_by_role(df, bools=["odd"], floats=["price"], ints=["cust"])


@query("narrow_types", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS l_quantity, l_discount, l_shipdate FROM lineitem")
def narrow_types(t):
    out = clean.narrow_types(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"))
    # the chosen types depend on the data; compare the values
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("l_orderkey", "l_linenumber", "l_quantity")})


@query("value_counts", f"WITH {PANEL_LABEL} SELECT target, count(*) AS n_rows FROM panel GROUP BY target")
def value_counts(t):
    return clean.value_counts(t.panel_label, "target")


# ---- scalar ------------------------------------------------------------------------------------


@query("amt_log", f"WITH {PANEL_NULLS} SELECT row_id, amt, round(log10(abs(amt - 50) + 1) + 1e-12, 9) AS amt_log FROM panel")
def amt_log(t):
    return t.panel_nulls.select("row_id", "amt", F.round(scalar.amt_log(F.col("amt") - 50) + 1e-12, 9).alias("amt_log"))


@query("add_sign", f"WITH {PANEL_NULLS} SELECT row_id, CASE WHEN amt - 50 < 0 THEN 1 ELSE 0 END AS amt_sign FROM panel")
def add_sign(t):
    return t.panel_nulls.select("row_id", scalar.add_sign(F.col("amt") - 50).alias("amt_sign"))


@query(
    "log_transform",
    f"WITH {PANEL_NULLS} SELECT row_id, round(CASE WHEN amt - 50 > -1 THEN log10(amt - 50 + 1) END + 1e-12, 9) AS log_amt FROM panel",
)
def log_transform(t):
    return t.panel_nulls.select("row_id", F.round(scalar.log_transform(F.col("amt") - 50) + 1e-12, 9).alias("log_amt"))


@query(
    "de_log_transform",
    f"WITH {PANEL_NULLS} SELECT row_id, round_even(pow(10.0, key / 50.0) - 1, 2) AS log2_key FROM panel",
)
def de_log_transform(t):
    return t.panel_nulls.select("row_id", scalar.de_log_transform(F.col("key") / 50.0).alias("log2_key"))


@query(
    "business_code_flag",
    "WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN lpad(((o_orderkey * 7919) % 10000000)::VARCHAR, 10, '0') END AS id FROM orders) "
    "SELECT o_orderkey, id, CASE WHEN substr(id, 4, 2) IN ('82', '83') THEN 1 ELSE 0 END AS flag FROM i",
)
def business_code_flag(t):
    ident = F.lpad(((F.col("o_orderkey") * 7919) % 10000000).cast("string"), 10, "0")
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, ident).alias("id"))
    return o.withColumn("flag", scalar.business_code_flag(F.col("id")))


@query(
    "parse_event_time",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END::TIMESTAMP AS t FROM events",
)
def parse_event_time(t):
    full, day, compact = (F.date_format("ts", f) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd"))
    text = (
        F.when(F.col("event_id") % 10 == 0, "unknown").when(F.col("event_id") % 6 == 0, day).when(F.col("event_id") % 3 == 0, compact).otherwise(full)
    )
    return t.events.select("event_id", scalar.parse_event_time(text).alias("t"))


@query(
    "date_parts",
    f"WITH {PANEL} SELECT row_id, day(t)::INT AS day, (isodow(t) - 1)::INT AS weekday, month(t)::INT AS month, year(t)::INT AS year FROM panel",
)
def date_parts(t):
    return t.panel.select("row_id", *[c.alias(n) for n, c in scalar.date_parts(F.col("t")).items()])


@query(
    "haversine_distance",
    "WITH g AS (SELECT c_custkey, c_custkey % 180 - 90 AS lat, c_custkey % 360 - 180 AS lon, c_nationkey * 3 - 36 AS lat2, c_nationkey * 7 - 84 AS lon2 FROM customer) "
    "SELECT c_custkey, round(2 * 3958.7613 * asin(least(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * "
    "pow(sin(radians(lon2 - lon) / 2), 2)), 1.0)) + 1e-7, 4) AS miles FROM g",
)
def haversine_distance(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    d = scalar.haversine_distance(k % 180 - 90, k % 360 - 180, n * 3 - 36, n * 7 - 84)
    return t.customer.select("c_custkey", F.round(d + 1e-7, 4).alias("miles"))


@query(
    "percentile_rank",
    f"WITH {PANEL_NULLS}, r AS (SELECT row_id, amt, rank() OVER (ORDER BY amt) + (count(*) OVER (PARTITION BY amt) - 1) / 2.0 AS r FROM panel WHERE amt IS NOT NULL) "
    "SELECT p.row_id, round(r.r / (SELECT count(amt) FROM panel) + 1e-12, 9) AS pct FROM panel p LEFT JOIN r USING (row_id)",
)
def percentile_rank(t):
    return rounded(synth.percentile_rank(t.panel_nulls, "amt", "pct").select("row_id", "pct"), 9, "pct")


# ---- encoding ----------------------------------------------------------------------------------


@query(
    "one_hot_list",
    f"WITH {PANEL_NULLS} SELECT row_id, key, coalesce(code = 'error', false) AS code_error, coalesce(code = 'view', false) AS code_view, "
    "coalesce(code = 'absent', false) AS code_absent FROM panel",
)
def one_hot_list(t):
    return encode.one_hot_list(t.panel_nulls.select("row_id", "key", "code"), "code", ["error", "view", "absent"])


@query(
    "frequency_encode",
    f"WITH {PANEL_NULLS}, c AS (SELECT code, count(*) / (SELECT count(*) FROM panel) AS freq FROM panel WHERE code IS NOT NULL GROUP BY code), "
    "k AS (SELECT key, count(*) / (SELECT count(*) FROM panel) AS freq FROM panel GROUP BY key) "
    "SELECT row_id, round(k.freq + 1e-12, 9) AS key, round(c.freq + 1e-12, 9) AS code FROM panel LEFT JOIN c USING (code) LEFT JOIN k ON panel.key = k.key",
)
def frequency_encode(t):
    out = encode.frequency_encode(t.panel_nulls.select("row_id", "key", "code"), ["key", "code"])
    return rounded(out, 9, "key", "code")


_CODES = (
    "firsts AS (SELECT code, min(row_id) AS f0 FROM src WHERE code IS NOT NULL GROUP BY code), "
    "codes AS (SELECT code, row_number() OVER (ORDER BY f0) - 1 AS n FROM firsts)"
)


@query(
    "ordinal_first_seen",
    f"WITH {PANEL_NULLS}, top AS (SELECT code FROM panel WHERE code IS NOT NULL GROUP BY code ORDER BY count(*) DESC, code LIMIT 1), "
    f"src AS (SELECT row_id, coalesce(code, (SELECT code FROM top)) AS code FROM panel), {_CODES} "
    "SELECT row_id, code, n::INT AS code_code FROM src JOIN codes USING (code)",
)
def ordinal_first_seen(t):
    return encode.ordinal_first_seen(t.panel_nulls.select("row_id", "code"), "code", "row_id")


@query(
    "factorize",
    f"WITH {PANEL_NULLS}, src AS (SELECT row_id, code FROM panel), {_CODES} "
    "SELECT row_id, code, coalesce(n, -1)::INT AS code_code FROM src LEFT JOIN codes USING (code)",
)
def factorize(t):
    return encode.factorize(t.panel_nulls.select("row_id", "code"), "code", "row_id")


# ---- imputation --------------------------------------------------------------------------------


@query("impute_mean", f"WITH {PANEL_NULLS} SELECT row_id, round(coalesce(amt, avg(amt) OVER ()) + 1e-9, 6) AS amt FROM panel")
def impute_mean(t):
    return rounded(impute.impute(t.panel_nulls.select("row_id", "amt"), ["amt"], "mean"), 6, "amt")


@query("impute_median", f"WITH {PANEL_NULLS} SELECT row_id, round(coalesce(amt, median(amt) OVER ()) + 1e-9, 6) AS amt FROM panel")
def impute_median(t):
    return rounded(impute.impute(t.panel_nulls.select("row_id", "amt"), ["amt"], "median"), 6, "amt")


def _top_sql(col: str, src: str = "panel") -> str:
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


@query("impute_mode", f"WITH {PANEL_NULLS} SELECT row_id, coalesce(amt, {_top_sql('amt')}) AS amt, coalesce(code, {_top_sql('code')}) AS code FROM panel")
def impute_mode(t):
    return impute.impute(t.panel_nulls.select("row_id", "amt", "code"), ["amt", "code"], "most")


@query(
    "impute_linear",
    "WITH p AS (SELECT l_orderkey * 100000 + l_partkey AS k, l_quantity AS q, l_extendedprice AS price, "
    "CASE WHEN (l_orderkey + l_partkey) % 7 <> 0 THEN l_extendedprice END AS y FROM lineitem), "
    "m AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM p WHERE y IS NOT NULL) "
    "SELECT k, q, round(coalesce(y, a + b * q) + 1e-6, 3) AS y FROM p, m",
)
def impute_linear(t):
    p = t.lineitem.select(
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("k"), F.col("l_quantity").alias("q"),
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % 7 != 0, F.col("l_extendedprice")).alias("y"),
    )
    return rounded(impute.impute(p, ["q", "y"], "linear_reg", "k"), 3, "y")


@query(
    "impute_linear_saved",
    "WITH p AS (SELECT l_orderkey * 100000 + l_partkey AS k, l_quantity AS q, l_extendedprice AS price, l_orderkey % 3 = 0 AS later, "
    "CASE WHEN (l_orderkey + l_partkey) % 7 <> 0 THEN l_extendedprice END AS y FROM lineitem), "
    "m AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM p WHERE y IS NOT NULL AND NOT later), "
    "mq AS (SELECT avg(q) AS mq FROM p WHERE NOT later), "
    "late AS (SELECT k, CASE WHEN k % 5 <> 0 THEN q ELSE mq END AS q, y FROM p, mq WHERE later) "
    "SELECT k, round(q + 1e-7, 4) AS q, round(coalesce(y, a + b * q) + 1e-6, 3) AS y FROM late, m",
)
def impute_linear_saved(t):
    """Fitted on two thirds of the orders, kept, and applied to the last third, where quantities are missing too."""
    p = t.lineitem.select(
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("k"), F.col("l_quantity").alias("q"), (F.col("l_orderkey") % 3 == 0).alias("later"),
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % 7 != 0, F.col("l_extendedprice")).alias("y"),
    )
    path = t.scratch("chain")
    impute.fit_linear(p.where("not later").drop("later"), ["q", "y"], "k", path)
    late = p.where("later").select("k", F.when(F.col("k") % 5 != 0, F.col("q")).alias("q"), "y")
    return rounded(rounded(impute.apply_saved(late, path), 3, "y"), 4, "q")


def _gappy_matrix(t):
    return t.matrix.withColumns(
        {"e2": F.when(F.col("row_id") % 9 != 0, F.col("e2")), "e5": F.when(F.col("row_id") % 6 != 0, F.col("e5"))}
    ).drop("label")


@query("impute_forest")
def impute_forest(t):
    cols = ["e0", "e1", "e2", "e5"]
    out = impute.impute(_gappy_matrix(t).select("row_id", *cols), cols, "random_forest")
    return rounded(out, 6, *cols)


@query("impute_forest_code")
def impute_forest_code(t):
    p = t.panel_nulls.select("row_id", "key", F.hour("t").alias("hour"), F.col("row_id").alias("seq"), "code")
    return impute.impute(p, ["key", "hour", "seq", "code"], "random_forest_code")


_GAP = (
    f"WITH {MATRIX}, g AS (SELECT * REPLACE (CASE WHEN row_id % 9 <> 0 THEN e2 END AS e2, CASE WHEN row_id % 6 <> 0 THEN e5 END AS e5) FROM matrix)"
)


def _gap_dist(cols):
    both = [f"(CASE WHEN q.{c} IS NULL OR d.{c} IS NULL THEN 0 ELSE (q.{c} - d.{c}) * (q.{c} - d.{c}) END)" for c in cols]
    seen = [f"(CASE WHEN q.{c} IS NULL OR d.{c} IS NULL THEN 0 ELSE 1 END)" for c in cols]
    return f"sqrt(({' + '.join(both)}) * {len(cols)} / ({' + '.join(seen)}))"


def _knn_fill(c):
    cols = [f"e{i}" for i in range(DIM)]
    return (
        f"n_{c} AS (SELECT q.row_id, d.{c} AS v, row_number() OVER (PARTITION BY q.row_id ORDER BY {_gap_dist(cols)}, d.row_id) AS rn "
        f"FROM g q, g d WHERE q.{c} IS NULL AND d.{c} IS NOT NULL), f_{c} AS (SELECT row_id, avg(v) AS v FROM n_{c} WHERE rn <= 3 GROUP BY row_id)"
    )


@query(
    "impute_knn",
    f"{_GAP}, {_knn_fill('e2')}, {_knn_fill('e5')} SELECT g.row_id, round(coalesce(g.e2, f_e2.v) + 1e-9, 6) AS e2, round(coalesce(g.e5, f_e5.v) + 1e-9, 6) AS e5 "
    "FROM g LEFT JOIN f_e2 ON g.row_id = f_e2.row_id LEFT JOIN f_e5 ON g.row_id = f_e5.row_id",
)
def impute_knn_query(t):
    out = impute_knn(_gappy_matrix(t), [f"e{i}" for i in range(DIM)])
    return rounded(out.select("row_id", "e2", "e5"), 6, "e2", "e5")


@query(
    "impute_codes",
    f"WITH {PANEL_NULLS}, s AS (SELECT row_id, code, CASE WHEN row_id % 13 <> 0 THEN key END AS key, CASE WHEN row_id % 17 <> 0 THEN date_trunc('day', t)::DATE END AS d, "
    f"CASE WHEN row_id % 5 <> 0 THEN code END AS note FROM panel) SELECT row_id, coalesce(code, {_top_sql('code', 's')}) AS code, "
    f"coalesce(key, {_top_sql('key', 's')}) AS key, coalesce(d, {_top_sql('d', 's')}) AS d, coalesce(note, 'Not exist') AS note FROM s",
)
def impute_codes(t):
    s = t.panel_nulls.select(
        "row_id", "code", F.when(F.col("row_id") % 13 != 0, F.col("key")).alias("key"),
        F.when(F.col("row_id") % 17 != 0, F.to_date("t")).alias("d"), F.when(F.col("row_id") % 5 != 0, F.col("code")).alias("note"),
    )
    return impute.impute_codes(s, ["code", "key", "d"], ["note"], t.scratch("codes"))


@query(
    "impute_amounts",
    "WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 10 END AS tenth FROM orders) "
    "SELECT o_orderkey, round(coalesce(price, median(price) OVER ()) + 1e-7, 4) AS price, round(coalesce(tenth, median(tenth) OVER ()) + 1e-7, 4) AS tenth FROM s",
)
def impute_amounts(t):
    s = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 10).alias("tenth"),
    )
    return rounded(impute.impute_amounts(s, ["price", "tenth"], "median", t.scratch("amounts"), "o_orderkey"), 4, "price", "tenth")


@query(
    "impute_remaining",
    f"WITH {PANEL_NULLS} SELECT row_id, key, t, coalesce(amt, {_top_sql('amt')}) AS amt, coalesce(code, {_top_sql('code')}) AS code FROM panel",
)
def impute_remaining(t):
    return impute.impute_remaining(t.panel_nulls)


# ---- quantiles ---------------------------------------------------------------------------------

_Q = (
    "q AS (SELECT quantile_cont(price, 0.25) AS price_25, quantile_cont(price, 0.5) AS price_50, quantile_cont(price, 0.75) AS price_75, "
    "quantile_cont(qty, 0.25) AS qty_25, quantile_cont(qty, 0.5) AS qty_50, quantile_cont(qty, 0.75) AS qty_75 FROM items)"
)


@query(
    "quantile_thresholds",
    f"WITH {ITEMS}, {_Q} SELECT item, business, price, qty, round(price_25 + 1e-7, 4) AS price_25, round(price_50 + 1e-7, 4) AS price_50, round(price_75 + 1e-7, 4) AS price_75, "
    "round(qty_25 + 1e-7, 4) AS qty_25, round(qty_50 + 1e-7, 4) AS qty_50, round(qty_75 + 1e-7, 4) AS qty_75 FROM items, q",
)
def quantile_thresholds(t):
    out = quantile.quantile_thresholds(t.items.select("item", "business", "price", "qty"), ["price", "qty"])
    return rounded(out, 4, *[f"{c}_{q}" for c in ("price", "qty") for q in (25, 50, 75)])


def _bands(c):
    tests = {"1st": f"{c} <= {c}_25", "2nd": f"{c} > {c}_25 AND {c} <= {c}_50", "3rd": f"{c} > {c}_50 AND {c} <= {c}_75", "4th": f"{c} > {c}_75"}
    return ", ".join(f"CASE WHEN {v} THEN 1 ELSE 0 END AS {c}_{k}_yn" for k, v in tests.items())


@query("quantile_bands", f"WITH {ITEMS}, {_Q} SELECT item, business, price, qty, {_bands('price')}, {_bands('qty')} FROM items, q")
def quantile_bands(t):
    out = quantile.quantile_bands(t.items.select("item", "business", "price", "qty"), ["price", "qty"])
    return out.drop(*[f"{c}_{q}" for c in ("price", "qty") for q in (25, 50, 75)])
