"""Scaling, splits, draws, neighbours and class rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import resample, sampling, scale
from panelspark.operators.neighbors import knn_join
from panelspark.queries.base import (
    DIM, MATRIX, ORACLES, ORDERS, PANEL_LABEL, VECTORS, hash_long_sql, hash_sql, hash_unit_sql, query, rounded,
)
from panelspark.queries.tables import KFOLD_SQL
from panelspark.session import materialize

SCALED = ("price", "qty", "flat")
_WIDE = "w AS (SELECT l_orderkey, l_partkey, l_extendedprice AS price, l_quantity AS qty, 3.0::DOUBLE AS flat FROM lineitem)"


def _wide(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.lit(3.0).alias("flat")
    )


_SCALE_SQL = {
    "standard": ("avg({0})", "stddev_pop({0})"),
    "minmax": ("min({0})", "max({0}) - min({0})"),
    "robust": ("median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"),
}


def _params_sql(kind: str, cols, src: str) -> str:
    parts = []
    for c in cols:
        center, spread = (e.format(c) for e in _SCALE_SQL[kind])
        parts.append(f"{center} AS c_{c}, coalesce(nullif({spread}, 0), 1) AS s_{c}")
    return f"par AS (SELECT {', '.join(parts)} FROM {src})"


def _scaled_sql(cols) -> str:
    return ", ".join(f"round(({c} - c_{c}) / s_{c} + 1e-9, 6) AS {c}" for c in cols)


def scale_query(kind: str):
    @query(f"scale_{kind}", f"WITH {_WIDE}, {_params_sql(kind, SCALED, 'w')} SELECT l_orderkey, l_partkey, {_scaled_sql(SCALED)} FROM w, par")
    def run(t):
        return rounded(scale.scale(_wide(t), list(SCALED), kind), 6, *SCALED)


for _k in scale.KINDS:
    scale_query(_k)

_E = tuple(f"e{i}" for i in range(DIM))


def _cut_sql(table: str, ident: str, group: str | None, take: str) -> str:
    """Rows of ``table`` with ``rn`` in hash order, ``n`` and ``take`` per group."""
    part = f"PARTITION BY {group} " if group else ""
    over = f"({part}ORDER BY {hash_sql(ident)}, {ident})"
    count = f"count(*) OVER ({part.strip()})"
    return f"ranked AS (SELECT *, row_number() OVER {over} AS rn, {count} AS n FROM {table}), cut AS (SELECT *, {take} AS take FROM ranked)"


@query(
    "fit_apply_scaler",
    f"WITH {MATRIX}, {_cut_sql('matrix', 'row_id', 'label', 'round(0.2 * n)')}, parts AS (SELECT *, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS role FROM cut), "
    f"{_params_sql('standard', _E, 'parts WHERE role = $$train$$')} SELECT row_id, role, {_scaled_sql(_E)} FROM parts, par",
)
def fit_apply_scaler(t):
    split = sampling.stratified_split(t.matrix.select("row_id", "label", *_E), "label", "row_id").drop("label")
    train, test = scale.fit_apply_scaler(
        split.where("role = 'train'"), split.where("role = 'test'"), list(_E), "standard", t.scratch("scaler")
    )
    return rounded(train.unionByName(test), 6, *_E)


# ---- splits ------------------------------------------------------------------------------------


@query(
    "stratified_split",
    f"WITH {PANEL_LABEL}, {_cut_sql('panel', 'row_id', 'target', 'round(0.2 * n)')} SELECT row_id, target, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS role FROM cut",
)
def stratified_split(t):
    return sampling.stratified_split(t.panel_label.select("row_id", "target"), "target", "row_id")


@query(
    "random_split_plain",
    f"WITH {ORDERS}, {_cut_sql('panel', 'row_id', None, 'round(0.2 * n)')} SELECT row_id, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS role FROM cut",
)
def random_split_plain(t):
    return sampling.random_split_plain(t.orders_panel.select("row_id"), "row_id")


@query("stratified_kfold", f"WITH {PANEL_LABEL}{KFOLD_SQL.format(k=10)} SELECT row_id, target, fold::INT AS fold FROM folds")
def stratified_kfold(t):
    return sampling.stratified_kfold(t.panel_label.select("row_id", "target"), "target", "row_id", 10)


def _nested_sql(role: str) -> str:
    fold = KFOLD_SQL.format(k=5)
    for name in ("first", "laid", "alloc", "bounds", "pos", "folds"):
        fold = fold.replace(f" {name} AS", f" {name}_{role} AS").replace(f"JOIN {name} ", f"JOIN {name}_{role} ").replace(f"FROM {name} ", f"FROM {name}_{role} ").replace(f"FROM {name})", f"FROM {name}_{role})")
    return fold.replace("FROM panel", f"FROM {role}s")


@query(
    "nested_holdout_kfold",
    f"WITH {PANEL_LABEL}, {_cut_sql('panel', 'row_id', 'target', 'round(0.2 * n)')}, "
    "trains AS (SELECT row_id, target FROM cut WHERE rn > take), tests AS (SELECT row_id, target FROM cut WHERE rn <= take)"
    + _nested_sql("train") + _nested_sql("test")
    + " SELECT row_id, target, 'train' AS role, fold::INT AS fold FROM folds_train UNION ALL SELECT row_id, target, 'test', fold::INT FROM folds_test",
)
def nested_holdout_kfold(t):
    return sampling.nested_holdout_kfold(t.panel_label.select("row_id", "target"), "target", "row_id", 5)


@query(
    "downsample_majority",
    f"WITH {PANEL_LABEL}, {_cut_sql('panel', 'row_id', 'target', 'CASE WHEN target = 0 THEN round(0.3 * n) ELSE n END')} SELECT row_id, target, amt FROM cut WHERE rn <= take",
)
def downsample_majority(t):
    return sampling.downsample_majority(t.panel_label.select("row_id", "target", "amt"), "target", "row_id")


@query(
    "sample_fraction",
    f"WITH {ORDERS}, {_cut_sql('panel', 'row_id', None, 'round(0.3 * n)')} SELECT row_id, amt FROM cut WHERE rn <= take",
)
def sample_fraction(t):
    return sampling.sample_fraction(t.orders_panel.select("row_id", "amt"), "row_id")


def _draw_sql(table: str, ident: str, label: str, want: str) -> str:
    """(label, draw, ident): ``want`` is a relation (label, m)."""
    return (
        f"pool AS (SELECT {ident} AS ident, {label} AS cls, row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(ident)}, {ident}) AS rn, "
        f"count(*) OVER (PARTITION BY {label}) AS n FROM {table}), want AS ({want}), "
        "draws AS (SELECT cls, unnest(range(m)) AS draw FROM want), sizes AS (SELECT DISTINCT cls, n FROM pool), "
        f"picks AS (SELECT d.cls, draw, {hash_long_sql(hash_sql('d.cls', 'draw'))} % n + 1 AS rn FROM draws d JOIN sizes s ON d.cls = s.cls), "
        "drawn AS (SELECT p.cls, p.draw, pool.ident FROM picks p JOIN pool ON p.cls = pool.cls AND p.rn = pool.rn)"
    )


@query(
    "class_balanced_bootstrap",
    f"WITH {PANEL_LABEL}, " + _draw_sql("panel", "row_id", "target", "SELECT DISTINCT target AS cls, (SELECT count(*) // count(DISTINCT target) FROM panel) AS m FROM panel")
    + " SELECT cls::INT AS target, draw, ident AS row_id FROM drawn",
)
def class_balanced_bootstrap(t):
    return sampling.class_balanced_bootstrap(t.panel_label.select("row_id", "target"), "target", "row_id")


@query(
    "random_batch",
    "WITH " + _draw_sql("orders", "o_orderkey", "'all'", "SELECT 'all' AS cls, (SELECT count(*) // 10 FROM orders) AS m") + " SELECT ident AS o_orderkey, draw FROM drawn",
)
def random_batch(t):
    o = t.orders.select("o_orderkey")
    return sampling.random_batch(o, "o_orderkey", o.count() // 10)


# ---- neighbours and rebalancing ----------------------------------------------------------------

_NN = (
    "nn AS (SELECT q.id, d.id AS nn_id, list_distance(q.vec, d.vec) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, d.vec), d.id) AS rk "
    "FROM {q} q, {d} d WHERE q.id <> d.id)"
)


@query(
    "knn_join",
    "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), "
    + _NN.format(q="v", d="v")
    + " SELECT id, nn_id, round(dist + 1e-9, 6) AS dist, rk::INT AS rank FROM nn WHERE rk <= 5",
)
def knn(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return rounded(knn_join(v, v, 5, exclude_self=True), 6, "dist")


_COUNTS = "counts AS (SELECT label, count(*) AS n FROM vectors GROUP BY label), top AS (SELECT max(n) AS m FROM counts)"
_OVER_SUMMARY = (
    f"WITH {VECTORS}, {_COUNTS} SELECT label, false AS synthetic, n AS n_rows, 64 AS dims FROM counts "
    "UNION ALL SELECT label, true, m - n, 64 FROM counts, top WHERE n < m"
)


def _over_summary(df):
    return df.groupBy("label", "synthetic").agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).alias("dims"))


@query(
    "over_random",
    f"WITH {VECTORS}, {_COUNTS}, " + _draw_sql("vectors", "id", "label", "SELECT label AS cls, m - n AS m FROM counts, top WHERE n < m")
    + " SELECT id, label, false AS synthetic, 1::BIGINT AS copies FROM vectors UNION ALL SELECT ident, cls, true, count(*) FROM drawn GROUP BY ident, cls",
)
def over_random(t):
    return resample.over_random(t.vectors).groupBy("id", "label", "synthetic").agg(F.count("*").alias("copies"))


def _interpolated_sql(seeds: str) -> str:
    """SMOTE rows of class 1 in SQL: ``seeds`` gives (id) to draw from."""
    return (
        "m AS (SELECT * FROM vectors WHERE label = 1), " + _NN.format(q="m", d="m")
        + f", seeds AS ({seeds}), " + _draw_sql("seeds", "id", "'all'", "SELECT 'all' AS cls, (SELECT max(n) - min(n) FROM counts) AS m")
        + f", s AS (SELECT ident AS id, draw, least(5, (SELECT count(*) - 1 FROM m)) AS k, {hash_long_sql(hash_sql('ident', 'draw', chr(39) + 'nn' + chr(39)))} AS hn, "
        f"{hash_unit_sql(hash_sql('ident', 'draw', chr(39) + 'lambda' + chr(39)))} AS lam FROM drawn), "
        "pair AS (SELECT s.*, a.vec AS av, b.vec AS bv FROM s JOIN nn ON s.id = nn.id AND nn.rk = s.hn % s.k + 1 JOIN m a ON a.id = s.id JOIN m b ON b.id = nn.nn_id)"
    )


_NEAR = (
    "near AS (SELECT q.id, d.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, d.vec), d.id) AS rk FROM vectors q, vectors d WHERE q.id <> d.id AND q.label = 1)"
)
_DANGER = "SELECT id FROM near WHERE rk <= 10 GROUP BY id HAVING count(*) FILTER (label <> 1) >= count(*) / 2 AND count(*) FILTER (label <> 1) < count(*)"


@query(
    "over_borderline_smote",
    f"WITH {VECTORS}, {_COUNTS}, {_NEAR}, " + _interpolated_sql(_DANGER)
    + " SELECT " + ", ".join(f"round(av[{i}] + lam * (bv[{i}] - av[{i}]) + 1e-9, 6) AS v{i}" for i in range(1, 9)) + " FROM pair",
)
def over_borderline_smote(t):
    out = resample.over_smote_borderline(t.vectors).where("synthetic")
    return rounded(out.select(*[F.col("vec")[i - 1].alias(f"v{i}") for i in range(1, 9)]), 6, *[f"v{i}" for i in range(1, 9)])


@query("over_svm_smote", _OVER_SUMMARY)
def over_svm_smote(t):
    return _over_summary(resample.over_smote_svm(t.vectors))


def _nominal(t):
    """Four numeric coordinates, then two codes."""
    v = t.vectors
    codes = F.array((F.col("id") % 3).cast("double"), (F.col("vec")[7] > 0).cast("double"))
    return v.withColumn("vec", F.concat(F.slice("vec", 1, 4), codes))


def _values(n: int) -> str:
    return ", ".join(f"round(av[{i}] + lam * (bv[{i}] - av[{i}]) + 1e-9, 6) AS v{i}" for i in range(1, n + 1))


_CODED = "nv AS (SELECT id, label, list_concat(vec[1:4], [(id % 3)::DOUBLE, (vec[8] > 0)::INT::DOUBLE]) AS vec FROM vectors)"
_CODED_DIST = (
    "sqrt(" + " + ".join(f"(q.vec[{i}] - d.vec[{i}]) * (q.vec[{i}] - d.vec[{i}])" for i in range(1, 5))
    + " + penalty * (q.vec[5] <> d.vec[5])::INT + penalty * (q.vec[6] <> d.vec[6])::INT)"
)


@query(
    "over_smote_nc",
    f"WITH {VECTORS}, {_COUNTS}, {_CODED}, "
    + _interpolated_sql("SELECT id FROM m").replace("FROM vectors WHERE label = 1", "FROM nv WHERE label = 1").replace(
        _NN.format(q="m", d="m"),
        f"spread AS (SELECT list_sort([{', '.join(f'stddev_pop(vec[{i}])' for i in range(1, 5))}]) AS s FROM m), "
        "pen AS (SELECT pow((s[2] + s[3]) / 2, 2) / 2 AS penalty FROM spread), "
        f"nn AS (SELECT q.id, d.id AS nn_id, row_number() OVER (PARTITION BY q.id ORDER BY {_CODED_DIST}, d.id) AS rk FROM m q, m d, pen WHERE q.id <> d.id)",
    )
    + ", vote AS (SELECT n.id, i, vec[i] AS v, count(*) AS c FROM nn n JOIN m ON m.id = n.nn_id, (SELECT unnest([5, 6]) AS i) WHERE rk <= 5 GROUP BY ALL), "
    "won AS (SELECT id, i, v, row_number() OVER (PARTITION BY id, i ORDER BY c DESC, v) AS rn FROM vote) "
    f"SELECT {_values(4)}, a.v AS c5, b.v AS c6 "
    "FROM pair JOIN won a ON a.id = pair.id AND a.i = 5 AND a.rn = 1 JOIN won b ON b.id = pair.id AND b.i = 6 AND b.rn = 1",
)
def over_smote_nc(t):
    """The synthetic rows themselves: interpolated numbers, and the neighbours' most frequent codes."""
    out = resample.over_smote_nc(_nominal(t), 4).where("synthetic")
    out = out.select(*[F.col("vec")[i - 1].alias(f"v{i}") for i in range(1, 5)], F.col("vec")[4].alias("c5"), F.col("vec")[5].alias("c6"))
    return rounded(out, 6, *[f"v{i}" for i in range(1, 5)])


@query(
    "over_adasyn",
    f"WITH {VECTORS}, {_COUNTS}, {_NEAR}, r AS (SELECT id, count(*) FILTER (label <> 1) / 5.0 AS r FROM near WHERE rk <= 5 GROUP BY id), "
    "g AS (SELECT id, round_even(r / (SELECT sum(r) FROM r) * (SELECT max(n) - min(n) FROM counts), 0)::BIGINT AS made FROM r), "
    "m AS (SELECT * FROM vectors WHERE label = 1), " + _NN.format(q="m", d="m")
    + f", s AS (SELECT id, draw, least(5, (SELECT count(*) - 1 FROM m)) AS k, {hash_long_sql(hash_sql('id', 'draw', chr(39) + 'nn' + chr(39)))} AS hn, "
    f"{hash_unit_sql(hash_sql('id', 'draw', chr(39) + 'lambda' + chr(39)))} AS lam FROM (SELECT id, unnest(range(made)) AS draw FROM g)), "
    "pair AS (SELECT s.*, a.vec AS av, b.vec AS bv FROM s JOIN nn ON s.id = nn.id AND nn.rk = s.hn % s.k + 1 JOIN m a ON a.id = s.id JOIN m b ON b.id = nn.nn_id) "
    f"SELECT {_values(8)} FROM pair",
)
def over_adasyn(t):
    """The synthetic rows themselves, as many per seed as its share of foreign neighbours asks for."""
    out = resample.over_adasyn(t.vectors).where("synthetic")
    return rounded(out.select(*[F.col("vec")[i - 1].alias(f"v{i}") for i in range(1, 9)]), 6, *[f"v{i}" for i in range(1, 9)])


@query(
    "under_random",
    f"WITH {VECTORS}, {_COUNTS}, {_cut_sql('vectors', 'id', 'label', '(SELECT min(n) FROM counts)')} SELECT id, label FROM cut WHERE rn <= take",
)
def under_random(t):
    return resample.under_random(t.vectors.select("id", "label"))


def _tomek_sql(src: str) -> str:
    return (
        f"t1 AS (SELECT q.id, q.label, d.id AS nn_id, d.label AS nn_label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, d.vec), d.id) AS rk FROM {src} q, {src} d WHERE q.id <> d.id), "
        "t2 AS (SELECT * FROM t1 WHERE rk = 1), links AS (SELECT a.id FROM t2 a JOIN t2 b ON a.nn_id = b.id AND b.nn_id = a.id WHERE a.label <> a.nn_label AND a.label = 0)"
    )


@query("under_tomek", f"WITH {VECTORS}, {_tomek_sql('vectors')} SELECT id, label FROM vectors WHERE id NOT IN (SELECT id FROM links)")
def under_tomek(t):
    return resample.under_tomek(t.vectors).select("id", "label")


@query(
    "under_centroids",
    f"WITH {VECTORS}, {_COUNTS}, low AS (SELECT min(n) AS k FROM counts) "
    "SELECT label, false AS synthetic, n AS n_rows, 64 AS dims, NULL::BIGINT AS n_means, NULL::BIGINT AS n_members FROM counts, low WHERE n = k "
    "UNION ALL SELECT label, true, k, 64, k, n FROM counts, low WHERE n > k",
)
def under_centroids(t):
    """Of the larger class: as many centroids as the smaller has rows, each the mean of its nearest rows, all rows spoken for."""
    rows = t.vectors
    out = materialize(resample.under_centroids(rows, rounds=200, tol=0), "resampled")
    centers = out.where("synthetic").select("label", "vec").withColumn("cid", F.monotonically_increasing_id())
    centers, told = materialize(centers, "centers"), None
    for c in [r["label"] for r in centers.select("label").distinct().collect()]:
        mine = centers.where(F.col("label") == c).select("cid", "vec")
        means = resample.center_means(rows.where(F.col("label") == c).select("id", "vec"), mine).join(mine, "cid")
        off = F.array_max(F.zip_with("vec", "mean", lambda a, b: F.abs(a - b)))
        one = means.agg(F.count_if(off < 1e-9).alias("n_means"), F.sum("n").alias("n_members")).select(F.lit(c).alias("label"), "*")
        told = one if told is None else told.unionByName(one)
    return _over_summary(out).join(told, "label", "left")


@query(
    "under_one_sided",
    f"WITH {VECTORS}, seed AS (SELECT id FROM vectors WHERE label = 0 ORDER BY {hash_sql('id')}, id LIMIT 1), "
    "core AS (SELECT * FROM vectors WHERE label = 1 OR id IN (SELECT id FROM seed)), rest AS (SELECT * FROM vectors WHERE label = 0 AND id NOT IN (SELECT id FROM seed)), "
    "one AS (SELECT q.id, d.label AS got, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, d.vec), d.id) AS rk FROM rest q, core d), "
    "kept AS (SELECT * FROM core UNION ALL SELECT * FROM rest WHERE id IN (SELECT id FROM one WHERE rk = 1 AND got = 1)), "
    f"{_tomek_sql('kept')} SELECT id, label FROM kept WHERE id NOT IN (SELECT id FROM links)",
)
def under_one_sided(t):
    return resample.under_one_sided(t.vectors).select("id", "label")


@query(
    "resample_both",
    f"WITH {VECTORS}, {_COUNTS} SELECT types, label, CASE types WHEN 'None' THEN n WHEN 'under' THEN (SELECT min(n) FROM counts) ELSE (SELECT max(n) FROM counts) END AS n_rows "
    "FROM counts, (SELECT unnest(['None', 'over', 'under', 'both']) AS types)",
)
def resample_both(t):
    return resample_pipeline(t)


@query("resample_pipeline", ORACLES["resample_both"])
def resample_pipeline(t):
    outs = None
    for kind in ("None", "over", "under", "both"):
        df = resample.rebalance(t.vectors, kind, "ros", "rus")
        part = df.groupBy("label").agg(F.count("*").alias("n_rows")).select(F.lit(kind).alias("types"), "label", "n_rows")
        outs = part if outs is None else outs.unionByName(part)
    return outs
