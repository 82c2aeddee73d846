"""Sources, sinks, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import joins
from panelspark.operators.ranks import add_buckets, prefix_sums
from panelspark.operators.sampling import stratified_kfold
from panelspark.queries.base import ITEMS, ORDERS, PANEL, PANEL_LABEL, hash_long_sql, query
from panelspark.sources import tables as src

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"

KFOLD_SQL = """, first AS (SELECT target, min(row_id) AS f0 FROM panel GROUP BY target),
 laid AS (SELECT p.target, row_number() OVER (ORDER BY f0, row_id) - 1 AS slot FROM panel p JOIN first USING (target)),
 alloc AS (SELECT target, slot % {k} AS fold, count(*) AS sz FROM laid GROUP BY 1, 2),
 bounds AS (SELECT target, fold, sz, coalesce(sum(sz) OVER (PARTITION BY target ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM alloc),
 pos AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY row_id) - 1 AS slot FROM panel),
 folds AS (SELECT p.*, b.fold FROM pos p JOIN bounds b ON p.target = b.target AND p.slot >= b.lo AND p.slot < b.lo + b.sz)"""


@query("read_typed_csv", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def read_typed_csv(t):
    path = t.scratch("csv")
    src.write_csv(t.events, path)
    return src.read_typed_csv(t.spark, path, EVENT_SCHEMA)


@query("read_csv_lines", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_csv_lines(t):
    """Free text with line breaks and quotes comes back as it was."""
    path = t.scratch("csv")
    src.write_csv(t.documents, path)
    return src.read_typed_csv(t.spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("read_column_subset", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def read_column_subset(t):
    path = t.scratch("csv")
    src.write_csv(t.orders, path, header=False)
    return src.read_column_subset(t.spark, path, ORDER_SCHEMA, ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query(
    "shard_by_key",
    "SELECT ("
    + hash_long_sql("md5(concat(user_id, '~42'))")
    + " % 48)::INT AS shard, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1",
)
def shard_by_key(t):
    out = src.shard_by_key(t.events, "user_id", t.scratch("shards"))
    return out.groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_keys"), F.sum("event_id").alias("id_sum")
    )


@query("table_snapshot", f"WITH {PANEL} SELECT * FROM panel")
def table_snapshot(t):
    return src.table_snapshot(t.panel, t.scratch("snapshot"))


@query("append_output", f"WITH {PANEL} SELECT code, count(*) AS n_rows, sum(row_id)::BIGINT AS id_sum FROM panel GROUP BY code")
def append_output(t):
    path = t.scratch("append")
    src.append_output(t.panel.where("code = 'error'"), path)
    src.append_output(t.panel.where("code <> 'error'"), path)
    return t.spark.read.parquet(path).groupBy("code").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("id_sum"))


def _folds(t, k=10):
    path = t.scratch("folds")
    src.write_folds(stratified_kfold(t.panel_label, "target", "row_id", k), path, k)
    return path


@query(
    "write_folds",
    f"WITH {PANEL_LABEL}{KFOLD_SQL.format(k=10)} SELECT i::INT AS fold, CASE WHEN fold = i THEN 'test' ELSE 'train' END AS role, target, "
    "count(*) AS n_rows, sum(row_id)::BIGINT AS id_sum FROM folds, range(10) r(i) GROUP BY 1, 2, 3",
)
def write_folds(t):
    out = t.spark.read.parquet(_folds(t))
    return out.groupBy("fold", "role", "target").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("id_sum"))


@query(
    "read_split_pair",
    f"WITH {PANEL_LABEL}{KFOLD_SQL.format(k=10)} SELECT CASE WHEN fold = 3 THEN 'test' ELSE 'train' END AS role, "
    "count(*) AS n_features, sum(row_id)::BIGINT AS id_sum, sum(target)::BIGINT AS label_sum FROM folds GROUP BY 1",
)
def read_split_pair(t):
    outs = []
    for role, (x, y) in src.read_split_pair(t.spark, _folds(t), 3, "target").items():
        a = x.agg(F.count("*").alias("n_features"), F.sum("row_id").alias("id_sum"))
        b = y.agg(F.sum("target").alias("label_sum"))
        outs.append(a.crossJoin(b).select(F.lit(role).alias("role"), "*"))
    return outs[0].unionByName(outs[1])


@query(
    "left_join_key",
    f"WITH {ORDERS} SELECT row_id, key, amt, c_mktsegment, c_acctbal FROM panel LEFT JOIN customer ON key = c_custkey",
)
def left_join_key(t):
    dim = t.customer.select(F.col("c_custkey").alias("key"), "c_mktsegment", "c_acctbal")
    return joins.left_join_key(t.orders_panel.select("row_id", "key", "amt"), dim, "key")


@query(
    "left_join_row",
    f"WITH {PANEL} SELECT row_id, amt, flag FROM panel LEFT JOIN (SELECT row_id, amt > 50 AS flag FROM panel WHERE row_id % 3 = 0) USING (row_id)",
)
def left_join_row(t):
    feats = t.panel.where("row_id % 3 = 0").select("row_id", (F.col("amt") > 50).alias("flag"))
    return joins.left_join_row(t.panel.select("row_id", "amt"), feats)


@query(
    "full_join_row",
    f"WITH {PANEL_LABEL}, x AS (SELECT row_id, amt FROM panel WHERE row_id % 3 <> 0), y AS (SELECT row_id, target FROM panel WHERE row_id % 5 <> 0) "
    "SELECT row_id, amt, target FROM x FULL JOIN y USING (row_id)",
)
def full_join_row(t):
    p = t.panel_label
    return joins.full_join_row(
        p.where("row_id % 3 <> 0").select("row_id", "amt"), p.where("row_id % 5 <> 0").select("row_id", "target")
    )


@query("column_bind", f"WITH {PANEL} SELECT row_id, amt, upper(code) AS code_up, key * 2 AS key2 FROM panel")
def column_bind(t):
    p = t.panel
    return joins.column_bind(
        [p.select("row_id", "amt"), p.select("row_id", F.upper("code").alias("code_up")), p.select("row_id", (F.col("key") * 2).alias("key2"))]
    )


@query(
    "union_rows",
    f"WITH {PANEL} SELECT row_id, code, amt FROM panel WHERE code = 'error' UNION ALL SELECT row_id, code, amt FROM panel WHERE amt > 50",
)
def union_rows(t):
    p = t.panel.select("row_id", "code", "amt")
    return joins.union_rows(p.where("code = 'error'"), p.where("amt > 50"))


@query("distinct_values", f"WITH {ITEMS} SELECT DISTINCT business, flag FROM items")
def distinct_values(t):
    return joins.distinct_values(t.items, "business", "flag")


@query(
    "isin_filter",
    f"WITH {ORDERS} SELECT row_id, key, amt FROM panel WHERE key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def isin_filter(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return joins.isin_filter(t.orders_panel.select("row_id", "key", "amt"), keys, "key")


@query(
    "sort_desc",
    f"WITH {PANEL}, v AS (SELECT key, count(*) AS votes, round(avg(amt) + 1e-9, 6) AS mean_amt FROM panel GROUP BY key) "
    "SELECT row_number() OVER (ORDER BY votes DESC, key DESC)::INT AS position, key, votes, mean_amt FROM v",
)
def sort_desc(t):
    v = t.panel.groupBy("key").agg(F.count("*").alias("votes"), F.round(F.avg("amt") + 1e-9, 6).alias("mean_amt"))
    # the per-key vote table is ranked through its vote count, so no task sees every key
    b = add_buckets(v.withColumn("_neg", -F.col("votes")), ["_neg"])
    out = prefix_sums(b, [F.col("_neg"), F.desc("key")], {"one": F.lit(1).cast("long")}, [], "_neg__b")
    return joins.sort_desc(out.select((F.col("before_one") + 1).cast("int").alias("position"), "key", "votes", "mean_amt"), "votes", "key")


@query(
    "top_k",
    f"WITH {PANEL}, v AS (SELECT key, round(sum(amt) + 1e-7, 4) AS score FROM panel GROUP BY key) SELECT key, score FROM v ORDER BY score DESC, key LIMIT 20",
)
def top_k(t):
    v = t.panel.groupBy("key").agg(F.round(F.sum("amt") + 1e-7, 4).alias("score"))
    return joins.top_k(v, "score", "key", 20)
