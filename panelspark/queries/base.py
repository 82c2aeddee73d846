"""Query registry, test-table fixtures and the SQL fragments that state the same fixtures."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import scratch_dir

#: coordinates of ``embeddings``
DIM = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name`` with its SQL statement."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The test tables and the panels derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_dir(self.spark, name)

    @cached_property
    def panel(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("row_id"), F.col("user_id").alias("key"), F.col("ts").alias("t"),
            F.col("value").alias("amt"), F.col("event_type").alias("code"),
        )

    @cached_property
    def panel_nulls(self) -> DataFrame:
        return self.panel.withColumns(
            {
                "amt": F.when(F.col("row_id") % 7 != 0, F.col("amt")),
                "code": F.when(F.col("row_id") % 11 != 0, F.col("code")),
            }
        )

    @cached_property
    def panel_label(self) -> DataFrame:
        """Four classes and the binary label."""
        four = F.when(F.col("code") == "error", 1).when(F.col("code") == "purchase", 2).when(F.col("code") == "signup", 3).otherwise(0)
        return self.panel.withColumns({"target": four, "f": (F.col("code") == "error").cast("int")})

    @cached_property
    def orders_panel(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("t"),
            F.col("o_totalprice").alias("amt"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def stat(self) -> DataFrame:
        """Numeric columns and the 0/1 group for the tests."""
        return self.events.select(
            F.col("event_id").alias("row_id"), F.col("value").alias("x1"), F.hour("ts").alias("x2"),
            (F.weekday("ts") + 0).alias("x3"), (F.col("value") > 100).cast("int").alias("x4"),
            (F.col("user_id") % 2).cast("int").alias("x5"), (F.col("event_type") == "error").cast("int").alias("f"),
        )

    @cached_property
    def matrix(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").alias("row_id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIM)], "label"
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """(id, vec, label) with class 1 for label 0, about one row in ten."""
        return self.embeddings.select(
            F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
            (F.col("label") == 0).cast("int").alias("label"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Line items as a panel: item = part, business = supplier."""
        return self.lineitem.select(
            F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("business"), F.col("l_shipdate").alias("t"),
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
            F.col("l_returnflag").alias("flag"), (F.col("l_returnflag") == "R").alias("is_r"), (F.col("l_discount") > 0.05).alias("deep"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        """Documents with empty and missing text injected."""
        text = F.when(F.col("doc_id") % 13 == 0, "").when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.col("text"))
        return self.documents.select(F.col("doc_id").alias("row_id"), text.alias("text"))

    @cached_property
    def scored(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("row_id"), (F.col("event_type") == "error").cast("int").alias("f"),
            F.least(F.col("value") / 200, F.lit(1.0)).alias("score"), (F.col("event_id") % 5).alias("round"),
        )


PANEL = "panel AS (SELECT event_id AS row_id, user_id AS key, ts AS t, value AS amt, event_type AS code FROM events)"
PANEL_NULLS = (
    "panel AS (SELECT event_id AS row_id, user_id AS key, ts AS t, "
    "CASE WHEN event_id % 7 <> 0 THEN value END AS amt, CASE WHEN event_id % 11 <> 0 THEN event_type END AS code FROM events)"
)
PANEL_LABEL = (
    "panel AS (SELECT event_id AS row_id, user_id AS key, ts AS t, value AS amt, event_type AS code, "
    "CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END AS target, "
    "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events)"
)
ORDERS = (
    "panel AS (SELECT o_orderkey AS row_id, o_custkey AS key, o_orderdate AS t, o_totalprice AS amt, "
    "o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
)
STAT = (
    "stat AS (SELECT event_id AS row_id, value AS x1, hour(ts) AS x2, isodow(ts) - 1 AS x3, "
    "CASE WHEN value > 100 THEN 1 ELSE 0 END AS x4, user_id % 2 AS x5, "
    "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events)"
)
MATRIX = (
    "matrix AS (SELECT vec_id AS row_id, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(DIM))
    + ", label FROM embeddings)"
)
VECTORS = (
    "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings)"
)
ITEMS = (
    "items AS (SELECT l_partkey AS item, l_suppkey AS business, l_shipdate AS t, l_quantity AS qty, l_extendedprice AS price, "
    "l_discount AS disc, l_returnflag AS flag, l_returnflag = 'R' AS is_r, l_discount > 0.05 AS deep FROM lineitem)"
)
TEXTS = (
    "texts AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS text FROM documents)"
)
SCORED = (
    "scored AS (SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, "
    "least(value / 200, 1.0) AS score, event_id % 5 AS round FROM events)"
)


def hash_sql(*parts: str, seed: int = 42) -> str:
    return "md5(concat_ws('~', " + ", ".join([f"({p})::VARCHAR" for p in parts] + [f"'{seed}'"]) + "))"


def hash_long_sql(h: str) -> str:
    return f"concat('0x', substr({h}, 1, 15))::BIGINT"


def hash_unit_sql(h: str) -> str:
    return f"(concat('0x', substr({h}, 1, 8))::BIGINT / 4294967296.0)"


def upper_tail_sql(x: str) -> str:
    """P(Z > x) for x >= 0 in SQL: a positive series below 3, a continued fraction above."""
    pdf = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"
    log_term = "(2 * k + 1) * ln(greatest({0}, 1e-300)) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi()))".format(x)
    series = f"list_sum(list_transform(range(60), lambda k : exp({log_term})))"
    fraction = f"list_reduce(list_concat([0.0::DOUBLE], list_transform(range(80), lambda i : (80 - i)::DOUBLE)), lambda a, k : k / (({x}) + a))"
    return f"(CASE WHEN {x} < 3 THEN 0.5 - {pdf} * {series} ELSE {pdf} / (({x}) + {fraction}) END)"


def t_two_sided_sql(t: str, dof: str, steps: int = 2000) -> str:
    """P(|T| > |t|) in SQL: Simpson's rule over the angle atan(t / sqrt(dof)), cut where nothing is left."""
    to = f"least(atan(abs({t}) / sqrt({dof})), 12 / sqrt({dof}))"
    weight = f"(CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    total = f"list_sum(list_transform(range({steps + 1}), lambda k : {weight} * pow(cos(k * {to} / {steps}), {dof} - 1)))"
    scale = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi())"
    return f"greatest(0, 1 - 2 * {scale} * {to} / {3 * steps} * {total})"


def chi2_sf_sql(x: str, dof: str) -> str:
    """P(X > x) for a whole number of degrees: a finite sum, and a normal tail in front of it for odd ones."""
    half = f"(greatest({x}, 1e-300) / 2)"
    even = f"coalesce(list_sum(list_transform(range(({dof} // 2)::BIGINT), lambda i : exp(i * ln{half} - {half} - lgamma(i + 1.0)))), 0)"
    odd = f"coalesce(list_sum(list_transform(range(({dof} // 2)::BIGINT), lambda i : exp((i + 0.5) * ln{half} - {half} - lgamma(i + 1.5)))), 0)"
    return f"least(1, CASE WHEN ({dof}) % 2 = 0 THEN {even} ELSE 2 * {upper_tail_sql(f'sqrt({x})')} + {odd} END)"


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round result columns for a stable comparison; the shift moves exact decimal ties off the edge."""
    return df.withColumns({c: F.round(F.col(c) + 10.0 ** -(digits + 3), digits) for c in cols})
