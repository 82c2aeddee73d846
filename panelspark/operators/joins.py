"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 16 * 1024 * 1024
HOT_ROWS = 5_000_000

def value_bytes(table: DataFrame) -> Column:
    """Bytes that the values of a row take, as an expression."""
    total = F.lit(8 * (len(table.columns) + 1)).cast("long")
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f.name)))), F.lit(0))
        elif not isinstance(f.dataType, T.AtomicType):
            total = total + F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
    return total


def fetch_bounded(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``table`` as a local relation when the bytes of its values, counted first, are within the bound, else None."""
    # no row takes less than its fixed part, so more rows than this are too many without reading their values
    cap = max(1, max_bytes // (8 * (len(table.columns) + 1)))
    head = table.limit(cap + 1)
    rows, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(value_bytes(table)), F.lit(0))).first()
    if rows > cap or size > max_bytes:
        return None
    return table.sparkSession.createDataFrame(table.toArrow(), schema=table.schema)


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows: at most one per ``hot_rows`` rows of ``df``.

    Returns a local DataFrame (on..., n_rows) or None when no key is hot.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > hot_rows)
    local = counts.toArrow()
    if local.num_rows == 0:
        return None
    return df.sparkSession.createDataFrame(local, schema=counts.schema)


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Equi join where hot keys of ``rows`` are spread over several tasks.

    The matching rows of ``table`` are repeated once per salt, for hot keys only.
    """
    # each key gets the salts its own rows need
    marks = F.broadcast(hot.select(*on, F.greatest(F.lit(8), F.ceil(F.col("n_rows") / HOT_ROWS)).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(4096))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), salts).cast("int")
    missing = F.lit(False)
    for k in on:
        missing = missing | F.col(k).isNull()
    # rows with a null key match nothing; they are spread too, or one task would hold them all
    left = rows.join(marks, on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull() | missing, spread).otherwise(F.lit(0))
    )
    right = table.join(marks, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str] | str,
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach ``table`` (one row per key) to ``rows``.

    Broadcasts ``table`` when its measured size is within ``max_bytes``; otherwise shuffles, with the
    hot keys of ``rows`` salted. Both checks are jobs over ``rows`` and ``table``, so pass inputs that are
    cheap to compute; deep plans join plainly and leave splitting to adaptive execution.
    """
    on = [on] if isinstance(on, str) else list(on)
    local = fetch_bounded(table, max_bytes) if max_bytes > 0 else None
    if local is not None:
        return rows.join(F.broadcast(local), on, how)
    hot = hot_keys(rows, on, hot_rows)
    if hot is None:
        return rows.join(table, on, how)
    return salted_join(rows, table, on, hot, how)


def attach_small(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table whose row count is bounded by construction, such as one row per (column, group)."""
    return rows.join(F.broadcast(table), on, how)


def attach_one_row(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Add the columns of a one-row parameter table to every row."""
    return rows.crossJoin(F.broadcast(params))


def left_join_key(rows: DataFrame, table: DataFrame, key: str, **kw) -> DataFrame:
    return lookup_join(rows, table, key, "left", **kw)


def left_join_row(rows: DataFrame, features: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row ids are unique on both sides, so a plain shuffle join is balanced."""
    return rows.join(features, row_id, "left")


def full_join_row(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    return left.join(right, row_id, "full")


def column_bind(frames: list[DataFrame], row_id: str = "row_id") -> DataFrame:
    """Side-by-side concatenation of frames that share ``row_id``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, row_id, "inner")
    return out


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def isin_filter(df: DataFrame, keys: DataFrame, on: str, **kw) -> DataFrame:
    """Rows whose key is in ``keys``."""
    marked = lookup_join(df, keys.select(on).distinct().withColumn("_in", F.lit(True)), on, "inner", **kw)
    return marked.drop("_in")


def sort_desc(df: DataFrame, *cols: str) -> DataFrame:
    """Descending order; for feature-sized results."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in cols])


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), F.asc(tie)).limit(k)
