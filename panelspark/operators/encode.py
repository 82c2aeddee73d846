"""Encodings of code columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.impute import apply_fill, fit_fill
from panelspark.operators.joins import attach_one_row, lookup_join
from panelspark.operators.ranks import row_positions


def one_hot_list(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Boolean ``col_v`` per value; null is false everywhere; the source is dropped."""
    return df.withColumns({f"{col}_{v}": F.col(col).eqNullSafe(F.lit(v)) for v in values}).drop(col)


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """(col, freq): share of each non-null value among all rows, nulls included."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))
    return attach_one_row(counts, total).where(F.col(col).isNotNull()).select(col, (F.col("_c") / F.col("_n")).alias("_freq"))


def frequency_encode(df: DataFrame, cols: list[str], **kw) -> DataFrame:
    """Replace each value by its share; null stays null."""
    out = df
    for c in cols:
        out = lookup_join(out, frequency_table(df, c), c, **kw).withColumn(c, F.col("_freq")).drop("_freq")
    return out.select(*df.columns)


def first_seen_codes(df: DataFrame, col: str, row_id: str) -> DataFrame:
    """(col, _code): 0-based order in which the values first appear by ``row_id``."""
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(row_id).alias("_first"))
    return row_positions(first, "_first", []).select(col, F.col("pos").alias("_code"))


def factorize(df: DataFrame, col: str, row_id: str, out: str | None = None, **kw) -> DataFrame:
    """Integer code by first appearance, null gives -1."""
    codes = first_seen_codes(df, col, row_id)
    joined = lookup_join(df, codes, col, **kw)
    return joined.withColumn(out or f"{col}_code", F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_code")


def ordinal_first_seen(df: DataFrame, col: str, row_id: str, **kw) -> DataFrame:
    """Fill nulls with the most frequent value, then code by first appearance."""

    filled = apply_fill(df, fit_fill(df, [col], "most"), [col])
    return factorize(filled, col, row_id, out=f"{col}_code", **kw)
