"""Quantile thresholds and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.joins import attach_one_row
from panelspark.operators.ranks import exact_quantiles

QUARTILES = {"25": 0.25, "50": 0.5, "75": 0.75}


def fit_thresholds(df: DataFrame, cols: list[str], probs: dict[str, float] = QUARTILES) -> DataFrame:
    """One row: ``{col}_{name}`` for each column and quantile."""
    q = exact_quantiles(df, cols, {f"q{k}": p for k, p in probs.items()})
    return q.agg(
        *[F.max(F.when(F.col("column") == c, F.col(f"q{k}"))).alias(f"{c}_{k}") for c in cols for k in probs]
    )


def quantile_thresholds(df: DataFrame, cols: list[str], fitted: DataFrame | None = None) -> DataFrame:
    return attach_one_row(df, fitted if fitted is not None else fit_thresholds(df, cols))


def quantile_bands(df: DataFrame, cols: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Thresholds plus four 0/1 flags per column that split its non-null rows."""
    out = quantile_thresholds(df, cols, fitted)
    flags = {}
    for c in cols:
        x, a, b, d = (F.col(n) for n in (c, f"{c}_25", f"{c}_50", f"{c}_75"))
        tests = {"1st": x <= a, "2nd": (x > a) & (x <= b), "3rd": (x > b) & (x <= d), "4th": x > d}
        flags |= {f"{c}_{k}_yn": F.when(t, 1).otherwise(0) for k, t in tests.items()}
    return out.withColumns(flags)
