"""Scalers: fit a one-row parameter table, apply it to any frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import null_if_nan
from panelspark.operators.joins import attach_one_row
from panelspark.operators.ranks import exact_quantiles

KINDS = ("standard", "minmax", "robust")


def fit_scaler(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """One row with ``{c}__center`` and ``{c}__scale``; a zero scale becomes 1 and NaN is left out."""
    df = df.withColumns({c: null_if_nan(F.col(c)) for c in cols if dict(df.dtypes)[c] in ("float", "double")})
    if kind == "standard":
        pairs = {c: (F.avg(c), F.stddev_pop(c)) for c in cols}
        source = df
    elif kind == "minmax":
        pairs = {c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")) for c in cols}
        source = df
    elif kind == "robust":
        source = exact_quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
        pairs = {}
        for c in cols:
            mine = F.col("column") == c
            pairs[c] = (F.max(F.when(mine, F.col("q50"))), F.max(F.when(mine, F.col("q75") - F.col("q25"))))
    else:
        raise ValueError(f"unknown scaler {kind!r}, expected one of {KINDS}")
    aggs = []
    for c, (center, scale) in pairs.items():
        aggs += [center.alias(f"{c}__center"), F.when(scale == 0, F.lit(1.0)).otherwise(scale).alias(f"{c}__scale")]
    return source.agg(*aggs)


def apply_scaler(df: DataFrame, cols: list[str], params: DataFrame) -> DataFrame:
    out = attach_one_row(df, params).withColumns(
        {c: (F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale") for c in cols}
    )
    return out.select(*df.columns)


def invert_scaler(df: DataFrame, cols: list[str], params: DataFrame) -> DataFrame:
    out = attach_one_row(df, params).withColumns(
        {c: F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__center") for c in cols}
    )
    return out.select(*df.columns)


def scale(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    return apply_scaler(df, cols, fit_scaler(df, cols, kind))


def fit_apply_scaler(
    train: DataFrame, test: DataFrame, cols: list[str], kind: str, path: str
) -> tuple[DataFrame, DataFrame]:
    """Fit on train only, keep the parameters at ``path``, apply to both."""
    fit_scaler(train, cols, kind).write.mode("overwrite").parquet(path)
    params = train.sparkSession.read.parquet(path)
    return apply_scaler(train, cols, params), apply_scaler(test, cols, params)
