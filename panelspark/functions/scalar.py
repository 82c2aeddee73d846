"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
EARTH_RADIUS_MILES = 3958.7613


def amt_log(x: Column) -> Column:
    return F.log10(F.abs(x) + 1)


def add_sign(x: Column) -> Column:
    return F.when(x < 0, 1).otherwise(0)


def log_transform(x: Column) -> Column:
    """log10(x+1); values at or below -1 give null."""
    return F.when(x > -1, F.log10(x + 1))


def de_log_transform(x: Column) -> Column:
    """Inverse of ``log_transform``, two digits, half to even."""
    return F.bround(F.pow(F.lit(10.0), x) - 1, 2)


def business_code_flag(ident: Column, codes=("82", "83")) -> Column:
    """1 when the 4th and 5th characters of the id are one of ``codes``; null gives 0."""
    return F.when(F.substring(ident.cast("string"), 4, 2).isin(*codes), 1).otherwise(0)


def parse_event_time(text: Column) -> Column:
    """Wall-clock time of ISO text or of a compact yyyyMMdd date; null when it does not parse."""
    iso = F.regexp_replace(F.trim(text), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return iso.try_cast("timestamp_ntz")


def date_parts(t: Column) -> dict[str, Column]:
    """Day of month, weekday with Monday = 0, month, year."""
    return {"day": F.dayofmonth(t), "weekday": F.weekday(t), "month": F.month(t), "year": F.year(t)}


def haversine_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def micros(t: Column) -> Column:
    """Wall-clock microseconds since 1970-01-01 for a date or timestamp, independent of session zone."""
    t = t.cast("timestamp_ntz")
    seconds = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return (
        F.unix_date(t.cast("date")).cast("bigint") * MICROS_PER_DAY
        + F.hour(t).cast("bigint") * 3_600_000_000
        + F.minute(t).cast("bigint") * 60_000_000
        + seconds
    )


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def nan_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``df`` with NaN read as missing in those of ``cols`` that can hold it."""
    floats = {c for c, kind in df.dtypes if kind in ("float", "double")}
    return df.withColumns({c: null_if_nan(F.col(c)) for c in dict.fromkeys(cols) if c in floats})


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate over rows where both are present; null when either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
