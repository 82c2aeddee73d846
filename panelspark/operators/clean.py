"""Row and column cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_TEXT = "Not exist"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def drop_noise_rows(df: DataFrame, allowed: list[tuple[str, object]], noise: list[tuple[str, object]]) -> DataFrame:
    """Keep rows that equal at least one allowed value, then drop rows equal to a noise value (null stays)."""
    keep = F.lit(False)
    for c, v in allowed:
        keep = keep | F.col(c).eqNullSafe(F.lit(v))
    for c, v in noise:
        keep = keep & ~F.col(c).eqNullSafe(F.lit(v))
    return df.where(keep)


def label_multiclass(df: DataFrame, tests: list[Column], drop: list[str] = (), out: str = "target") -> DataFrame:
    """Class 1..n for the tests, a later test wins, 0 when none holds."""
    label = F.lit(0)
    for i, test in enumerate(tests, start=1):
        label = F.when(test, i).otherwise(label)
    return df.withColumn(out, label.cast("int")).drop(*drop)


def collapse_label(target: Column) -> Column:
    """1 for any non-zero class."""
    return F.when(target.eqNullSafe(F.lit(0)), 0).otherwise(1)


def code_label(code: Column, normal: str) -> Column:
    """0 for the normal code, 1 otherwise, null included."""
    return F.when(code.eqNullSafe(F.lit(normal)), 0).otherwise(1)


def drop_sparse_columns(df: DataFrame, null_rate: float = 0.7) -> DataFrame:
    """Keep a column when its non-null count reaches n * (1 - null_rate)."""
    seen = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first()
    need = seen["_n"] * (1 - null_rate)
    return df.select(*[c for c in df.columns if seen[c] >= need])


def drop_named_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def drop_string_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)])


def columns_containing(names: list[str], fragments: list[str]) -> list[str]:
    """Names holding any fragment, grouped by fragment order, each once."""
    return list(dict.fromkeys(n for f in fragments for n in names if f in n))


def columns_minus(names: list[str], removed: list[str]) -> list[str]:
    gone = set(removed)
    return [n for n in names if n not in gone]


def select_columns_containing(df: DataFrame, fragments: list[str], without: list[str] = ()) -> DataFrame:
    return df.select(*columns_minus(columns_containing(df.columns, fragments), without))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_null) for each column plus a ``__total__`` row, from one scan; NaN counts as missing."""
    cols = list(cols or df.columns)
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    gone = {c: F.col(c).isNull() | F.isnan(c) if c in fractional else F.col(c).isNull() for c in cols}
    one = df.agg(*[F.count_if(gone[c]).alias(c) for c in cols])
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols]
    cells.append(F.struct(F.lit("__total__").alias("column"), total.alias("n_null")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.column", "c.n_null")


def fill_constant(df: DataFrame, texts: list[str] = (), number: float = 0) -> DataFrame:
    """Numeric nulls become ``number``; nulls of text columns become the no-text marker."""
    fills = {}
    for f in df.schema.fields:
        if f.name in texts:
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(NO_TEXT))
        elif isinstance(f.dataType, _INTEGRAL + _FRACTIONAL):
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(number).cast(f.dataType))
    return df.withColumns(fills)


def coerce_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Strings and other types become long (null when not a number); fractional columns stay."""
    out = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, _FRACTIONAL):
            continue
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.col(f.name).try_cast("double").cast("bigint")
        else:
            out[f.name] = F.col(f.name).cast("bigint")
    return df.withColumns(out) if out else df


def cast_by_role(df: DataFrame, bools: list[str] = (), floats: list[str] = (), ints: list[str] = ()) -> DataFrame:
    out = {c: F.col(c).cast("boolean") for c in bools}
    out |= {c: F.col(c).try_cast("double") for c in floats}
    out |= {c: F.col(c).try_cast("bigint") for c in ints}
    return df.withColumns(out)


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest signed integer type that holds each integral column's values."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGRAL + _FRACTIONAL)]
    if not cols:
        return df
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [
            F.min(x).cast("double").alias(f"{c}__lo"),
            F.max(x).cast("double").alias(f"{c}__hi"),
            F.bool_and((x == F.floor(x.cast("double"))) & ~F.isnan(x.cast("double"))).alias(f"{c}__whole"),
        ]
    seen = df.agg(*aggs).first()
    casts = {}
    for c in cols:
        lo, hi, whole = seen[f"{c}__lo"], seen[f"{c}__hi"], seen[f"{c}__whole"]
        if not whole or lo is None:
            continue
        for bits, name in ((7, "tinyint"), (15, "smallint"), (31, "int"), (53, "bigint")):
            if -(2**bits) <= lo and hi <= 2**bits - 1:
                casts[c] = F.col(c).cast(name)
                break
    return df.withColumns(casts) if casts else df


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
