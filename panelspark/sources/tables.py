"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.hashing import hash_long
from panelspark.functions.scalar import null_if_nan

DEFAULT_SHARDS = 48


def read_typed_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, multi_line: bool = True, mode: str = "FAILFAST"
) -> DataFrame:
    """CSV with explicit types; blanks after the separator are skipped, empty fields and NaN are null.

    Quoted fields may hold line breaks; a file is then read by one task, so data that is known to have none may be read
    with ``multi_line`` False, which splits files. A line that does not fit the schema is an error unless ``mode`` says so.
    """
    table = (
        spark.read.schema(schema)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("mode", mode)
        .option("ignoreLeadingWhiteSpace", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .csv(path)
    )
    return table.withColumns(
        {f.name: null_if_nan(F.col(f.name)) for f in table.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    )


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    (
        df.write.mode("overwrite")
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .csv(path)
    )


def read_column_subset(spark: SparkSession, path: str, schema: T.StructType | str, cols: list[str]) -> DataFrame:
    """Headerless CSV with given names; only ``cols`` are parsed."""
    return read_typed_csv(spark, path, schema, header=False).select(*cols)


def shard_of(key: Column, shards: int = DEFAULT_SHARDS, seed: int = 42) -> Column:
    """Shard number of a key: hash shards, so every key lives in exactly one."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"~{seed}")))
    return F.pmod(hash_long(h), F.lit(shards)).cast("int")


def shard_by_key(df: DataFrame, key: str, path: str, shards: int = DEFAULT_SHARDS, seed: int = 42, pieces: int | None = None) -> DataFrame:
    """One folder per shard, all rows of a key in the same shard, written in one pass.

    Each shard is cut into ``pieces`` tasks and files, so a hot key does not make one task write a whole shard;
    by default the pieces of all shards together match the session's shuffle partitions.
    """
    if pieces is None:
        pieces = max(2, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    marked = df.withColumn("shard", shard_of(F.col(key), shards, seed))
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(pieces))
    marked.withColumn("_piece", piece).repartition("shard", "_piece").drop("_piece").write.mode("overwrite").partitionBy(
        "shard"
    ).parquet(path)
    return df.sparkSession.read.parquet(path)


def table_snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_output(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_folds(df: DataFrame, path: str, k: int, fold: str = "fold") -> None:
    """A train and a test set per fold under ``fold=i/role=...``.

    A row is a test row of its own fold and a train row of the others. One row yields k output rows,
    which is the stated layout. Each folder is cut into as many files as keep its tasks even.
    """
    copies = df.withColumnRenamed(fold, "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    copies = copies.withColumn("role", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train")).drop("_own")
    pieces = max(1, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (2 * k)))
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in copies.columns]), F.lit(pieces))
    copies.repartition("fold", "role", piece).write.mode("overwrite").partitionBy("fold", "role").parquet(path)


def read_split_pair(spark: SparkSession, path: str, fold: int, label: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """{role: (features, label)} of one fold; only its partitions are read."""
    base = spark.read.parquet(path).where(F.col("fold") == fold)
    out = {}
    for role in ("train", "test"):
        part = base.where(F.col("role") == role).drop("fold", "role")
        out[role] = (part.drop(label), part.select(label))
    return out
