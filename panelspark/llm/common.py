"""Spark helpers shared by the text operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.joins import BROADCAST_BYTES
from panelspark.operators.ranks import add_buckets
from panelspark.session import materialize

PARTS_PER_TASK = 8
#: a part is cut further beyond so many mean parts and so many rows
FULL_PART = 4
PART_ROWS = 256
#: code points of a text by which such a part is cut
PREFIX = 256
BATCH_BYTES = 4 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_BYTES``: rows with whole texts are large."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def ordered_parts(docs: DataFrame) -> DataFrame:
    """(_part, doc_id, text): part numbers rise with doc_id, and with the text where rows of one doc_id are cut apart.

    A missing id is in parts behind all others. Part bounds are approximate quantiles, so they steer balance and never
    a result. A part of more than ``FULL_PART`` mean ones, as one doc_id of many rows makes it, is cut by doc_id and text.
    """
    n = shuffle_parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = add_buckets(rows, ["doc_id"], PARTS_PER_TASK * n, "__part")
    part = F.when(F.col("doc_id").isNull(), F.lit(PARTS_PER_TASK * n + 1)).otherwise(F.col("doc_id__part")).cast("int")
    return _cut_full(rows.select(part.alias("_part"), "doc_id", "text"))


def _cut_full(rows: DataFrame) -> DataFrame:
    """``rows`` with over-full parts cut into ranges of (doc_id, text) and all parts numbered anew, in the same order.

    Only rows of over-full parts are written. Ranges are those of a prefix of the text: texts that share it stay together.
    """
    spark = rows.sparkSession
    # one row per part, whatever the number of documents
    held = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    mean = sum(held.values()) / max(len(held), 1)
    full = {p: n for p, n in held.items() if n > max(FULL_PART * mean, PART_ROWS)}
    if not full:
        return rows
    pieces = sum(math.ceil(n / max(mean, PART_ROWS / FULL_PART)) for n in full.values())
    at = F.broadcast(spark.createDataFrame([(p,) for p in full], "_part int"))
    prefix = F.substring("text", 1, PREFIX)
    cut = rows.join(at, "_part").repartitionByRange(pieces, "_part", F.col("doc_id").asc_nulls_last(), prefix.asc_nulls_first())
    # written, as another run may choose other ranges
    cut = materialize(cut.withColumn("_piece", F.spark_partition_id()), "cut")
    found = [(p, -1) for p in held if p not in full] + [tuple(r) for r in cut.select("_part", "_piece").distinct().collect()]
    numbers = spark.createDataFrame([(*x, i) for i, x in enumerate(sorted(found))], "_part int, _piece int, _new int")
    every = rows.join(at, "_part", "left_anti").withColumn("_piece", F.lit(-1)).unionByName(cut)
    return every.join(F.broadcast(numbers), ["_part", "_piece"]).select(F.col("_new").alias("_part"), "doc_id", "text")


def dealt_in_order(rows: DataFrame, *first: str) -> DataFrame:
    """``rows`` with each part whole in one task, in order of part, ``first``, doc_id and text."""
    order = ["_part", *first, F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    return rows.repartition(shuffle_parts(rows), "_part").sortWithinPartitions(*order)


def in_order(docs: DataFrame) -> DataFrame:
    """``ordered_parts`` with each part in one task, sorted by doc_id; rows of one doc_id are ordered by text."""
    return dealt_in_order(ordered_parts(docs))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until ``df`` has no column of that name, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def bounded_broadcast(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast if the bytes of its rows, counted by a job, stay within the bound; else unchanged.

    Pass a table that has been written: it is read once more.
    """
    width = F.lit(8 * (len(table.columns) + 2))
    for f in table.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif f.dataType.typeName() == "array":
            width = width + 16 * F.greatest(F.size(F.col(f.name)), F.lit(0))
    size = table.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= max_bytes else table
