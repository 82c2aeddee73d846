"""Token ids in binary files: one zstandard frame per document, one shared dictionary.

Layout of a token file (a folder that any Spark reader opens):

``dictionary``  one row: dict_id (SHA-256 of the bytes), width (bytes per id), end_id, dictionary
``blocks``      one row per block of documents in ascending doc_id order: part, block, dict_id, first_id, last_id,
                before (ids of earlier blocks of the part), doc_ids, counts, offsets, payload
``parts``       one row per part: part, start (ids of all earlier parts)

``offsets[i]`` .. ``offsets[i + 1]`` are the bytes of document i in ``payload``, so one document is read without
its neighbours, and a reader that holds another dictionary is told so by ``dict_id``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import in_order, small_batches
from panelspark.llm.encoder import ID, encoder

#: bounds of the dictionary sample: documents, bytes of ids taken from each, bytes of the dictionary
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
BLOCK_IDS = 1 << 19
#: rows encoded at once
SLICE = 256
END_ID = 0

BLOCKS = (
    "part int, block int, dict_id string, first_id long, last_id long, before long, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def train_dictionary(
    docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES
) -> bytes:
    """A dictionary trained on the serialized ids of at most ``sample_docs`` documents, lowest hashes first.

    It changes the size of the files and never their content. Too small a sample gives an empty dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encoder(tokenizer).encode(b.column("text").to_pylist())
            yield pa.record_batch({"ids": [serialize(x, END_ID)[:sample_bytes] for x in ids]})

    picked = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    picked = picked.orderBy(F.xxhash64("text"), "text").limit(sample_docs)
    samples = [bytes(r[0]) for r in small_batches(picked).mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def serialize(ids: bytes, end_id: int) -> bytes:
    """32-bit ids and the end id as 16-bit little-endian integers, or 32-bit ones if an id needs it.

    The width is told by the first byte.
    """
    wide = np.frombuffer(ids + end_id.to_bytes(ID, "little"), dtype="<u4")
    return b"\2" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\4" + wide.tobytes()


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, level: int = LEVEL) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write a token file in ascending doc_id order.

    A null or empty text is a document that holds the end id alone. A missing doc_id comes last; rows that share a
    doc_id stay rows of their own, ordered by text. Other columns are ignored. An empty table gives an empty file.
    A task that is run again writes the same blocks; Spark's committer keeps one copy.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    words = train_dictionary(docs, tokenizer)
    dict_id = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(dict_id, end_id, words)], "dict_id string, end_id int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(words), write_content_size=True)
        # a task may hold several parts, one behind the other; each is numbered and summed on its own
        part, block, before, held, rows = None, 0, 0, 0, []
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                some = b.slice(lo, SLICE)
                encoded = encoder(tokenizer).encode(some.column("text").to_pylist())
                for p, doc_id, ids in zip(some.column("_part").to_pylist(), some.column("doc_id").to_pylist(), encoded):
                    if rows and (p != part or held >= BLOCK_IDS):
                        yield as_block(part, block, before, rows)
                        block, before, held, rows = block + 1, before + held, 0, []
                    if p != part:
                        part, block, before = p, 0, 0
                    rows.append((doc_id, len(ids) // ID + 1, squeeze.compress(serialize(ids, end_id))))
                    held += rows[-1][1]
        if rows:
            yield as_block(part, block, before, rows)

    def as_block(part: int, block: int, before: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, counts, frames = zip(*rows)
        known = [i for i in ids if i is not None]
        row = {
            "part": part, "block": block, "dict_id": dict_id, "first_id": min(known, default=None), "last_id": max(known, default=None),
            "before": before, "doc_ids": ids, "counts": counts,
            "offsets": np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist(), "payload": b"".join(frames),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("dict_id", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()),
         ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
         ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
    )
    blocks = small_batches(in_order(docs)).mapInArrow(run, BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    held = F.col("before") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    # one row per part: as many as the writing tasks, whatever the number of documents
    sums = stored.groupBy("part").agg(F.max(held).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias("start"))
    parts.coalesce(1).write.parquet(f"{path}/parts")


def _dictionary_row(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.schema("dict_id string, end_id int, dictionary binary").parquet(f"{path}/dictionary").first()
    words = bytes(row["dictionary"])
    if hashlib.sha256(words).hexdigest() != row["dict_id"]:
        raise ValueError("the dictionary does not match its hash")
    return row["dict_id"], words


def _decoded(spark: SparkSession, path: str, blocks: DataFrame, schema: str, row) -> DataFrame:
    dict_id, words = _dictionary_row(spark, path)
    types = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(words))
        for b in batches:
            for r in b.to_pylist():
                if r["dict_id"] != dict_id:
                    raise ValueError(f"block {r['part']}/{r['block']} needs dictionary {r['dict_id']}")
                at, out = r["start"] + r["before"], []
                for i, doc_id in enumerate(r["doc_ids"]):
                    if r["wanted"] is None or doc_id in r["wanted"]:
                        frame = r["payload"][r["offsets"][i] : r["offsets"][i + 1]]
                        out.append(row(doc_id, at, deserialize(expand.decompress(frame))))
                    at += r["counts"][i]
                yield pa.RecordBatch.from_pylist(out, schema=types)

    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    return small_batches(blocks.join(F.broadcast(parts), "part")).mapInArrow(run, schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").withColumn("wanted", F.lit(None).cast("array<long>"))
    return _decoded(
        spark, path, blocks, "doc_id long, start long, n_tokens long, ids_crc32 long",
        lambda doc_id, at, ids: {"doc_id": doc_id, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())},
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, tokens) of all documents, or of the few named: only blocks whose id range holds one are read."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is None:
        blocks = blocks.withColumn("wanted", F.lit(None).cast("array<long>"))
    else:
        hit = F.lit(False)
        for i in doc_ids:
            hit = hit | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(hit).withColumn("wanted", F.array(*[F.lit(i).cast("long") for i in doc_ids]))
    return _decoded(
        spark, path, blocks, "doc_id long, start long, tokens array<long>",
        lambda doc_id, at, ids: {"doc_id": doc_id, "start": at, "tokens": ids.tolist()},
    )
