"""MinHash fingerprints of documents, and near-duplicate classes from their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import dealt_in_order, ordered_parts, small_batches
from panelspark.llm.components import components
from panelspark.llm.words import ALNUM, Words, chunks, utf8
from panelspark.session import materialize

SHINGLE = 5
PERMUTATIONS = 128
#: 32 bands of 4 rows: a pair at likeness 0.8 shares a band with probability above 0.9999999
BANDS = 32
THRESHOLD = 0.8
SEED = 42
#: shingles hashed by all permutations at once
BLOCK = 1 << 13
EMPTY = 0xFFFFFFFF


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n permutations x -> a x + b of the 32-bit integers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes of the word shingles of all texts, shingles per text).

    Texts come lower-cased with words separated by spaces. Fewer words than ``k``, but not none, are one shingle.
    """
    w = Words(texts)
    whole = np.maximum(np.where(w.count >= k, w.count - k + 1, np.minimum(w.count, 1)), 0)
    h = w.shingles(k)
    inside = w.fits(k)
    for i in np.flatnonzero((w.count > 0) & (w.count < k)).tolist():
        at, n = int(w.first[i]), int(w.count[i])
        h[at] = Words([w.joined(at, at + n)]).shingles(n)[0]
        inside[at] = True
    return (h[inside] >> np.uint64(32)).astype(np.uint32), whole


def signatures(texts: list[bytes], n: int = PERMUTATIONS, seed: int = SEED, k: int = SHINGLE) -> np.ndarray:
    """One row of n minima per text; a text without words has the largest value everywhere."""
    h, count = shingle_hashes(texts, k)
    a, b = permutations(n, seed)
    out = np.full((len(texts), n), EMPTY, dtype=np.uint32)
    end = np.cumsum(count)
    i = lo = 0
    while lo < len(h):
        # whole texts up to about BLOCK shingles; a longer text goes in pieces
        j = max(i, int(np.searchsorted(end, lo + BLOCK, side="right")) - 1)
        hi = int(min(end[j], lo + BLOCK)) if j == i else int(end[j])
        x = h[lo:hi]
        start = np.maximum(end[i : j + 1] - count[i : j + 1], lo) - lo
        some = np.flatnonzero((np.minimum(end[i : j + 1], hi) - lo > start))
        for c in range(0, n, 16):
            y = a[c : c + 16, None] * x[None, :] + b[c : c + 16, None]
            low = np.minimum.reduceat(y, start[some], axis=1)
            out[i + some, c : c + 16] = np.minimum(out[i + some, c : c + 16], low.T)
        lo = hi
        i = int(np.searchsorted(end, lo, side="right"))
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of every minimum, mixed first: minima of long texts are small numbers whose high bits agree."""
    return ((signature ^ (signature >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def fingerprint(signature: np.ndarray) -> list[str]:
    """Four hex digits for every minimum."""
    return [row.astype(">u2").tobytes().hex() for row in short(signature)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of two fingerprints; estimates the Jaccard likeness of the shingle sets."""
    return (short(a) == short(b)).mean(axis=1)


def clean(text: str | None) -> bytes:
    return utf8(text).translate(ALNUM)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points gives way to as many (or all) from the front of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, in ascending doc_id order.

    ``edited_text`` takes the next document's text; the last document is followed by the first. Null is empty; texts
    without words are all alike (likeness 1). Rows of one doc_id follow each other by text, a missing doc_id comes
    last; a lone document is its own next. An empty table gives no row.

    The order is cut into parts of contiguous ids, each streamed by one task; many rows of one doc_id are several parts. The first text of every part, one per
    part, goes along with the part before it.
    """
    rows = ordered_parts(docs)
    dealt = dealt_in_order(rows.withColumn("guest", F.lit(False)).unionByName(_guests(rows)), "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for b in batches:
            rows = b.to_pylist()
            for lo, hi in chunks(rows, lambda r: len(r["text"] or "")):
                part = ([held] if held else []) + rows[lo:hi]
                held = part[-1]
                if len(part) > 1:
                    yield from emit(part)
        # the last row of a partition is always the guest of the part it closes
        assert held is None or held["guest"]

    def emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        texts = [r["text"] or "" for r in rows]
        edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
        own = [i for i, r in enumerate(rows[:-1]) if not r["guest"]]
        if not own:
            return
        n = len(rows)
        sig = signatures([clean(t) for t in texts] + [clean(edited[i]) for i in own])
        plain, after, changed = sig[:n], sig[1:n], sig[n:]
        prints, changed_prints = fingerprint(plain), fingerprint(changed)
        near, beside = likeness(plain[own], changed), likeness(plain[own], after[own])
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "doc_id": rows[i]["doc_id"], "n_chars": len(texts[i]), "edited_sha256": hashlib.sha256(edited[i].encode()).hexdigest(),
                    "fingerprint": prints[i], "edited_fingerprint": changed_prints[k], "near_edited": float(near[k]), "near_next": float(beside[k]),
                }
                for k, i in enumerate(own)
            ],
            schema=types,
        )

    types = docs.sparkSession.createDataFrame([], EDITED).toArrow().schema
    return small_batches(dealt).mapInArrow(run, EDITED)


def _guests(rows: DataFrame) -> DataFrame:
    """The first row of every part, marked as guest of the part before it; that of the first part visits the last."""
    spark = rows.sparkSession
    # one row per part: as many as the tasks, whatever the number of documents
    least = sorted((r["_part"], r["least"]) for r in rows.groupBy("_part").agg(F.min("doc_id").alias("least")).collect())
    visits = [(part, low, least[i - 1][0]) for i, (part, low) in enumerate(least)]
    at = F.broadcast(spark.createDataFrame(visits, "_part int, least long, host int"))
    found = rows.join(at, "_part").where(F.col("doc_id").eqNullSafe(F.col("least")))
    found = found.groupBy("host", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return found.select(F.col("host").alias("_part"), "doc_id", "text", F.lit(True).alias("guest"))


def signature_rows(docs: DataFrame, n: int = PERMUTATIONS, seed: int = SEED, k: int = SHINGLE) -> DataFrame:
    """(doc_id, set_hash, shingles, signature) per row; set_hash stands for the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [clean(t) for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts, len):
                h, count = shingle_hashes(texts[lo:hi], k)
                sets = [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
                sig = signatures(texts[lo:hi], n, seed, k)
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": ids[lo + i], "set_hash": hashlib.sha256(s.tobytes()).hexdigest(), "shingles": s.astype(np.int64), "signature": sig[i].tobytes()}
                        for i, s in enumerate(sets)
                    ],
                    schema=types,
                )

    schema = "doc_id long, set_hash string, shingles array<long>, signature binary"
    types = docs.sparkSession.createDataFrame([], schema).toArrow().schema
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, schema)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = PERMUTATIONS, bands: int = BANDS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of ``docs``: near-duplicate classes at a Jaccard ``threshold``.

    Rows with equal shingle sets are one node, so copies never meet in a join. Nodes that share a band of their
    signatures are candidates; each candidate pair is verified on its whole sets. class_id is the smallest doc_id that
    verified pairs reach, n_links the number of verified partners of the node. Texts without words are one node with
    no partner; a null doc_id never names a class.
    """
    rows = materialize(signature_rows(docs, n, k=k), "signatures")
    nodes = materialize(rows.groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.first("shingles").alias("shingles"), F.first("signature").alias("signature")), "nodes")
    width = 4 * n // bands
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.substring("signature", i * width + 1, F.lit(width)).alias("key")))
    keys = nodes.where(F.size("shingles") > 0).select("set_hash", F.size("shingles").alias("size"), F.explode(band).alias("b")).select("set_hash", "size", "b.*")
    left, right = keys.select("band", "key", F.col("set_hash").alias("a"), F.col("size").alias("na")), keys.select("band", "key", F.col("set_hash").alias("b"), F.col("size").alias("nb"))
    # sizes further apart than the threshold can't reach it
    pairs = left.join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    pairs = pairs.select("a", "b").distinct()
    sets = nodes.select("set_hash", "shingles")
    both = pairs.join(sets.select(F.col("set_hash").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_hash").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = materialize(both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")
    roots = components(links)
    rooted = nodes.select("set_hash", "least").join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("set_hash")).groupBy("set_hash").agg(F.count(F.lit(1)).alias("n_links"))
    named = rooted.join(least, "root").join(degree, "set_hash", "left")
    return rows.join(named, "set_hash").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
