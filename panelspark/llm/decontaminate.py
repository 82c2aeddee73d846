"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_broadcast, fresh_names, small_batches
from panelspark.llm.words import ALNUM, Words, chunks, utf8
from panelspark.session import materialize

WINDOW = 10
SHINGLE = 3
#: bits of the fixed-size filter that keeps most document shingles out of the join
FILTER_BITS = 24

ITEM_WINDOWS = "item_id string, wid long, win string, size int, s int, offset int, h long"
CANDIDATES = "uid long, doc_id long, text_hash long, n_words long, found array<struct<h:long,pos:int,left:int,ctx:string>>"


def clean(text: str | None) -> bytes:
    """Lower-cased words, separated by spaces alone."""
    return utf8(text).translate(ALNUM)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per window of an item and shingle of it: the window's words, its size, the shingle's place and hash.

    An item of fewer words than ``window``, but not none, is one window; a window of fewer words than ``shingle``
    is its own shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                w = Words([clean(text)])
                n = len(w.hash)
                if not n:
                    continue
                size = min(window, n)
                s = min(shingle, size)
                hashes = w.shingles(s).view(np.int64).tolist()
                rows = []
                for at in range(n - size + 1):
                    words = w.joined(at, at + size).decode()
                    wid = int(Words([words.encode()]).shingles(size)[:1].view(np.int64)[0])
                    rows += [(item, wid, words, size, s, k, hashes[at + k]) for k in range(size - s + 1)]
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in rows], schema=types)

    types = items.sparkSession.createDataFrame([], ITEM_WINDOWS).toArrow().schema
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, ITEM_WINDOWS)


def hash_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map with one bit per value of the low bits of ``h``; its size is fixed, however many hashes there are.

    It lets every wanted hash through, and a share of the others that grows with the number of wanted ones.
    """
    mask = (1 << bits) - 1
    rows = hashes.select(F.col("h").bitwiseAND(F.lit(mask)).cast("int").alias("b")).distinct().toArrow()  # at most 2**bits
    out = np.zeros(1 << bits, dtype=bool)
    out[rows.column("b").to_numpy()] = True
    return np.packbits(out)


def _passes(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    low = h & np.uint64((1 << bits) - 1)
    return (packed[low >> np.uint64(3)] >> (np.uint8(7) - (low & np.uint64(7)).astype(np.uint8))) & 1 != 0


def shingle_counts(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(h, n): places of each wanted shingle hash in all documents, counted per task before the shuffle."""
    wanted = wanted.select("s", "h").distinct()
    packed = hash_filter(wanted, bits)
    sizes = [r[0] for r in wanted.select("s").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [clean(t) for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts, len):
                w = Words(texts[lo:hi])
                for s in sizes:
                    h = w.shingles(s)[w.fits(s)]
                    h, n = np.unique(h[_passes(packed, h, bits)], return_counts=True)
                    yield pa.record_batch({"h": h.view(np.int64), "n": n.astype(np.int64)})

    if not sizes:
        return docs.sparkSession.createDataFrame([], "h long, n long")
    counted = small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "h long, n long")
    sums = counted.groupBy("h").agg(F.sum("n").alias("n"))
    return sums.join(wanted.select("h").distinct(), "h")


def _candidates(docs: DataFrame, prefix: DataFrame, window: int, bits: int) -> DataFrame:
    """Every document with the places of shingles that may be prefix tokens, and the words around each place."""
    prefix = prefix.select("s", "h").distinct()
    packed = hash_filter(prefix, bits)
    sizes = [r[0] for r in prefix.select("s").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = [clean(t) for t in b.column("text").to_pylist()]
            ids, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            for lo, hi in chunks(texts, len):
                w = Words(texts[lo:hi])
                found: list[list] = [[] for _ in range(hi - lo)]
                for s in sizes:
                    h = w.shingles(s)
                    for p in np.flatnonzero(w.fits(s) & _passes(packed, h, bits)).tolist():
                        i = int(w.owner[p])
                        first, end = max(int(w.first[i]), p - window + s), min(int(w.first[i + 1]), p + window)
                        found[i].append({"h": int(h[p].view(np.int64)), "pos": p - int(w.first[i]), "left": p - first, "ctx": w.joined(first, end).decode()})
                rows = [
                    {"uid": uid + i, "doc_id": ids[lo + i], "text_hash": hashes[lo + i], "n_words": int(w.count[i]), "found": found[i]}
                    for i in range(hi - lo)
                ]
                uid += hi - lo
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    types = docs.sparkSession.createDataFrame([], CANDIDATES).toArrow().schema
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return small_batches(rows).mapInArrow(run, CANDIDATES)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``.

    Every window of ``window`` consecutive item words is a set of word shingles. As all of them must occur, the rarest
    in all documents, lowest hash first, is the only prefix token needed; a window with a shingle that never occurs is
    out. Documents join on that token; its place in the window must leave room on both sides (positional and length
    bounds), and the words there must equal the window's. ``n_hit`` counts words inside at least one match.

    Null or empty texts have no words and no hits. Items without words hit nothing; an item_id that repeats counts once.
    An item with a null id hits like any other, only ``n_items`` and ``items_sha256`` leave it out. Repeated documents are judged row by row. Empty tables give empty or clean results.
    """
    windows = materialize(item_windows(items, window, shingle), "windows")
    counts = shingle_counts(docs, windows, bits)
    ranked = windows.select("wid", "win", "size", "s", "offset", "h").distinct().join(counts, "h", "left")
    pick = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset", "s"))
    prefix = ranked.groupBy("wid", "win", "size").agg(pick.alias("p")).where("p.n > 0")
    prefix = materialize(prefix.select("wid", "win", "size", "p.h", "p.offset", "p.s"), "prefix")
    rows = materialize(_candidates(docs, prefix, window, bits), "candidates")
    tokens = rows.select("uid", "n_words", F.explode("found").alias("c")).select("uid", "n_words", "c.*")
    joined = tokens.join(bounded_broadcast(prefix), "h")
    start = F.col("pos") - F.col("offset")
    fits = (F.col("offset") <= F.col("left")) & (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    here = F.array_join(F.slice(F.split("ctx", " "), F.col("left") - F.col("offset") + 1, F.col("size")), " ")
    hits = joined.where(fits).where(here == F.col("win")).select("uid", "wid", "win", start.alias("a"), (start + F.col("size")).alias("b"))
    hits = materialize(hits, "hits")
    # spans of one document: bounded by its words
    spans = hits.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    spans = spans.select("uid", covered.alias("n_hit"))
    owners = windows.where("item_id is not null").select("wid", "win", "item_id").distinct()
    named = hits.select("uid", "wid", "win").distinct().join(owners, ["wid", "win"]).select("uid", "item_id").distinct()
    named = named.groupBy("uid").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = rows.select("uid", "doc_id", "text_hash", "n_words").join(spans.join(named, "uid", "left"), "uid", "left")
    items_list = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns as they are."""
    bad_id, bad_hash = fresh_names(docs, "_bad_id", "_bad_hash")
    bad = contamination(docs, items, **kw).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash))
    bad = materialize(bad.distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(bad_hash))
    return docs.join(bounded_broadcast(bad), same, "left_anti")
