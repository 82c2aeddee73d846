"""SimHash near-duplicates: 64-bit fingerprints joined with themselves along a binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import fresh_names, small_batches
from panelspark.llm.components import components
from panelspark.llm.words import LOWER, utf8
from panelspark.session import materialize

SHINGLE = 4
BUDGET = 4
SEED = 42
#: bits of the first round of the Spark join, which is made at every size; later rounds add one bit
STRIDE = 4
#: fingerprints (eight bytes each) that a node pair may hold together before a task takes it as it is
PAIR_ROWS = 1 << 20
#: nodes of at most so many fingerprints are compared directly
LEAF = 6
#: node pairs expanded at once inside a task
CHUNK = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats included.

    A-Z is lower-cased, words are runs without ASCII white space. Fewer words than a shingle: the whole sequence
    is the only one; no word at all (null, empty, blank): 0.
    """
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist())
    h = np.array([digest(line[a:b], seed) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "fp": fp.view(np.int64)})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return small_batches(rows).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _levels(sorted_fps: np.ndarray, depth: int, leaf: int):
    """The trie below ``depth`` bits, level by level: ranges of the sorted array and their two children (-1: none).

    A node of at most ``leaf`` fingerprints has no children; neither has one at the last bit.
    """
    lo, hi = np.array([0]), np.array([len(sorted_fps)])
    levels = []
    for bit in range(63 - depth, -2, -1):
        inner = (hi - lo > leaf) & (bit >= 0)
        zero, one = np.full(len(lo), -1), np.full(len(lo), -1)
        levels.append((lo, hi, inner, zero, one))
        if not inner.any():
            break
        at = np.flatnonzero(inner)
        head = sorted_fps[lo[at]] >> np.uint64(bit + 1) << np.uint64(bit + 1) if bit < 63 else np.zeros(len(at), np.uint64)
        cut = np.searchsorted(sorted_fps, head | np.uint64(1 << bit))
        cut = np.clip(cut, lo[at], hi[at])
        left, right = cut > lo[at], hi[at] > cut
        zero[at[left]] = np.arange(left.sum())
        one[at[right]] = left.sum() + np.arange(right.sum())
        lo, hi = np.concatenate([lo[at][left], cut[right]]), np.concatenate([cut[left], hi[at][right]])
    return levels


def _compare(a, b, lo_a, n_a, lo_b, n_b, budget):
    """Matching index pairs of the products of paired ranges."""
    size = n_a * n_b
    owner = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    i, j = lo_a[owner] + k // n_b[owner], lo_b[owner] + k % n_b[owner]
    near = np.bitwise_count(a[i] ^ b[j]) <= budget
    return i[near], j[near]


def trie_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, spent: int, budget: int = BUDGET, leaf: int = LEAF) -> Iterator:
    """Chunks of index pairs (i, j) of two sorted fingerprint arrays within the error budget.

    Both arrays share their own first ``depth`` bits, which differ in ``spent`` places. Node pairs go down together,
    the differing bits add up, and a pair above the budget is dropped. A node pair with a leaf on either
    side is compared directly. ``b`` None joins ``a`` with itself, i < j.
    """
    alone = b is None
    la = _levels(a, depth, leaf)
    lb = la if alone else _levels(b, depth, leaf)
    b = a if alone else b
    zero = np.array([0])
    # (level, nodes of a, nodes of b, differing bits)
    stack = [(0, zero, zero, np.array([spent]))]
    while stack:
        level, na, nb, diff = stack.pop()
        if len(na) > CHUNK:
            half = len(na) // 2
            stack += [(level, na[:half], nb[:half], diff[:half]), (level, na[half:], nb[half:], diff[half:])]
            continue
        (lo_a, hi_a, in_a, z_a, o_a), (lo_b, hi_b, in_b, z_b, o_b) = la[level], lb[level]
        deep = in_a[na] & in_b[nb]
        flat = ~deep
        if flat.any():
            x, y = na[flat], nb[flat]
            size_a, size_b = hi_a[x] - lo_a[x], hi_b[y] - lo_b[y]
            order = np.cumsum(size_a * size_b)
            for part in np.split(np.arange(len(x)), np.searchsorted(order, np.arange(1 << 21, order[-1], 1 << 21))):
                if len(part):
                    i, j = _compare(a, b, lo_a[x[part]], size_a[part], lo_b[y[part]], size_b[part], budget)
                    if alone:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        yield i, j
        if deep.any():
            x, y, d, below = na[deep], nb[deep], diff[deep], []
            for p, q, more in ((z_a, z_b, 0), (o_a, o_b, 0), (z_a, o_b, 1), (o_a, z_b, 1)):
                ok = (p[x] >= 0) & (q[y] >= 0) & (d + more <= budget)
                if alone and p is o_a and q is z_b:
                    ok &= x != y  # the same pair the other way round
                below.append((p[x[ok]], q[y[ok]], d[ok] + more))
            x, y, d = map(np.concatenate, zip(*below))
            if len(x):
                stack.append((level + 1, x, y, d))


def _roots(n: int, pairs) -> np.ndarray:
    """Smallest index reachable for each of n places, by pointer jumping over chunks of pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, np.maximum(a, b), low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _task_links(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """A spanning forest of the links of one node pair: at most one row per fingerprint."""
    depth, spent = int(pdf["depth"].iloc[0]), int(pdf["diff"].iloc[0])
    fps = pdf["fp"].to_numpy().view(np.uint64)
    second = pdf["second"].to_numpy()
    a = np.sort(fps[~second])
    if not second.any():
        root = _roots(len(a), trie_pairs(a, None, depth, spent, budget))
        every = a
    else:
        b = np.sort(fps[second])
        every = np.concatenate([a, b])
        root = _roots(len(every), ((i, j + len(a)) for i, j in trie_pairs(a, b, depth, spent, budget)))
    moved = np.flatnonzero(root != np.arange(len(every)))
    return pd.DataFrame({"a": every[moved].view(np.int64), "b": every[root[moved]].view(np.int64)})


def links(distinct_fps: DataFrame, budget: int = BUDGET, pair_rows: int = PAIR_ROWS, stride: int = STRIDE) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that lie in one component at ``budget`` differing bits.

    Spark expands pairs of trie nodes, ``stride`` bits first and one bit at a time then, and drops those above the
    budget, until both nodes of a pair hold at most ``pair_rows`` fingerprints together; a task then goes on with that
    pair alone. A fingerprint meets as many pairs as there are nodes within the budget: for four bits 16 at depth 4, 31
    at 5, 57 at 6, 99 at 7, 163 at 8, so a round more is made only for pairs that are too large. The first round is made
    at every size, so that even few fingerprints are shared by many tasks. Inside a task links shrink to a spanning
    forest, so groups of near copies never come out as all their pairs.
    """
    spark = distinct_fps.sparkSession

    def at(depth: int):
        # in two shifts, as one by 64 bits would shift nothing
        return F.shiftrightunsigned(F.shiftrightunsigned("fp", 63 - depth), 1) if depth < 64 else F.col("fp")

    total = distinct_fps.count()
    pairs = spark.createDataFrame([(0, 0, 0, total, total)], "p long, q long, diff int, n_p long, n_q long")
    out, depth = [], 0
    while True:
        size = F.when(F.col("p") == F.col("q"), F.col("n_p")).otherwise(F.col("n_p") + F.col("n_q"))
        ready = (size <= pair_rows) & F.lit(depth > 0) | F.lit(depth >= 64)
        done = pairs.where(ready)
        one, two = (F.struct(F.col(c).alias("node"), F.lit(c == "q").alias("second")) for c in ("p", "q"))
        sides = F.when(F.col("p") == F.col("q"), F.array(one)).otherwise(F.array(one, two))
        keys = done.select(F.struct("p", "q").alias("pair"), "diff", F.explode(sides).alias("x")).select("pair", "diff", "x.node", "x.second")
        rows = keys.join(distinct_fps.select("fp", at(depth).alias("node")), "node")
        rows = rows.select(F.col("pair.p").alias("p"), F.col("pair.q").alias("q"), "diff", "second", "fp", F.lit(depth).alias("depth"))
        out.append(rows)
        rest = pairs.where(~ready)
        if depth >= 64 or rest.isEmpty():
            break
        step = stride if depth == 0 else 1
        nodes = distinct_fps.groupBy(at(depth + step).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        nodes = nodes.withColumn("up", F.shiftrightunsigned("c", step))
        left = nodes.select(F.col("up").alias("p"), F.col("c").alias("c_p"), F.col("n").alias("m_p"))
        right = nodes.select(F.col("up").alias("q"), F.col("c").alias("c_q"), F.col("n").alias("m_q"))
        grown = rest.join(left, "p").join(right, "q").where("p <> q or c_p <= c_q")
        new_bits = F.col("c_p").bitwiseXOR(F.col("c_q")).bitwiseAND(F.lit((1 << step) - 1))
        grown = grown.withColumn("diff", (F.col("diff") + F.bit_count(new_bits)).cast("int")).where(F.col("diff") <= budget)
        pairs = materialize(grown.select(F.col("c_p").alias("p"), F.col("c_q").alias("q"), "diff", F.col("m_p").alias("n_p"), F.col("m_q").alias("n_q")), "trie")
        depth += step
    found = [r.groupBy("p", "q").applyInPandas(lambda pdf: _task_links(pdf, budget), "a long, b long") for r in out]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows as in ``fingerprints`` and (fp, component_id, n_links) per distinct fingerprint.

    component_id is the smallest doc_id among all rows whose fingerprints are reachable through links of at most
    ``budget`` differing bits; rows without doc_id never give it, and it is null if no row of a group has one. Equal
    fingerprints are one node from the start, so copies cost a grouped minimum only.
    """
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")), "nodes")
    joined = components(links(nodes.select("fp"), budget))
    rooted = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows, materialize(classes, "classes")


def component_table(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``; fingerprint is 16 lowercase hex digits."""
    rows, classes = near_duplicates(docs, **kw)
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id (missing ones last), then smallest text hash.

    All columns of ``docs`` stay as they are. Of rows with the same doc_id and text the one whose columns come first as
    JSON stays, so the order of the rows does not matter. An empty table stays empty.
    """
    rows, classes = near_duplicates(docs, **kw)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))
    best = rows.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("k"))
    best = materialize(best.select("k.id", "k.th"), "keep")
    mine = F.xxhash64(F.col("text").cast("string"))

    def marked(table: DataFrame) -> tuple[DataFrame, Column]:
        names = fresh_names(docs, "_keep_id", "_keep_hash")
        return table.toDF(*names), F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (mine == F.col(names[1]))

    found, same = marked(best)
    kept = docs.join(found, same, "left_semi")
    repeated = rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))
    repeated = repeated.join(best.toDF("_id", "_th"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    if repeated.isEmpty():
        return kept
    again, same = marked(materialize(repeated, "again"))
    # a grouped minimum, which pre-aggregates: copies of one row never meet in one task
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same, "left_semi").select(F.col("doc_id").alias("i"), mine.alias("h"), whole.alias("row"))
    one = one.groupBy("i", "h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
