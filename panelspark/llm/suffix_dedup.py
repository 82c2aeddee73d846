"""Removal of repeated byte strings with suffix arrays over shards of text that may repeat.

A string of ``width`` bytes has one place that its content alone picks: the smallest hash among its k-byte grams. The
gram there names the shard, so equal strings meet in one shard wherever they stand, and a shard never has to be compared
with all others. Consecutive strings with the same place form a span; spans whose bytes agree repeat as a whole, and the
suffix arrays are left with the first span of each content, where different spans share a gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_broadcast, shuffle_parts, small_batches
from panelspark.llm.suffix import equal_classes
from panelspark.llm.words import chunks, mix, prefix_hash, range_hash, utf8
from panelspark.session import materialize

WIDTH = 100
GRAM = 32
#: bytes of text in one suffix array
SHARD_BYTES = 1 << 21
#: spans of one gram that go to one shard; more are dealt over several, which are merged
SHARD_SPANS = 1 << 13
#: strings of one merge task
MERGE_ROWS = 1 << 16
#: spans that a task compares before they leave it
HELD_SPANS = 1 << 20
LAST = (1 << 63) - 1

SPANS = "key long, span long, doc long, tie long, at long"
FOUND = "doc long, tie long, key long, start long, stop long, need boolean"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tie, text): (doc, tie) orders documents; a missing id comes last.

    ``tie`` is 0 for a doc_id that stands on one row; rows that share one are told apart by a hash of their text, and
    rows that agree in both are one document given twice.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    shared = materialize(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("shared")), "shared_ids")
    if shared.isEmpty():
        return rows.select("doc_id", "doc", F.lit(0).cast("long").alias("tie"), "text")
    marked = rows.join(bounded_broadcast(shared), "doc", "left")
    return marked.select("doc_id", "doc", F.when(F.col("shared"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long")).alias("tie"), "text")


def runs(texts: list[bytes], width: int, gram: int):
    """Spans of all texts: (text, first start, last start, place of the gram, hash of the gram, hash of the bytes)."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    end = np.cumsum(size)
    n = len(buf)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_hash(buf)
    at = np.arange(n - gram + 1)
    grams = range_hash(sums, at, at + gram)
    bits = max(1, int(n).bit_length())
    # the low bits hold the place, so a minimum names the leftmost smallest gram
    best = (mix(grams + np.uint64(1)) >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    need, have = width - gram + 1, 1
    while have < need:
        more = min(have, need - have)
        best = np.minimum(best[: len(best) - more], best[more:])
        have += more
    place = (best & np.uint64((1 << bits) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), size)[: len(place)]
    inside = np.arange(len(place)) + width <= end[owner]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & inside)
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    base = (end - size)[owner[first]]
    spans = range_hash(sums, first, stops + width)
    return owner[first], first - base, stops - base, place[first] - base, grams[place[first]], spans


def pack(first, last, place):
    return (first << 16) | ((last - first) << 8) | (place - first)


def unpack(at):
    return at >> 16, (at >> 16) + ((at >> 8) & 255), (at >> 16) + (at & 255)


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Intervals of each owner, those that touch made one."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    if not len(owner):
        return owner, start, stop
    # ends grow over owners too once each owner's places are moved behind the last one's
    shift = owner.astype(np.int64) * (int(stop.max()) + 2)
    high = np.maximum.accumulate(stop + shift)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = start[1:] + shift[1:] > high[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(owner) - 1)
    return owner[at], start[at], high[last] - shift[last]


def _spans(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Spans with their gram and content; those a task has seen earlier in the order leave as removed intervals.

    A removed interval has at < 0: -1 - start, and its end in ``span``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            doc, tie = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            texts = [utf8(t) for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts, len, 1 << 18):
                owner, *rest = runs(texts[lo:hi], width, gram)
                parts.append((doc[owner + lo], tie[owner + lo], *rest))
                size += len(owner)
            if size >= HELD_SPANS:
                yield from seen(parts)
                parts, size = [], 0
        if parts:
            yield from seen(parts)

    def seen(parts: list) -> Iterator[pa.RecordBatch]:
        d, t, first, last, place, key, span = map(np.concatenate, zip(*parts))
        order = np.lexsort((first, t, d, span, key))
        d, t, first, last, place, key, span = (x[order] for x in (d, t, first, last, place, key, span))
        new = np.ones(len(d), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (span[1:] != span[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(d) else order
        again = ~((d == d[head]) & (t == t[head]) & (first == first[head]))
        keep = ~again
        yield pa.record_batch(
            {"key": key[keep].view(np.int64), "span": span[keep].view(np.int64), "doc": d[keep], "tie": t[keep], "at": pack(first[keep], last[keep], place[keep])}
        )
        if again.any():
            doc, tie, start, stop = _joined_runs(d[again], t[again], first[again], last[again] + width)
            spread = mix(doc.view(np.uint64) + np.uint64(7)).view(np.int64)
            yield pa.record_batch({"key": spread, "span": stop, "doc": doc, "tie": tie, "at": -1 - start})

    return small_batches(texts.select("doc", "tie", "text")).mapInArrow(run, SPANS)


def _first_spans(spans: DataFrame, width: int) -> DataFrame:
    """Compare spans by content: all but the first of each go; firsts that share their gram with others need a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the gram that the last batch ended in: gram, content, head of that content, row not yet told to need a shard
        carry = None
        for b in batches:
            key, span, doc, tie, at = (b.column(c).to_numpy() for c in ("key", "span", "doc", "tie", "at"))
            gone = at < 0
            if gone.any():
                yield found(doc[gone], tie[gone], np.zeros(gone.sum(), np.int64), -1 - at[gone], span[gone], False)
                key, span, doc, tie, at = (x[~gone] for x in (key, span, doc, tie, at))
            if not len(key):
                continue
            if carry is not None:  # the head of the last content goes in front again
                key, span, doc, tie, at = (np.concatenate([[c], x]) for c, x in zip(carry[0], (key, span, doc, tie, at)))
            new_key = np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= span[1:] != span[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            same = (doc == doc[head]) & (tie == tie[head]) & (at >> 16 == at[head] >> 16)
            again = ~new & ~same
            first, last, _ = unpack(at)
            if again.any():
                yield found(doc[again], tie[again], np.zeros(again.sum(), np.int64), first[again], last[again] + width, False)
            group = np.cumsum(new_key) - 1
            several = np.bincount(group, weights=new)[group] > 1
            if carry is not None and carry[1]:
                several |= group == 0  # this gram had another content in an earlier batch
            need = new & several
            told = need.copy()
            if carry is not None and carry[2]:
                need[0] = False  # told before
            if need.any():
                yield found(doc[need], tie[need], key[need], at[need], at[need], True)
            tail = int(head[-1])
            in_tail = group == group[-1]
            was = carry is not None and group[-1] == 0 and carry[1]
            carry = ((key[tail], span[tail], doc[tail], tie[tail], at[tail]), bool(was or new[in_tail].sum() > 1), bool(told[tail]))

    def found(doc, tie, key, start, stop, need):
        return pa.record_batch({"doc": doc, "tie": tie, "key": key, "start": start, "stop": stop, "need": np.full(len(doc), need)})

    dealt = spans.repartition(shuffle_parts(spans), "key").sortWithinPartitions("key", "span", "doc", "tie", "at")
    return small_batches(dealt).mapInArrow(run, FOUND)


SHARED = "key long, doc long, tie long, start long, bytes binary"


def _shared_text(texts: DataFrame, wanted: DataFrame, width: int, gram: int) -> DataFrame:
    """The bytes of spans that need a shard, in two halves, keyed by a longer gram that all strings of a half hold.

    Strings that start far enough before the place hold the bytes before it too, the others those behind it; equal
    strings fall into the same half and have the same longer gram.
    """
    reach = (width - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for doc, tie, text, ats in zip(*(b.column(c).to_pylist() for c in ("doc", "tie", "text", "ats"))):
                raw = utf8(text)
                first, last, place = unpack(np.unique(np.array(ats, dtype=np.int64)))
                sums = prefix_hash(np.frombuffer(raw, dtype=np.uint8))
                edge = place - reach
                left, right = first <= edge, last > edge
                for some, lo, hi, a, z, side in (
                    (left, first, np.minimum(last, edge), edge, place + gram, 1),
                    (right, np.maximum(first, edge + 1), last, place, place + gram + reach, 2),
                ):
                    lo, hi = lo[some], hi[some]
                    key = mix(range_hash(sums, a[some], z[some]) + np.uint64(side)).view(np.int64)
                    rows.append((key, np.full(len(lo), doc), np.full(len(lo), tie), lo, [raw[x : y + width] for x, y in zip(lo.tolist(), hi.tolist())]))
                    size += int((hi - lo + width).sum())
                if size > SHARD_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        key, doc, tie, start = (np.concatenate([r[c] for r in rows]) for c in range(4))
        return pa.record_batch({"key": key, "doc": doc, "tie": tie, "start": start, "bytes": [x for r in rows for x in r[4]]})

    return small_batches(texts.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "ats")).mapInArrow(run, SHARED)


def shard_classes(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, pieces: list[bytes], width: int):
    """(piece, class, doc, tie, start, place in the joined bytes) of every string of ``width`` bytes, and these bytes.

    Sorted by class, the earliest string of each class in front.
    """
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    buf = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    classes = equal_classes(buf, width)
    owner = np.repeat(np.arange(len(pieces)), size)
    begin = np.cumsum(size) - size
    at = np.flatnonzero(np.arange(len(buf)) + width <= (begin + size)[owner])
    owner = owner[at]
    pos = start[owner] + at - begin[owner]
    order = np.lexsort((pos, tie[owner], doc[owner], classes[at]))
    at, owner, pos = at[order], owner[order], pos[order]
    return owner, classes[at], doc[owner], tie[owner], pos, at, buf


def _later(classes, doc, tie, pos):
    """Which strings of sorted classes start later than the first of their class."""
    new = np.ones(len(classes), dtype=bool)
    new[1:] = classes[1:] != classes[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(classes) else classes
    return new, ~((doc == doc[head]) & (tie == tie[head]) & (pos == pos[head]))


def _joined_runs(doc, tie, start, stop):
    """Intervals of documents, those that touch made one."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, stop = doc[order], tie[order], start[order], stop[order]
    code = np.zeros(len(doc), dtype=np.int64)
    code[1:] = np.cumsum((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))
    who, start, stop = merged(code, start, stop)
    at = np.searchsorted(code, who)
    return doc[at], tie[at], start, stop


def _intervals(doc, tie, pos, width):
    """Merged intervals of single strings."""
    return _joined_runs(doc, tie, pos, pos + width)


SHARDED = "doc long, tie long, start long, stop long, key long, shard int, string binary"


def _sharded(shared: DataFrame, width: int, shard_bytes: int, shard_spans: int) -> DataFrame:
    """Suffix arrays over shards: later strings leave as intervals, and the first of each class of a gram that several
    shards hold leaves with its bytes (``string``) to be merged."""
    counts = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    salts = materialize(counts.where(F.col("n") > shard_spans).select("key", F.ceil(F.col("n") / shard_spans).cast("int").alias("salts")), "hot_grams")
    rows = shared.join(bounded_broadcast(salts), "key", "left")
    salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc", "tie", "start"), F.col("salts")).cast("int"))
    rows = rows.withColumn("salt", salt).drop("salts")
    empty = np.zeros(0, dtype=np.int64)

    def flush(key, salt, doc, tie, start, pieces) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        group = np.cumsum(new) - 1
        # a gram that one span alone holds has nothing to compare
        some = np.flatnonzero((np.bincount(group)[group] > 1) | (salt >= 0))
        if not len(some):
            return
        key, salt, doc, tie, start = (x[some] for x in (key, salt, doc, tie, start))
        pieces = [pieces[i] for i in some.tolist()]
        owner, classes, d, t, pos, at, buf = shard_classes(doc, tie, start, pieces, width)
        first, later = _later(classes, d, t, pos)
        yield batch(*_intervals(d[later], t[later], pos[later], width), empty, empty, [])
        out = first & (salt[owner] >= 0)
        strings = [buf[i : i + width].tobytes() for i in at[out].tolist()]
        if strings:
            yield batch(d[out], t[out], pos[out], pos[out] + width, key[owner[out]], salt[owner[out]], strings)

    def batch(doc, tie, start, stop, key, shard, strings) -> pa.RecordBatch:
        n = len(doc)
        return pa.record_batch(
            {
                "doc": pa.array(doc, pa.int64()), "tie": pa.array(tie, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64()),
                "key": pa.array(key if strings else np.zeros(n, np.int64), pa.int64()), "shard": pa.array(shard if strings else np.full(n, -1), pa.int32()),
                "string": pa.array(strings or [None] * n, pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            pieces = b.column("bytes").to_pylist()
            held.append((*(b.column(c).to_numpy() for c in ("key", "salt", "doc", "tie", "start")), pieces))
            size += sum(map(len, pieces))
            if size < shard_bytes:
                continue
            key, salt, doc, tie, start = (np.concatenate([h[c] for h in held]) for c in range(5))
            pieces = [p for h in held for p in h[5]]
            # the last gram may go on in the next batch
            cut = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1])).max(initial=-1)) + 1
            yield from flush(key[:cut], salt[:cut], doc[:cut], tie[:cut], start[:cut], pieces[:cut])
            held, size = [(key[cut:], salt[cut:], doc[cut:], tie[cut:], start[cut:], pieces[cut:])], sum(map(len, pieces[cut:]))
        if held:
            yield from flush(*(np.concatenate([h[c] for h in held]) for c in range(5)), [p for h in held for p in h[5]])

    dealt = rows.repartition(shuffle_parts(rows), "key", "salt").sortWithinPartitions("key", "salt", "doc", "tie", "start")
    return small_batches(dealt).mapInArrow(run, SHARDED)


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """Strings of several shards that start later than an equal one in another shard: (doc, tie, pos).

    Each shard is (sorted distinct strings, doc, tie, pos). Shard by shard, strings are looked up by binary search in what
    has been merged so far; a hit keeps the earlier place, the rest is put in order.
    """
    have, doc, tie, pos = shards[0]
    out = []
    for s, d, t, p in shards[1:]:
        at = np.minimum(np.searchsorted(have, s), len(have) - 1)
        hit = have[at] == s
        i, j = at[hit], np.flatnonzero(hit)
        earlier = np.array([x < y for x, y in zip(zip(d[j], t[j], p[j]), zip(doc[i], tie[i], pos[i]))], dtype=bool)
        equal = (d[j] == doc[i]) & (t[j] == tie[i]) & (p[j] == pos[i])
        late = ~earlier & ~equal
        out.append((d[j][late], t[j][late], p[j][late]))
        out.append((doc[i][earlier], tie[i][earlier], pos[i][earlier]))
        doc, tie, pos = doc.copy(), tie.copy(), pos.copy()
        doc[i[earlier]], tie[i[earlier]], pos[i[earlier]] = d[j][earlier], t[j][earlier], p[j][earlier]
        have, doc, tie, pos = (np.concatenate([x, y[~hit]]) for x, y in ((have, s), (doc, d), (tie, t), (pos, p)))
        order = np.argsort(have, kind="stable")
        have, doc, tie, pos = have[order], doc[order], tie[order], pos[order]
    return tuple(map(np.concatenate, zip(*out))) if out else (doc[:0], tie[:0], pos[:0])


def _merged(strings: DataFrame, width: int, merge_rows: int) -> DataFrame:
    """Intervals of strings that an earlier shard of the same gram holds too."""
    counts = strings.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / merge_rows).cast("int").alias("cuts"))
    rows = strings.join(bounded_broadcast(materialize(counts, "merge_cuts")), "key")
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("string"), F.col("cuts")).cast("int"))

    def run(pdf):
        import pandas as pd

        shards = []
        for _, g in pdf.groupby("shard", sort=True):
            s = np.array(g["string"].tolist(), dtype=object)
            order = np.argsort(s, kind="stable")
            shards.append((s[order], *(g[c].to_numpy()[order] for c in ("doc", "tie", "start"))))
        doc, tie, pos = merge_shards(shards)
        doc, tie, start, stop = _intervals(doc, tie, pos, width)
        return pd.DataFrame({"doc": doc, "tie": tie, "start": start, "stop": stop})

    return rows.select("key", "cut", "shard", "string", "doc", "tie", "start").groupBy("key", "cut").applyInPandas(run, "doc long, tie long, start long, stop long")


def removed_intervals(
    texts: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, shard_spans: int = SHARD_SPANS, merge_rows: int = MERGE_ROWS
) -> DataFrame:
    """(doc, tie, spans): the maximal removed byte runs of every document of ``keyed`` that has any, in order."""
    found = materialize(_first_spans(_spans(texts, width, gram), width), "spans")
    wanted = found.where("need").groupBy("doc", "tie").agg(F.collect_list("start").alias("ats"))
    shared = materialize(_shared_text(texts, materialize(wanted, "wanted"), width, gram), "shared_text")
    sharded = materialize(_sharded(shared, width, shard_bytes, shard_spans), "sharded")
    parts = [found.where("not need"), sharded.where("string is null"), _merged(sharded.where("string is not null"), width, merge_rows)]
    every = parts[0].select("doc", "tie", "start", "stop")
    for p in parts[1:]:
        every = every.unionByName(p.select("doc", "tie", "start", "stop"))
    every = every.repartition(shuffle_parts(texts), "doc", "tie").sortWithinPartitions("doc", "tie", "start")
    return small_batches(every).mapInArrow(_joined, "doc long, tie long, starts array<long>, stops array<long>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its intervals, those that touch made one; a document may span batches."""
    held = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("doc", "tie", "start", "stop")]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        doc, tie, start, stop = cols
        code = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
        who, start, stop = merged(code, start, stop)
        doc, tie = (x[np.searchsorted(code, who)] for x in (doc, tie))
        cut = int(np.searchsorted(who, who[-1]))
        held = doc[cut:], tie[cut:], start[cut:], stop[cut:]
        if cut:
            yield _lists(doc[:cut], tie[:cut], start[:cut], stop[:cut])
    if held is not None:
        yield _lists(*held)


def _lists(doc, tie, start, stop) -> pa.RecordBatch:
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
    offsets = pa.array(np.append(at, len(doc)), pa.int32())
    lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (start, stop))
    return pa.record_batch(dict(zip(("doc", "tie", "starts", "stops"), (pa.array(doc[at]), pa.array(tie[at]), *lists))))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = "doc_id long, kept binary, starts array<long>, stops array<long>"


def _with_spans(docs: DataFrame, **kw) -> DataFrame:
    texts = keyed(docs)
    spans = materialize(removed_intervals(texts, **kw), "removed")
    # the list of removed runs grows with the documents, so it is joined and never broadcast by choice
    return texts.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "starts", "stops")


def _kept(text: str | None, starts: list | None, stops: list | None) -> bytes:
    raw = utf8(text)
    if not starts:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)]))


def kept_bytes(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, kept, starts, stops), one row per row of ``docs``: the bytes left and the maximal runs removed.

    Every whole text is taken as UTF-8 bytes, null as none. A byte goes if a string of ``width`` bytes that covers it
    also starts earlier: in a document with a smaller doc_id, or earlier in the same one. Strings overlap, never cross
    documents, and are judged on the input. A missing doc_id is behind all others; rows that share a doc_id are ordered
    by a hash of their text, and rows that agree in both are one document, so neither repeats the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_kept(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "stops")))]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "kept": pa.array(kept, pa.binary()), "starts": b.column("starts"), "stops": b.column("stops")})

    return small_batches(_with_spans(docs, **kw)).mapInArrow(run, KEPT)


def repeat_digests(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``kept_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, starts, stops in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "starts", "stops"))):
                gone = sum(stops) - sum(starts) if starts else 0
                rows.append((i, len(utf8(text)), gone, len(starts or ()), hashlib.sha256(_kept(text, starts, stops)).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in rows], schema=types)

    types = docs.sparkSession.createDataFrame([], DIGEST).toArrow().schema
    return small_batches(_with_spans(docs, **kw)).mapInArrow(run, DIGEST)
