"""Suffix arrays, common prefixes and the removal of repeated bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from cases import DOCS, documents
from panelspark.llm import suffix, suffix_dedup


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 400))
    buf = rng.integers(0, int(rng.choice([1, 2, 3, 256])), n).astype(np.uint8)
    if seed % 3 == 0 and n > 50:
        buf = np.tile(buf[: int(rng.integers(1, 40))], 30)[:n]
    raw = buf.tobytes()
    if not len(raw):
        assert len(suffix.equal_classes(buf, 100)) == 0
        return
    order, rank = suffix.suffix_array(buf)
    assert list(order) == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffix.common_prefixes(buf, order, rank, 100)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :][:100], raw[order[k] :][:100]
        assert shared[k] == next((m for m, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(rows, width=100):
    seen, out = set(), []
    order = sorted({(r[0] is None, r[0] or 0, suffix_key(r, rows), r[1] or "") for r in rows})
    for no_id, doc_id, _, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone[k : k + width] = True
            seen.add(raw[k : k + width])
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((None if no_id else doc_id, text, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def suffix_key(row, rows):
    """Ties of a shared doc_id: the fixtures repeat no long string among such rows, so any order will do."""
    return row[1] or ""


def mosaic(seed=3, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "beté", "zeta", "x"]) + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(n):
        r, b = rng.random(), rng.choice(base)
        if r < 0.2:
            t = b
        elif r < 0.6:
            a = rng.randint(0, 200)
            t = str(rng.random()) * rng.randint(0, 6) + b[a : a + rng.randint(80, 260)] + str(rng.random()) + rng.choice(base)[50 : 50 + rng.randint(90, 200)]
        elif r < 0.7:
            t = "ab" * rng.randint(0, 300)
        elif r < 0.8:
            t = rng.choice([None, "", " ", "q" * 99, "q" * 100, "q" * 101])
        else:
            t = b[:100] * rng.randint(1, 4)
        rows.append((i * 7 % 61, t, "en", "s"))
    return rows


@pytest.mark.parametrize("limits", [{}, {"shard_spans": 3, "merge_rows": 5, "shard_bytes": 500}])
def test_repeats(table, limits):
    rows = mosaic()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(table(rows, DOCS), **limits).collect()]
    assert sorted(got) == sorted((w[0], *w[2:]) for w in brute(rows))


def test_awkward_rows(table):
    rows = documents()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(table(rows, DOCS)).collect()]
    want = {(w[0], w[1]): (w[0], *w[2:]) for w in brute(rows)}
    assert sorted(got, key=str) == sorted((want[(r[0], r[1] or "")] for r in rows), key=str)


def test_kept_bytes_and_empty(table):
    rows = [(1, "x" * 150, "en", "s"), (2, "x" * 120 + "tail", "en", "s")]
    kept = {r.doc_id: (bytes(r.kept), r.starts, r.stops) for r in suffix_dedup.kept_bytes(table(rows, DOCS)).collect()}
    # the string at 0 repeats from 1 on
    assert kept[1] == (b"x", [1], [150]) and kept[2] == (b"tail", [0], [120])
    assert suffix_dedup.repeat_digests(table([], DOCS)).count() == 0


def test_merge_by_binary_search():
    shards = [
        (np.array([b"a", b"c"], dtype=object), np.array([5, 1]), np.array([0, 0]), np.array([0, 0])),
        (np.array([b"a", b"b", b"c"], dtype=object), np.array([2, 2, 3]), np.array([0, 0, 0]), np.array([4, 5, 6])),
        (np.array([b"a", b"b"], dtype=object), np.array([1, 9]), np.array([0, 0]), np.array([7, 8])),
    ]
    doc, tie, pos = suffix_dedup.merge_shards(shards)
    assert sorted(zip(doc.tolist(), pos.tolist())) == [(2, 4), (3, 6), (5, 0), (9, 8)]
