"""SimHash fingerprints, the trie join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from cases import DOCS, documents
from panelspark.llm import simhash
from panelspark.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near(fps, budget=4):
    return [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= budget]


def clustered(seed, groups=25, size=10, flips=6):
    rng = random.Random(seed)
    out = {0, 1, 3, (1 << 64) - 1}
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_fingerprint():
    texts = [r[1] for r in documents()] + ["a b c d", "A b C d e", "x" * 5000, "w " * 3000]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("leaf", [1, 3, 50])
def test_trie_finds_every_pair_once(seed, leaf):
    fps = clustered(seed)
    got = [(int(x), int(y)) for i, j in simhash.trie_pairs(fps, None, 0, 0, 4, leaf) for x, y in zip(i, j)]
    assert len(got) == len(set(got)) and sorted(got) == sorted(near(fps))


@pytest.mark.parametrize("pair_rows", [1 << 16, 40, 3])
def test_links_keep_components(spark, pair_rows):
    fps = clustered(9)
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.links(df, 4, pair_rows).collect()
    assert roots(len(fps), [(place[r.a], place[r.b]) for r in links]) == roots(len(fps), near(fps))


def test_near_copies_do_not_come_out_as_pairs(spark):
    base = random.Random(1).getrandbits(63)
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert simhash.links(df).count() <= len(fps) - 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(500, 500)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{x: 100 for x in range(100, 140)}}
    assert components(df.limit(0)).count() == 0


def expected(rows):
    fps = sorted({slow_fingerprint(r[1]) for r in rows})
    root = dict(zip(fps, roots(len(fps), near(fps))))
    least = {}
    for r in rows:
        k = root[slow_fingerprint(r[1])]
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], f"{slow_fingerprint(r[1]):016x}", least.get(root[slow_fingerprint(r[1])])) for r in rows]


def test_component_table(table):
    rows = documents()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.component_table(table(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_keep_one(table):
    rows = documents()
    df = table(rows, DOCS)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    fps = sorted({slow_fingerprint(r[1]) for r in rows})
    root = dict(zip(fps, roots(len(fps), near(fps))))
    got = [(root[slow_fingerprint(r.text)], r.doc_id) for r in kept.collect()]
    # one row of each group, the one with its smallest doc_id; two groups may hold rows that share a doc_id
    least = {root[int(e[1], 16)]: e[2] for e in expected(rows)}
    assert sorted(got, key=str) == sorted(least.items(), key=str)


def test_empty(table):
    df = table([], DOCS)
    assert simhash.component_table(df).count() == 0 and simhash.keep_one(df).count() == 0
