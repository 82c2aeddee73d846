"""Spelling variants against comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from cases import DOCS, documents

from panelspark.llm import spelling as sp


def edit_one(a, b):
    """Whether one insertion, deletion or replacement turns ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def brute(docs, min_letters=6, min_count=5, every=199, ratio=5):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= min_letters and k >= min_count}
    near = {w: [v for v in words if edit_one(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def check(df, docs, **kw):
    got = sp.spelling_variants(df, **kw)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, **kw)
    return rows


def variants(seed, words, docs, letters="abcdeéß"):
    """Documents over a vocabulary of few letters, where near words abound and bigrams repeat."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(words)] + ["aaaaaa", "aaaaaaa", "ababababab", "ananananan"]
    for w in base[: words // 2]:
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]
    weight = [rng.choice([1, 1, 5, 30, 200]) for _ in base]
    return [(i, " ".join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(base, weight, k=400)), None, None) for i in range(docs)]


@pytest.mark.parametrize("seed, every", [(1, 199), (2, 7), (3, 2)])
def test_against_all_pairs(spark, table, seed, every):
    docs = variants(seed, 120, 40)
    rows = check(table(docs, DOCS), docs, every=every)
    assert any(r[1] for r in rows)


def test_awkward_documents(spark, table):
    docs = documents() * 6
    check(table(docs, DOCS), docs, min_count=2)


def test_empty_table_and_texts_without_words(spark, table):
    assert sp.spelling_variants(table([], DOCS)).collect() == []
    docs = [(1, None, None, None), (2, "", None, None), (3, "12 345 ab", None, None)]
    assert sp.spelling_variants(table(docs, DOCS)).collect() == []


def test_long_text_and_clashing_columns(spark, table):
    from pyspark.sql import functions as F

    docs = [(1, "quickly quickli " * 300_000 + "quickley", None, None), (1, "quickley " * 5, None, None)]
    df = table(docs, DOCS).withColumns({c: F.lit(1) for c in ("word", "n", "last", "pivot", "part", "root", "form")})
    check(df, docs, every=10**9)


def test_a_chain_of_forms_ends_at_its_root(spark, table):
    chain = ["window", "windoww", "windowws", "windowwsa", "windowwsab"]
    docs = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(5 * 6 ** (4 - i))), None, None)]
    rows = {r[0]: r for r in check(table(docs, DOCS), docs, every=10**9)}
    assert [rows[w][1] for w in chain] == [None, *chain[:-1]] and all(rows[w][2] == "window" for w in chain)


def test_two_pivots_share_no_letter():
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(6, 12)))
        ranks = {g: i for i, g in enumerate(rng.sample([a + b for a in "abc" for b in "abc"], 9))}
        last, chosen, prefix = sp.signature(word, ranks)
        assert len(chosen) == 2 and chosen[1] - chosen[0] >= 2 and set(chosen) <= set(prefix)
        best = min(ranks[word[i : i + 2]] + ranks[word[j : j + 2]] for i in prefix for j in prefix if j - i >= 2)
        assert sum(ranks[word[i : i + 2]] for i in chosen) == best
        assert prefix and max(ranks[word[i : i + 2]] for i in prefix) == last


def test_pairs_share_few_index_rows(spark):
    """A word pair meets only where a bigram and one side of the word agree, so candidates stay near the words."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(9)) for _ in range(4000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in sp.near_pairs(df).collect()}
    cut = {}
    for w in words:
        for i in range(len(w)):
            cut.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert got == {(a, b) for group in cut.values() for a in group for b in group if a < b}
