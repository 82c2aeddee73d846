"""Decontamination, license scan, language and MinHash against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex

from cases import DOCS, documents, prose
from panelspark.llm import decontaminate, language, licenses, minhash
from panelspark.llm.words import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- words ---------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_neighbours():
    texts = ["one two", "", "three", "two one two  ñandú", "one"]
    together = Words([decontaminate.clean(t) for t in texts])
    for i, t in enumerate(texts):
        alone = Words([decontaminate.clean(t)])
        assert (together.hash[together.first[i] : together.first[i + 1]] == alone.hash).all()
        assert together.count[i] == len(words(t))


# ---- decontamination -----------------------------------------------------------------------------


def contaminated(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for r in docs:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [
    (1, "quick fox jumps over the moon and never ever comes back home again to us"), (2, prose(2, 14)), (3, "ONE"), (4, None), (5, "?!"), (None, "one two"),
    (10, "it's 12"), (10, "it's 12"), (11, prose(1, 80)), (12, "a b a b a b a b a b a b a b"), (13, "日本語 text"),
]


@pytest.mark.parametrize("bits", [4, 24])
def test_contamination(spark, table, bits):
    rows = documents() + [(30, "x " + ITEMS[0][1] + " y " + ITEMS[0][1], "en", "s"), (31, "a b " * 30, "en", "s"), (32, prose(2, 13), "en", "s")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(table(rows, DOCS), items, bits=bits).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == sorted(contaminated(rows, ITEMS), key=str)


def test_keep_clean(spark, table):
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = table(rows, DOCS)
    kept = decontaminate.keep_clean(df, items)
    assert kept.columns == df.columns
    want = [(r[0], r[1]) for r, c in zip(rows, contaminated(rows, ITEMS)) if not c[-1]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_no_documents_no_items(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(table(documents(), DOCS), none).collect()] == [0] * len(documents())
    assert decontaminate.contamination(table([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# ---- licenses ------------------------------------------------------------------------------------


LICENSED = [
    "under the MIT license, under the MIT-License", "Released undr the MIT License.", "CC-BY-NC cc by nc cc by nc", "Apache License, Version 2.0", "GNU General Public Licence, version 3.",
    "all rights reserved all right reserved", "we submit license plates", None, "", "?!", "xunder the mit license",
]


def test_base_places(table):
    rows = [(i, t, "en", "s") for i, t in enumerate(LICENSED)] + documents()[:9]
    got = licenses.scan_licenses(table(rows, DOCS)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for r in got:
        options = []
        for t in texts[r.doc_id]:
            w = words(t)
            at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            options.append((len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x[1] for x in at}))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in options
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_fuzzy_labels():
    labels = {t: [(f[0], f[3]) for f in licenses.scan(t)["found"]] for t in LICENSED}
    assert labels["Released undr the MIT License."] == [("mit", 1)]
    assert labels["GNU General Public Licence, version 3."] == [("gpl-3", 1)]
    assert labels["all rights reserved all right reserved"] == [("rights-reserved", 0), ("rights-reserved", 1)]
    assert labels["we submit license plates"] == []


@pytest.mark.parametrize("seed", range(30))
def test_seeds_lose_no_match(seed):
    """Every notice with at most its edits is found, wherever it stands."""
    rng = random.Random(seed)
    label, text, edits = rng.choice(licenses.NOTICES)
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(1, len(chars) - 1)
        rng.choice([lambda: chars.pop(k), lambda: chars.insert(k, "q"), lambda: chars.__setitem__(k, "q")])()
    line = " " + prose(seed, 20) + " " + "".join(chars) + " " + prose(seed + 99, 20) + " "
    spans = licenses.fuzzy_spans(line, licenses.Notice(label, text, edits))
    assert bool(spans) and regex.search(f"(?:{regex.escape(text)}){{e<={edits}}}", line)
    assert any(line.index("".join(chars)) - edits <= a and b <= line.index("".join(chars)) + len(chars) + edits for a, b, _ in spans)


# ---- language ------------------------------------------------------------------------------------


def phrases(text, train):
    """Greedy parse: how many longest substrings of ``train`` make up ``text``; a lone unknown symbol is one."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and tuple(text[at:end]) in train:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(5))
def test_cross_parsing(seed):
    rng = np.random.default_rng(seed)
    train = rng.integers(1, 5, 60).tolist()
    have = {tuple(train[i:j]) for i in range(60) for j in range(i + 1, 61)}
    blocks = [rng.integers(0, 6, int(rng.integers(0, 50))).astype(np.uint8) for _ in range(20)]
    table = language.parser(train, 2 + language.OWN_SYMBOLS + language.FOLDED)
    assert language.parse(blocks, [table])[0].tolist() == [phrases(b.tolist(), have) for b in blocks]


def test_automaton_accepts_substrings_alone():
    codes = [1, 2, 1, 2, 2, 1, 3, 1, 2]
    step = language.suffix_automaton(codes, 4)
    have = {tuple(codes[i:j]) for i in range(9) for j in range(i + 1, 10)}
    for n in range(1, 5):
        for k in range(4**n):
            word, s = [(k // 4**i) % 4 for i in range(n)], 0
            for c in word:
                s = step[s, c] if s >= 0 else -1
            assert (s >= 0) == (tuple(word) in have)


def test_prediction(table):
    model = language.CrossParser(("de", "en"), ("Der Hund und die Katze sind nicht da, aber das Haus ist schön. " * 4, "The dog and the cat are not there, but the house is nice. " * 4))
    rows = [(1, "the cat and the house", None, "s"), (2, "DER HUND und das Haus", "en", "s"), (3, None, "en", "s"), (4, "12 ?!", "en", "s"), (None, "", None, None), (5, "the dog " * 4000, "de", "s"), (6, "日本", "en", "s")]
    got = {r.doc_id: r for r in language.predict_language(table(rows, DOCS), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 5)] == ["en", "de", "und", "und", "und", "en"]
    assert got[6].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_learning_uses_its_fold_and_nulls_nothing(table):
    rows = [(i, prose(i, 30), ("en", "xx", None)[i % 3], "s") for i in range(60)]
    model = language.train_language(table(rows, DOCS))
    assert model.names == ("en", "xx") and all(model.texts)
    learned = "\n".join(model.texts)
    for i, t, lang, _ in rows:
        if lang is None or zlib.crc32(str(i).encode()) % 4 == 2:
            assert t not in learned
    none = language.train_language(table([], DOCS))
    assert none.names == () and language.predict_language(table(rows, DOCS), none).first().lang_pred == "und"


def test_many_letters_stay_bounded():
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 3000))
    assert language.symbol_table(text).max() < 2 + language.OWN_SYMBOLS + language.FOLDED


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_language(docs, language.train_language(docs)).where("held_out").join(docs, "doc_id")
    row = got.selectExpr("avg(cast(lang_pred = lang as int)) as a").first()
    assert row.a > 0.97


# ---- MinHash -------------------------------------------------------------------------------------


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures_do_not_depend_on_blocks(monkeypatch):
    texts = [minhash.clean(r[1]) for r in documents()]
    want = minhash.signatures(texts)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert (minhash.signatures(texts) == want).all()
    assert (np.concatenate([minhash.signatures([t]) for t in texts]) == want).all()
    h, n = minhash.shingle_hashes(texts)
    a, b = minhash.permutations()
    at = 0
    for i, c in enumerate(n):
        low = (h[at : at + c, None] * a + b).min(axis=0) if c else np.full(128, minhash.EMPTY, np.uint32)
        assert (want[i] == low).all()
        at += c


def test_edited_fingerprints(table):
    rows = [r for r in documents() if r[0] not in (13, 14)]
    got = {(r.doc_id, r.n_chars): r for r in minhash.edited_fingerprints(table(rows, DOCS)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(got) == len(rows)
    for r, after in zip(order, order[1:] + order[:1]):
        t, following = r[1] or "", after[1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        g = got[r[0], len(t)]
        assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == pytest.approx(jaccard(shingles(t), shingles(edited)), abs=0.2)
        assert g.near_next == pytest.approx(jaccard(shingles(t), shingles(following)), abs=0.2)
    assert got[1, len(order[0][1])].fingerprint == got[2, len(order[0][1])].fingerprint
    assert minhash.edited_fingerprints(table([], DOCS)).count() == 0


def test_lone_document_follows_itself(table):
    r = minhash.edited_fingerprints(table([(1, "a b c d e f g h", "en", "s")], DOCS)).first()
    assert r.near_next == 1.0


def test_near_classes(table):
    rows = documents()
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    up = list(range(n))
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8 or sets[i] == sets[j]]
    for _ in range(n):
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[up[i]] = min(least.get(up[i], r[0]), r[0])
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_classes(table(rows, DOCS)).collect()), key=str)
    assert got == sorted(((r[0], least.get(up[i])) for i, r in enumerate(rows)), key=str)
