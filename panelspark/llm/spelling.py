"""Spelling variants: words one edit apart, found through pivotal grams, and the form each word belongs to.

A word's bigrams are ordered by rarity. Its prefix holds the three rarest (with all that tie with the third), which
always contain two that share no letter; the two rarest of that kind are its pivots. One edit leaves a pivot of one
of two near words untouched, namely of the word whose prefix ends with the rarer bigram, and that bigram is then in
the prefix of the other word. What the edit leaves alone also stands at a known place: if the edit is to the right of
the pivot, both words agree from their start up to it, and if it is to the left, from it to their end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import small_batches
from panelspark.llm.words import CRC_TABLE_SQL, crc32_sql
from panelspark.session import materialize

MIN_LETTERS = 6
MIN_COUNT = 5
#: a form is so many times as frequent as its variant
RATIO = 5
#: one run in so many loses a letter
DAMAGE = 199
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER = {c: c + 32 for c in range(65, 91)}
GRAM = 2
PREFIX = 3
#: counted words are handed on beyond so many
FLUSH = 200_000


# ---- words and their counts --------------------------------------------------------------------


def damaged(doc_id: int | None, run: str, every: int) -> str:
    """``run``, without one letter where its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters of every whole text, A-Z lower-cased, after the damage, with at least so many letters and places.

    A null text has no words; a missing doc_id is hashed as empty. ``every`` = 0 leaves the runs alone. A task counts
    before the shuffle and hands its counts on whenever it holds ``FLUSH`` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_runs = re.compile(f"[{LETTERS}]{{{min_letters},}}")
        found: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                # shorter runs never become words, as damage only takes letters away
                for run, n in Counter(m[0] for m in long_runs.finditer(text)).items():
                    low = run.lower() if run.isascii() else run.translate(UPPER)
                    found[damaged(doc_id, low, every)] += n
                if len(found) > FLUSH:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counts = small_batches(texts).mapInArrow(count, "word string, n long").where(F.length("word") >= min_letters)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- pairs -------------------------------------------------------------------------------------


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams of the distinct words, rarest first: at most the square of the alphabet, whatever the number of words."""
    at = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.where(F.length("word") >= GRAM).select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}


def pivots(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two (rank, place) of ``prefix`` that share no letter, with the least sum of ranks: dynamic programming by place."""
    order = sorted((place, rank) for rank, place in prefix)
    best, single = None, []
    for place, rank in order:
        # single[j]: the rarest bigram among the first j + 1 places
        fit = [s for p, s in zip((p for p, _ in order), single) if p + GRAM <= place]
        if fit and (best is None or fit[-1][0] + rank < best[0]):
            best = (fit[-1][0] + rank, [fit[-1], (rank, place)])
        single.append(min(single[-1], (rank, place)) if single else (rank, place))
    return best[1] if best else [(rank, place) for place, rank in order]


def signature(word: str, ranks: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """Rank of the last bigram of the prefix, places of the pivots, places of the prefix."""
    grams = sorted((ranks[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    prefix = [g for g in grams if g[0] <= last]
    return last, [p for _, p in pivots(prefix)], [p for _, p in prefix]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of ``words`` (word, distinct) that differ by one inserted, deleted or replaced code point.

    Words need at least six letters, so that a prefix holds two bigrams without a common letter. Index rows meet by
    equality of the part of the word that the edit left alone and of the length, so rows grow with the words and the
    true candidates; a part shared by very many words is a skewed key, which adaptive execution splits.
    """
    ranks = gram_ranks(words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                out = []
                for w in b.slice(lo, 4096).column("word").to_pylist():
                    last, chosen, prefix = signature(w, ranks)
                    out += [(w, last, len(w), "<" + w[: p + GRAM], p in chosen) for p in prefix]
                    out += [(w, last, len(w), ">" + w[p:], p in chosen) for p in prefix]
                yield pa.record_batch(list(map(list, zip(*out))) or [[]] * 5, schema=schema)

    schema = pa.schema([("word", pa.string()), ("last", pa.int32()), ("length", pa.int32()), ("part", pa.string()), ("pivot", pa.bool_())])
    rows = materialize(words.select("word").mapInArrow(index, "word string, last int, length int, part string, pivot boolean"), "grams")
    probes = rows.where("pivot").select(
        F.col("word").alias("a"), F.col("last").alias("a_last"), "part",
        F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"),
    )
    held = rows.select(F.col("word").alias("b"), F.col("last").alias("b_last"), "part", "length")
    met = probes.join(held, ["part", "length"]).where("a <> b AND a_last <= b_last")
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---- forms -------------------------------------------------------------------------------------


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), one row per word.

    Forms lead to words at least ``ratio`` times as frequent, so a chain is as long as a logarithm of the largest count;
    roots follow it by doubling.
    """
    words = materialize(words, "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # the largest n, then the smallest word in code-point order, which is that of the bytes
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    out = words.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    out = out.select(
        "word", F.when(fits, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    out = materialize(out, "forms")
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = roots.join(ahead, "root", "left")
        step = materialize(step.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "roots")
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    out = out.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = DAMAGE, ratio: int = RATIO) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with their variants: see ``word_counts`` and ``variant_forms``.

    Null and empty texts have no words, an empty table has no rows, equal rows count each, other columns are ignored.
    """
    return variant_forms(word_counts(docs, min_letters, min_count, every), ratio)


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT doc_id, run, k, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM runs, crc_table
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS part
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y USING (i, part) WHERE x.word <> y.word
  UNION SELECT x.word, y.word FROM cut x JOIN words y ON x.part = y.word WHERE x.word <> y.word
  UNION SELECT y.word, x.word FROM cut x JOIN words y ON x.part = y.word WHERE x.word <> y.word
), best AS (
  SELECT a, count(*) AS n_near, min({{'less': -n, 'word': b}}) AS best FROM near JOIN words ON b = word GROUP BY a
), forms AS (
  SELECT w.word, CASE WHEN -best.less >= 5 * n THEN best.word END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM words w LEFT JOIN best ON a = w.word
), chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) USING (word)
"""
