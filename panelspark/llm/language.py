"""Language identification by cross-parsing: the language whose text explains a document in fewest phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import small_batches

#: bounds of the training sample: rows per language, code points of all languages together
TRAIN_ROWS = 200
TRAIN_CHARS = 160_000
#: a text is parsed in blocks of so many code points; no phrase crosses their borders
BLOCK = 512
#: symbols of the automata: 0 is any letter never learned, 1 is whatever stands between words
OWN_SYMBOLS = 40
FOLDED = 22
UNKNOWN = "und"
#: text parsed at once
LANES = 4096

_built: dict[str, tuple[list[np.ndarray], np.ndarray, np.ndarray]] = {}


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Transitions (states x symbols, -1: none) of the smallest automaton that accepts every substring of ``codes``."""
    step = np.full((2 * len(codes) + 1, symbols), -1, dtype=np.int32)
    length, link = [0], [-1]
    last = 0
    for c in codes:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and step[p, c] < 0:
            step[p, c] = now
            p = link[p]
        if p >= 0:
            q = int(step[p, c])
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step[twin] = step[q]
                while p >= 0 and step[p, c] == q:
                    step[p, c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step[: len(length)]


def parser(codes: list[int], symbols: int) -> np.ndarray:
    """The automaton as a table for greedy parsing: 2 * next state + (a new phrase begins here).

    Where a match cannot go on, the symbol opens the next phrase; a symbol that the language lacks is a phrase alone.
    """
    step = suffix_automaton(codes, symbols)
    opened = np.maximum(step[0], 0) * 2 + 1
    table = np.where(step >= 0, step * 2, opened[None, :])
    table[0] = opened  # whatever leaves the root opens a phrase
    return table.astype(np.int32).ravel()


@dataclass(frozen=True)
class CrossParser:
    """Labelled text per language, cut to a fixed total; tables are built once per worker."""

    names: tuple[str, ...]
    texts: tuple[str, ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.names, self.texts)).encode()).hexdigest()

    def tables(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(table per language, symbol of each code point, log2 of each language's text size)."""
        if self.key not in _built:
            symbol = symbol_table("".join(self.texts))
            codes = [symbol[as_points(t)].tolist() for t in self.texts]
            _built.clear()
            n = 2 + OWN_SYMBOLS + FOLDED
            _built[self.key] = [parser(c, n) for c in codes], symbol, np.log2([len(c) + 2 for c in codes])
        return _built[self.key]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of every whole text.

        Phrases are normalised: their number times log2 of the language's text size, per code point. The fewest win, ties go to the
        first name. score is the lead over the second: 0 for a tie, 1 for a language alone. ``und`` and 0 for a text
        that is null or has no letter, or if no language was learned.
        """
        tables, symbol, cost = self.tables()
        points = [as_points(t or "") for t in texts]
        lettered = np.array([bool((symbol[p] != 1).any()) for p in points], dtype=bool)
        if not len(self.names):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        blocks, owner = [], []
        for i, p in enumerate(points):
            codes = squeeze(symbol[p])
            for at in range(0, len(codes), BLOCK):
                blocks.append(codes[at : at + BLOCK])
                owner.append(i)
        phrases = np.zeros((len(self.names), len(texts)))
        for lo in range(0, len(blocks), LANES):
            some = blocks[lo : lo + LANES]
            counts = parse(some, tables)
            for k in range(len(tables)):
                phrases[k] += np.bincount(owner[lo : lo + LANES], counts[k], minlength=len(texts))
        scaled = phrases * cost[:, None]
        best = scaled.argmin(axis=0)
        ordered = np.sort(scaled, axis=0)
        second = ordered[1] if len(ordered) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(second), 1.0, (second - ordered[0]) / np.maximum(second, 1e-9))
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def as_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def symbol_table(text: str) -> np.ndarray:
    """Symbol of every code point: 1 for all that is no letter, letters without case.

    With at most OWN_SYMBOLS + FOLDED letters each has its own; else the commonest have, and the others share the rest
    by their code point, so the size is fixed for any script.
    """
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for p in range(0x40000):  # no letters are assigned to the planes behind
        c = chr(p)
        if c.isalpha():
            letter[p] = True
            low = c.lower()
            lower[p] = ord(low) if len(low) == 1 else p
    points, counts = np.unique(lower[as_points(text)], return_counts=True)
    counts, points = counts[letter[points]], points[letter[points]]
    points = points[np.argsort(-counts, kind="stable")]
    symbol = np.zeros(0x110000, dtype=np.uint8)
    own = len(points) if len(points) <= OWN_SYMBOLS + FOLDED else OWN_SYMBOLS
    symbol[points[:own]] = 2 + np.arange(own)
    rest = points[own:]
    symbol[rest] = 2 + OWN_SYMBOLS + rest % FOLDED
    symbol = symbol[lower]
    symbol[~letter] = 1
    return symbol


def squeeze(codes: np.ndarray) -> np.ndarray:
    """Runs of what is no letter count as one symbol."""
    if not len(codes):
        return codes
    keep = codes != 1
    keep[0] = True
    keep[1:] |= codes[:-1] != 1
    return codes[keep]


def parse(blocks: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Phrases of every block in every language; all blocks step together."""
    size = np.array([len(b) for b in blocks])
    order = np.argsort(-size, kind="stable")
    width = int(size.max(initial=0))
    grid = np.zeros((width, len(blocks)), dtype=np.int32)
    for place, i in enumerate(order.tolist()):
        grid[: size[i], place] = blocks[i]
    alive = np.searchsorted(-size[order], -np.arange(width), side="left")
    n = 2 + OWN_SYMBOLS + FOLDED
    out = np.zeros((len(tables), len(blocks)))
    for k, table in enumerate(tables):
        state = np.zeros(len(blocks), dtype=np.int32)
        count = np.zeros(len(blocks), dtype=np.int32)
        for t in range(width):
            m = alive[t]
            got = table[state[:m] * n + grid[t, :m]]
            count[:m] += got & 1
            state[:m] = got >> 1
        out[k, order] = count
    return out


def train_language(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> CrossParser:
    """Learn from a bounded sample of rows outside the held-out fold: text and non-null lang only.

    Per language the rows with the lowest text hashes, about ``train_rows`` of them, are read; their letters fill
    ``train_chars`` / number of languages code points. The cut-off of the hash comes from a count of narrow rows, so no
    language, however common, meets in one task. Repeated texts count once.
    """
    fold = docs.where(~is_held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    fold = fold.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    # distinct texts, so that copies of one text can't push a language's cut-off below all the others
    counted = fold.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    counts = {r["lang"]: max(r["n"], 1) for r in counted.collect()}  # one row per language
    if not counts:
        return CrossParser((), ())
    place = F.xxhash64("text") / F.lit(float(1 << 64)) + 0.5
    low = F.lit(False)
    for lang, n in counts.items():
        low = low | ((F.col("lang") == lang) & (place <= 2.0 * train_rows / n))
    cut = train_chars // len(counts)
    rows = fold.where(low).select("lang", F.substring("text", 1, cut).alias("text"), F.xxhash64("text").alias("h")).distinct()
    # at most train_rows per language leave Spark; each brings no more than fits the sample
    first = rows.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, train_rows).alias("rows"))
    texts = {r["lang"]: "\n".join(x["text"] for x in r["rows"])[:cut] for r in first.collect()}
    names = tuple(sorted(texts))
    return CrossParser(names, tuple(texts[n] for n in names))


def predict_language(docs: DataFrame, model: CrossParser) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``, from whole texts and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            for lo in range(0, b.num_rows, 512):
                part = texts.slice(lo, 512)
                lang, score = model.predict(part.to_pylist())
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(lo, 512), "lang_pred": lang, "score": pa.array(score, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = small_batches(rows).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
