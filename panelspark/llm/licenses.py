"""License scan: exact phrases by words, and short notices with a few edits."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import small_batches
from panelspark.llm.words import ALNUM, utf8

#: phrase -> label; places where exactly these words stand consecutively
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: (label, notice, most edits); an edit is a character put in, left out or changed
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person", 4),
    ("apache-2", "licensed under the apache license version 2 0", 4),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by", "licensed under cc by 4 0", 2),
    ("cc-by-sa", "licensed under cc by sa 4 0", 2),
    ("gpl-3", "gnu general public license version 3", 3),
    ("gpl-2", "gnu general public license version 2", 3),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl-3", "gnu affero general public license version 3", 4),
    ("mpl-2", "mozilla public license version 2 0", 3),
    ("bsd", "redistribution and use in source and binary forms", 3),
    ("isc", "permission to use copy modify and or distribute this software", 4),
    ("unlicense", "this is free and unencumbered software released into the public domain", 4),
    ("rights-reserved", "all rights reserved", 1),
)


@dataclass(frozen=True)
class Notice:
    """A notice, cut into one more piece than it may have edits: any match holds at least one piece unchanged."""

    label: str
    text: str
    edits: int

    @property
    def pieces(self) -> list[tuple[int, str]]:
        n = self.edits + 1
        cuts = [round(i * len(self.text) / n) for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    @property
    def pattern(self):
        return _compiled(self.text, self.edits)


@cache
def _compiled(text: str, edits: int):
    return regex.compile(f"(?e)(?:{regex.escape(text)}){{e<={edits}}}")


def normal(text: str | None) -> str:
    """The words of a text, each with a space before it, and a space at the end."""
    words = utf8(text).translate(ALNUM).split()
    return (b" " + b" ".join(words) + b" ").decode() if words else ""


def places(line: str, phrase: str) -> list[int]:
    """Character places in ``line`` where the whole words of ``phrase`` stand; overlaps count."""
    out, at, key = [], 0, f" {phrase} "
    while (at := line.find(key, at)) >= 0:
        out.append(at)
        at += 1
    return out


def fuzzy_spans(line: str, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches of a notice in ``line``, left to right and not overlapping.

    Pieces found unchanged give windows where a match may lie; windows that touch are one. Inside a window the next
    match of at most ``notice.edits`` edits is taken, with as few as it can have, then the next behind it.
    """
    windows, size, slack = [], len(notice.text), notice.edits
    for offset, piece in notice.pieces:
        at = line.find(piece)
        while at >= 0:
            windows.append((max(0, at - offset - slack), min(len(line), at - offset + size + slack)))
            at = line.find(piece, at + 1)
    merged: list[list[int]] = []
    for a, b in sorted(windows):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        # without the borders of words: a notice may begin or end inside a longer word
        for m in _compiled(notice.text, notice.edits).finditer(line, a, b):
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
    return out


def scan(text: str | None, phrases: dict[str, str] | None = None, notices: tuple = NOTICES) -> dict:
    """Words, base places, and fuzzy matches (label, start, end, edits) of one whole text; places count words."""
    line = normal(text)
    base = [(at, label) for phrase, label in (PHRASES if phrases is None else phrases).items() for at in places(line, phrase)]
    raw = [(notice, *span) for notice in (Notice(*n) for n in notices) for span in fuzzy_spans(line, notice)] if line else []
    found = []
    if base or raw:
        opens = [m.start() for m in regex.finditer(" ", line)][:-1]  # one before each word
        base = [(bisect_left(opens, at), label) for at, label in base]
        for notice, a, b, edits in raw:
            first = bisect_right(opens, a) - 1
            last = max(bisect_left(opens, b - (line[b - 1] == " ")) - 1, first)
            found.append((notice.label, first, last, edits, 1 - edits / (notice.edits + 1)))
    return {"n_words": max(line.count(" ") - 1, 0), "base": sorted(base), "found": best_matches(found)}


def best_matches(found: list[tuple]) -> list[tuple]:
    """Matches in text order; of those that share a word the best stays: fewest edits, then most words, then label."""
    kept, taken = [], set()
    for x in sorted(found, key=lambda x: (x[3], x[1] - x[2], x)):
        words = range(x[1], x[2] + 1)
        if taken.isdisjoint(words):
            taken.update(words)
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,last:long,edits:int>>"
)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple = NOTICES) -> DataFrame:
    """One row per row of ``docs``: words, base places, labels, score and the spans of fuzzy matches.

    ``base_labels`` come from exact phrases, ``labels`` from these and the fuzzy notices; both are distinct, sorted and
    comma-joined, empty without any. ``score`` is 1 with an exact phrase, else the best match's 1 - edits / (most edits
    + 1), else 0. Null or empty texts have no words, labels or places. Each row stands alone, so repeated rows agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for i, text in zip(ids, b.column("text").to_pylist()):
                s = scan(text, phrases, notices)
                base, found = s["base"], s["found"]
                labels = sorted({x[1] for x in base})
                out.append(
                    {
                        "doc_id": i, "n_words": s["n_words"], "n_base": len(base), "first_word": base[0][0] if base else None,
                        "last_word": base[-1][0] if base else None, "base_labels": ",".join(labels),
                        "labels": ",".join(sorted({*labels, *(x[0] for x in found)})),
                        "score": 1.0 if base else max((x[4] for x in found), default=0.0),
                        "spans": [dict(zip(("label", "first", "last", "edits"), x)) for x in found],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=types)

    types = docs.sparkSession.createDataFrame([], SCAN).toArrow().schema
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, SCAN)
