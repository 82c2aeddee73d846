"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import small_batches
from panelspark.llm.words import chunks, utf8

#: bounds of the training sample: labelled documents, and lines taken from each
TRAIN_DOCS = 2500
TRAIN_LINES = 400
ROUNDS = 200
STEP = 0.5
RIDGE = 1e-4
THRESHOLD = 0.3
FOLDS = 5

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#$%&*+<=>@[\\]^_`{}~/")] = True
#: shares whose values on the neighbouring lines are features too
SHARES = 8
FEATURES = 1 + 12 + 2 * SHARES + 2


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line + 1, lines per text) of whole texts; a text has at least one line."""
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, dtype=np.uint8)
    end = np.flatnonzero(buf == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    size = end - start
    text_end = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    first = np.concatenate([[0], np.searchsorted(end, text_end[:-1] - 1) + 1])
    lines = np.diff(np.concatenate([first, [len(end)]]))

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[end] - sums[start]

    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    letter = ((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 128)
    opens = ~space
    opens[1:] &= space[:-1]
    words = np.maximum(count(opens), 1)
    # a word equals the one before if both have as many bytes and the same sum of weighted bytes
    at = np.flatnonzero(opens)
    weight = np.cumsum(np.where(space, 0, buf.astype(np.int64) ** 2 + 7))
    close = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    total = weight[close] - weight[at] + buf[at].astype(np.int64) ** 2
    length = close - at
    same = np.zeros(len(buf), dtype=bool)
    if len(at) > 1:
        same[at[1:][(total[1:] == total[:-1]) & (length[1:] == length[:-1])]] = True
    n = np.maximum(size, 1)
    letters = np.maximum(count(letter), 1)
    shares = np.stack(
        [
            count((buf >= 65) & (buf <= 90)) / letters, count(SYMBOLS[buf]) / n * 4, count(buf == 33) / n * 8, count(buf == 124) / n * 8,
            count((buf >= 48) & (buf <= 57)) / n * 4, count(same) / words, np.minimum(size / words / 10, 4), count(letter) / n,
        ],
        axis=1,
    )
    last = buf[np.maximum(end - 1, start)]
    own = np.concatenate(
        [
            shares, np.log1p(words)[:, None] / 5, (count((buf == 46) | (buf == 44)) / words)[:, None],
            np.isin(last, list(b".?!"))[:, None], (size == 0)[:, None],
        ],
        axis=1,
    )
    is_first, is_last = np.zeros(len(end), dtype=bool), np.zeros(len(end), dtype=bool)
    is_first[first], is_last[first + lines - 1] = True, True
    before, after = np.roll(shares, 1, axis=0), np.roll(shares, -1, axis=0)
    before[is_first], after[is_last] = 0, 0
    x = np.concatenate([np.ones((len(end), 1)), own, before, after, is_first[:, None], is_last[:, None]], axis=1)
    return x, size + 1, lines


def forward_backward(unary: np.ndarray, pair: np.ndarray, lines: np.ndarray):
    """(marginal of state 1 per line, pairwise marginal sums per text of shape (texts, 2, 2)).

    ``unary`` is the score of state 1 against 0 per line, ``pair`` the 2 x 2 transition scores. All texts step
    together, the longest first, so the loop runs as often as the longest text has lines.
    """
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    count = lines[order]
    n, longest = len(unary), int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(longest), side="left")
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[:, 1] = unary
    for t in range(1, longest):
        at = first[: alive[t]] + t
        p = f[at - 1]
        f[at, 0] = np.logaddexp(p[:, 0] + pair[0, 0], p[:, 1] + pair[1, 0])
        f[at, 1] += np.logaddexp(p[:, 0] + pair[0, 1], p[:, 1] + pair[1, 1])
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        q0, q1 = b[at + 1, 0], b[at + 1, 1] + unary[at + 1]
        b[at, 0] = np.logaddexp(pair[0, 0] + q0, pair[0, 1] + q1)
        b[at, 1] = np.logaddexp(pair[1, 0] + q0, pair[1, 1] + q1)
    both = f + b
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    norm = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((len(lines), 2, 2))
    inner = np.ones(n, dtype=bool)
    inner[(np.cumsum(lines) - lines)] = False
    at = np.flatnonzero(inner)
    owner = np.repeat(np.arange(len(lines)), lines)[at]
    for i in range(2):
        for j in range(2):
            z = f[at - 1, i] + pair[i, j] + (unary[at] if j else 0) + b[at, j] - norm[at]
            pairs[:, i, j] = np.bincount(owner, np.exp(z), minlength=len(lines))
    return marginal, pairs


@dataclass(frozen=True)
class LineField:
    """Weights of the field: one per line feature for the state "good", and four transitions."""

    weights: np.ndarray
    pair: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the marginals of "good" over all lines of each whole text."""
        out = np.zeros(len(texts))
        raw = [utf8(t) for t in texts]
        for lo, hi in chunks(raw, len):
            x, size, lines = line_features(raw[lo:hi])
            marginal, _ = forward_backward(x @ self.weights, self.pair, lines)
            owner = np.repeat(np.arange(hi - lo), lines)
            out[lo:hi] = np.bincount(owner, marginal * size) / np.bincount(owner, size)
        return out


def fit_field(x: np.ndarray, lines: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> LineField:
    """Maximum conditional likelihood, every line of a text taking its text's label; Adam on all texts at once.

    Texts weigh alike whatever their length. Without texts all weights stay 0 and every score is 0.5.
    """
    theta = np.zeros(FEATURES + 4)
    if not len(lines):
        return LineField(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
    owner = np.repeat(np.arange(len(lines)), lines)
    y = labels[owner].astype(float)
    w = 1.0 / lines[owner]
    steps = np.zeros((len(lines), 2, 2))
    steps[np.arange(len(lines)), labels, labels] = lines - 1
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        pair = theta[FEATURES:].reshape(2, 2)
        marginal, pairs = forward_backward(x @ theta[:FEATURES], pair, lines)
        up = x.T @ ((y - marginal) * w)
        over = ((steps - pairs) / lines[:, None, None]).sum(axis=0)
        grad = np.concatenate([up, over.ravel()]) / len(lines) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineField(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def train_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineField:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    At most ``train_docs`` labels, lowest hashes of doc_id first, and the first ``train_lines`` lines of each text;
    their line features are computed by Spark and only these come to the driver. A doc_id labelled several times
    takes its lowest label; null labels and null ids are left out.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    named = named.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.min("label").alias("label"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    local = named.toArrow()
    if not local.num_rows:
        return fit_field(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0, int))
    named = docs.sparkSession.createDataFrame(local, schema=named.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                x, _, _ = line_features([b"\n".join(utf8(text).split(b"\n", train_lines)[:train_lines])])
                yield pa.record_batch({"label": pa.array([label], pa.int32()), "x": [x.astype(np.float32).tobytes()]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # of rows that share a doc_id the one with the least text hash, whatever their order
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = texts.join(F.broadcast(named), "doc_id").groupBy("doc_id", "label").agg(least).select("text", "label")
    rows = sorted((r["label"], bytes(r["x"])) for r in small_batches(sample).mapInArrow(run, "label int, x binary").collect())
    xs = [np.frombuffer(r[1], dtype=np.float32).reshape(-1, FEATURES).astype(float) for r in rows]
    if not xs:
        return fit_field(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0, int))
    return fit_field(np.concatenate(xs), np.array([len(x) for x in xs]), np.array([r[0] for r in rows]))


def score_quality(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``, from whole texts and nothing else.

    A null or empty text counts as one empty line and gets a score too. Repeated rows score alike; a null doc_id is
    not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = field.scores(b.column("text").to_pylist())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(score, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = small_batches(rows).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(field.scores(b.column("text").to_pylist()) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
