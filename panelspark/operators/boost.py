"""Boosted trees and stumps, and forests, over binned columns.

Columns are cut into bins once and the bins written as blocks, a byte per cell. A round of stumps, or one level of a
tree, is then a single pass: every block adds its rows to a (node, column, bin) histogram, histograms are summed by shares
of the columns, and each share sends its best splits, so what the driver gets has nothing to do with rows, bins or tasks.
Rows are never collected. Blocks are dealt evenly over the cores. The running weight or margin of a row is replayed from
the latest trees and written out every ``KEEP`` trees, so a lost executor re-reads blocks and replays a few trees at
most; a worker that saw the block before starts from the margins it holds.

Trees see rows of equal bins, label and weight alike, so such rows can be merged into one counted row. Few columns have few
such rows whatever the size of the table; rows that fit into one block are fitted in the task that reads it, tree after tree.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize

BINS = 64
BLOCK_ROWS = 1 << 14
#: trees replayed at most before margins are written
KEEP = 25
QUANTILE_ERROR = 0.001
#: bytes of margins that a worker holds
HELD_BYTES = 128 << 20
#: bytes of a histogram that one task sums; larger ones are cut by columns
SHARE_BYTES = 1 << 18
#: bytes of the histograms of trees of a forest that grow together
FOREST_BYTES = 32 << 20
#: points of each class that stand for its share of the weight when columns are cut by weight
GRID = 256
STATE = "id string, x binary, y binary, w binary, m binary, n binary"


def bin_cuts(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 rising bounds per column, from approximate quantiles in one pass; at most 255 bins."""
    probs = [i / bins for i in range(1, min(bins, 255))]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(list(cols), probs, QUANTILE_ERROR)
    return [sorted({v for v in f if math.isfinite(v)}) for f in found]


def weighted_cuts(df: DataFrame, cols: list[str], label: str, weight: str, bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 rising bounds per column: all values but the last of a column that has few, else quantiles by weight.

    The weight is that of the class; quantiles come from ``GRID`` points of every class, each with its share of the weight.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], F.col(label).alias("_y"), F.col(weight).alias("_w"))
    names = [f"_{i}" for i in range(len(cols))]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a value more than there are bins is enough to tell that there are many
        seen = [np.zeros(0) for _ in names]
        for b in batches:
            for i in range(len(names)):
                if len(seen[i]) <= bins:
                    seen[i] = np.unique(np.append(seen[i], b.column(i).to_numpy(zero_copy_only=False)))[: bins + 1]
        at = np.repeat(np.arange(len(names)), [len(v) for v in seen])
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.concatenate([*seen, np.zeros(0)]))], ["i", "v"])

    few = {}
    for r in rows.select(*names).mapInArrow(some, "i int, v double").groupBy("i").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():
        few[r["i"]] = r["v"] if len(r["v"]) <= bins else None
    wide = [i for i in range(len(cols)) if few.get(i) is None]
    points: dict[int, list[tuple[float, float]]] = {i: [] for i in wide}
    if wide:
        for c in rows.groupBy("_y").agg(F.sum("_w").alias("w")).orderBy("_y").collect():
            grid = rows.where(F.col("_y") == F.lit(c["_y"])).approxQuantile([names[i] for i in wide], [(i + 0.5) / GRID for i in range(GRID)], QUANTILE_ERROR)
            for i, g in zip(wide, grid):
                points[i] += [(v, c["w"] / GRID) for v in g]
    out = []
    for i in range(len(cols)):
        if i not in points:
            out.append(few[i][:-1])
            continue
        v, w = np.array(sorted(points[i])).reshape(-1, 2).T
        up = np.cumsum(w)
        at = np.searchsorted(up, up[-1] * np.arange(1, bins) / bins) if len(v) else []
        out.append(np.unique(v[at]).tolist() if len(v) else [])
    return out


def binned_blocks(
    df: DataFrame, cols: list[str], label: str, cuts: list[list[float]], weight: str | None = None, merge: bool = False, classes: bool = False
) -> DataFrame:
    """Blocks of (name, bins, labels, weights, zeros, rows), written once. Bin j holds values up to bound j; missing ones go to the last.

    Rows without a label are left out. ``merge`` makes one of rows with equal bins, label and weight, with the sum of their weights;
    blocks are then full but for one of each task, and named by what they hold. ``classes`` keeps labels, which else are 1 or not.
    """
    bounds = [np.array(c) for c in cuts]

    def binned(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols) + 2)]
        # a missing value sorts behind all bounds
        x = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(bounds, v)]).astype(np.uint8)
        return x, v[-2].astype(np.uint8) if classes else (v[-2] == 1).astype(np.uint8), v[-1].astype(float)

    def merged(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(b.num_rows, len(cols)).T
        n = b.column("n").to_numpy().astype(float)
        return x, b.column("y").to_numpy().astype(np.uint8), b.column("w").to_numpy(zero_copy_only=False).astype(float) * n, n

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, w = binned(b)
            ends = pa.py_buffer((np.arange(len(y) + 1) * len(cols)).astype(np.int32))
            key = pa.Array.from_buffers(pa.binary(), len(y), [None, ends, pa.py_buffer(np.ascontiguousarray(x.T))])
            yield pa.record_batch([key, pa.array(y, pa.int16()), pa.array(w)], ["x", "y", "w"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(merged(b) if merge else (*binned(b), np.ones(b.num_rows)))
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield block(held)
                held, rows = [], 0
        if rows:
            yield block(held)

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, w, n = (np.concatenate(part, axis=-1) for part in zip(*held))
        parts = [x.tobytes(), y.tobytes(), w.tobytes(), np.zeros(len(w)).tobytes(), n.tobytes()]
        # merged rows are in one block each, so what a block holds is in no other
        name = hashlib.md5(b"".join(parts)).hexdigest() if merge else uuid.uuid4().hex
        return pa.record_batch([pa.array([name]), *[pa.array([c], pa.binary()) for c in parts]], ["id", "x", "y", "w", "m", "n"])

    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{i}") for i, c in enumerate(cols)]
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull()).select(*numbers, F.col(label).cast("double").alias("_y"), weights.alias("_w"))
    if merge:
        rows = rows.mapInArrow(cells, "x binary, y short, w double").groupBy("x", "y", "w").agg(F.count(F.lit(1)).alias("n"))
        rows = materialize(rows.sortWithinPartitions("x", "y", "w"), "merged")
        if rows.count() <= BLOCK_ROWS:
            rows = rows.coalesce(1).sortWithinPartitions("x", "y", "w")
    return materialize(rows.mapInArrow(pack, STATE), "blocks")


@dataclass
class Block:
    id: str
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    m: np.ndarray
    n: np.ndarray | None = None


def _unpacked(row, columns: int) -> Block:
    y = np.frombuffer(row["y"], np.uint8)
    x = np.frombuffer(row["x"], np.uint8).reshape(columns, len(y))
    return Block(row["id"], x, y, *(np.frombuffer(row[k]) for k in ("w", "m", "n")))


def _blocks(state: DataFrame, columns: int) -> RDD:
    """The blocks as arrays, as many in each task, held in memory or on disk; what is lost is read again from the written table."""

    def unpack(row) -> tuple[str, Block]:
        return row["id"], _unpacked(row, columns)

    place = {r["id"]: i for i, r in enumerate(state.select("id").orderBy("id").collect())}
    tasks = max(1, min(len(place), state.sparkSession.sparkContext.defaultParallelism))
    return state.rdd.map(unpack).partitionBy(tasks, lambda name: place[name]).values().persist(StorageLevel.MEMORY_AND_DISK)


#: margins of the blocks a worker saw lately: (run, block) -> (number of trees, margins)
_held: OrderedDict[tuple[str, str], tuple[int, np.ndarray]] = OrderedDict()


def _replayed(run: str, b: Block, trees: list, replay: Callable[[Block, np.ndarray, list], np.ndarray]) -> np.ndarray:
    """Margins of a block after ``trees``, from those that the worker holds if it has met the block, else from the written ones."""
    done, margins = _held.pop((run, b.id), (0, b.m))
    if done > len(trees):
        done, margins = 0, b.m
    margins = replay(b, margins, trees[done:])
    _held[run, b.id] = len(trees), margins
    size = sum(m.nbytes for _, m in _held.values())
    while size > HELD_BYTES and len(_held) > 1:
        size -= _held.popitem(last=False)[1][1].nbytes
    return margins


class Rounds:
    """Blocks whose margins follow the trees added so far."""

    def __init__(self, blocks: DataFrame, columns: int, replay: Callable[[Block, np.ndarray, list], np.ndarray]):
        self.state, self.columns, self.replay, self.recent = blocks, columns, replay, []
        self.rows, self.run = _blocks(blocks, columns), uuid.uuid4().hex

    def _total(self, histogram: Callable[[Block, np.ndarray], np.ndarray], shape: tuple) -> Callable[[Iterator[Block]], np.ndarray]:
        run, replay, recent = self.run, self.replay, self.recent

        def of(rows: Iterator[Block]) -> np.ndarray:
            total = np.zeros(shape)
            for b in rows:
                total += histogram(b, _replayed(run, b, recent, replay))
            return total

        return of

    def sum(self, histogram: Callable[[Block, np.ndarray], np.ndarray], shape: tuple) -> np.ndarray:
        """Sum of the histograms of all blocks: one array a task, added up in a tree of tasks."""
        total = self._total(histogram, shape)
        return self.rows.mapPartitions(lambda rows: [total(rows)]).treeReduce(np.add)

    def best(self, histogram: Callable[[Block, np.ndarray], np.ndarray], shape: tuple, choose: Callable[[int, np.ndarray], object]) -> list:
        """``choose(first column, sums)`` of every share of the columns, which are the first axis of the histograms."""
        total, columns = self._total(histogram, shape), shape[0]
        shares = min(columns, -(-8 * math.prod(shape) // SHARE_BYTES), 4 * self.rows.getNumPartitions())
        cuts = [columns * i // shares for i in range(shares + 1)]

        def part(rows: Iterator[Block]) -> list[tuple[int, np.ndarray]]:
            hist = total(rows)
            return [(i, hist[lo:hi]) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]

        # one array per share leaves a task, so there is nothing to combine before the shuffle
        tasks = min(shares, self.rows.getNumPartitions())
        dealt = self.rows.mapPartitions(part).partitionBy(tasks, lambda share: share)

        def chosen(pairs: Iterator[tuple[int, np.ndarray]]) -> list:
            sums: dict[int, np.ndarray] = {}
            for i, h in pairs:
                sums[i] = sums[i] + h if i in sums else h
            return [choose(cuts[i], h) for i, h in sorted(sums.items())]

        return dealt.mapPartitions(chosen).collect()

    def add(self, tree) -> None:
        self.recent = [*self.recent, tree]
        if len(self.recent) < KEEP:
            return
        run, replay, recent = self.run, self.replay, self.recent
        written = self.rows.map(lambda b: (b.id, b.x.tobytes(), b.y.tobytes(), b.w.tobytes(), _replayed(run, b, recent, replay).tobytes(), b.n.tobytes()))
        self.state = materialize(self.state.sparkSession.createDataFrame(written, STATE), "rounds")
        self.close()
        self.rows, self.run, self.recent = _blocks(self.state, self.columns), uuid.uuid4().hex, []

    def close(self) -> None:
        self.rows.unpersist()


class InTask:
    """``Rounds`` over the only block of a table, inside the task that read it."""

    def __init__(self, block: Block, replay: Callable[[Block, np.ndarray, list], np.ndarray]):
        self.block, self.replay, self.margins = block, replay, block.m

    def sum(self, histogram: Callable[[Block, np.ndarray], np.ndarray], shape: tuple) -> np.ndarray:
        return histogram(self.block, self.margins)

    def best(self, histogram: Callable[[Block, np.ndarray], np.ndarray], shape: tuple, choose: Callable[[int, np.ndarray], object]) -> list:
        return [choose(0, histogram(self.block, self.margins))]

    def add(self, tree) -> None:
        self.margins = self.replay(self.block, self.margins, [tree])


def _fitted(blocks: DataFrame, columns: int, replay: Callable, grow: Callable[[Rounds | InTask], list]) -> list:
    """``grow`` over the blocks: from the driver, pass by pass, or all of it in one task when there is one block."""
    if blocks.count() == 1:
        return blocks.rdd.map(lambda row: grow(InTask(_unpacked(row, columns), replay))).collect()[0]
    run = Rounds(blocks, columns, replay)
    try:
        return grow(run)
    finally:
        run.close()


# ---- stumps ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stump:
    """Class ``left`` up to bound ``cut`` of column ``feature``, else ``right``; ``error`` and ``stage`` weight of its round."""

    feature: int
    cut: int
    left: int
    right: int
    error: float
    stage: float


def _log_weights(b: Block, out: np.ndarray, stumps: list[Stump]) -> np.ndarray:
    for s in stumps:
        said = np.where(b.x[s.feature] <= s.cut, s.left, s.right)
        out = out + s.stage * (said != b.y)
    return out


def stump_split(first: int, hist: np.ndarray) -> tuple:
    """(purity, -column, -bound, left, right, total) of the largest Gini decrease over (column, bin, class) weights.

    The columns start at ``first``; ties go to the first column and bound. Purity is -1 when no bound parts the rows.
    """
    total = hist[0].sum()
    if not total > 0:
        return -1.0, -first, 0, None, None, 0.0
    hist = hist / total
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = hist.sum(axis=1, keepdims=True) - left
    nl, nr = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        # the weighted purity of both sides; what it is to beat is the same for all splits
        pure = (left**2).sum(axis=2) / nl + (right**2).sum(axis=2) / nr
    pure = np.where((nl > 1e-12) & (nr > 1e-12), pure, -1.0)
    if pure.size == 0 or pure.max() < 0:
        return -1.0, -first, 0, None, None, float(total)
    # differences beyond the tenth digit come from the order of summation
    pure = np.round(pure, 10)
    feature, cut = np.unravel_index(np.argmax(pure), pure.shape)
    return float(pure[feature, cut]), -(first + int(feature)), -int(cut), left[feature, cut].tolist(), right[feature, cut].tolist(), float(total)


def best_stump(splits: list[tuple], rate: float) -> Stump | None:
    """The best of the splits of all shares of the columns; None when no bound parts the rows, or no side beats chance."""
    pure, feature, cut, l, r, _ = max(splits, key=lambda s: s[:3])
    if pure < 0:
        return None
    error = float(min(l) + min(r))
    if error >= 0.5:
        return None
    stage = rate * math.log((1 - error) / error) if error > 1e-12 else 1.0
    return Stump(-feature, -cut, int(l[1] > l[0]), int(r[1] > r[0]), max(error, 0.0), stage)


def fit_stumps(blocks: DataFrame, columns: int, bins: int, rounds: int, rate: float = 1.0) -> list[Stump]:
    """AdaBoost: rows that a stump gets wrong gain weight by its stage; one pass per round."""
    run, out, shift = Rounds(blocks, columns, _log_weights), [], 0.0

    def histogram(shift: float) -> Callable[[Block, np.ndarray], np.ndarray]:
        def of(b: Block, logs: np.ndarray) -> np.ndarray:
            w = b.w * np.exp(logs - shift)
            return np.stack([np.bincount(x.astype(np.intp) * 2 + b.y, w, 2 * bins).reshape(bins, 2) for x in b.x])

        return of

    try:
        for _ in range(rounds):
            splits = run.best(histogram(shift), (columns, bins, 2), stump_split)
            total = min(splits, key=lambda s: -s[1])[5]
            found = best_stump(splits, rate) if total > 0 else None
            # weights of the next round add up to about one
            shift += math.log(total) if total > 0 else 0.0
            if found is None:
                break
            out.append(found)
            if found.error <= 1e-12:
                break
            run.add(found)
    finally:
        run.close()
    return out


# ---- trees -------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A binary tree by heap number: 1 is the root, 2i and 2i + 1 the children of i; ``split`` is (column, bound, gain)."""

    split: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=lambda: {1: 0.0})


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.ones(x.shape[1], dtype=np.int32 if max(tree.value) < 1 << 30 else np.int64)
    for i in sorted(tree.split):
        feature, cut, _ = tree.split[i]
        at = np.flatnonzero(node == i)
        node[at] = 2 * i + (x[feature][at] > cut)
    return node


def _margins(b: Block, out: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for t in trees:
        node = leaf_of(t, b.x)
        value = np.zeros(max(t.value) + 1)
        for i, v in t.value.items():
            value[i] = v
        out = out + value[node]
    return out


@dataclass(frozen=True)
class Boosting:
    """Settings of gradient boosting with the logistic loss.

    ``newton``: splits gain by gradients over curvature, else over row weights; leaves always take a Newton step.
    """

    trees: int
    depth: int
    rate: float
    l2: float = 0.0
    newton: bool = True
    min_rows: int = 1
    min_curvature: float = 0.0


def near_best_splits(first: int, hist: np.ndarray, s: Boosting) -> list[list[tuple]]:
    """Per node all (column, bound, gain, left, right) that may be of largest gain, from columns that start at ``first``.

    ``hist`` is (column, node, bin, [rows, weight, gradient, curvature]); sides are sums of the four.
    """
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = hist.sum(axis=2, keepdims=True) - left

    def score(part: np.ndarray) -> np.ndarray:
        under = (part[..., 3] if s.newton else part[..., 1]) + s.l2
        return np.where(under > 1e-300, part[..., 2] ** 2 / np.maximum(under, 1e-300), 0.0)

    gain = score(left) + score(right) - score(hist.sum(axis=2, keepdims=True))
    ok = np.ones_like(gain, dtype=bool)
    for side in (left, right):
        ok &= (side[..., 0] >= s.min_rows) & (side[..., 3] >= s.min_curvature)
    gain = np.where(ok, gain, -1.0)
    out = []
    for n in range(gain.shape[1]):
        g = gain[:, n]
        if g.size == 0 or g.max() <= 1e-9:
            out.append([])
            continue
        # wider than the span that counts as equal, as another share may hold the largest gain
        at = np.argwhere(g >= g.max() * (1 - 3e-10))
        out.append([
            (first + int(c), int(b), float(g[c, b]), hist[c, n, : b + 1].sum(axis=0).tolist(), hist[c, n, b + 1 :].sum(axis=0).tolist()) for c, b in at
        ])
    return out


def best_splits(shares: list[list[list[tuple]]]) -> list[tuple | None]:
    """Per node the split of largest gain over all shares of the columns, or None."""
    out = []
    for found in zip(*shares):
        every = sorted((s for part in found for s in part), key=lambda s: s[:2])
        most = max((s[2] for s in every), default=0.0)
        # equal up to the order of summation: the first column and bound
        out.append(next((s for s in every if s[2] >= most * (1 - 1e-10)), None))
    return out


def fit_trees(blocks: DataFrame, columns: int, bins: int, s: Boosting) -> list[Tree]:
    """Gradient boosting; one pass over the blocks per level of each tree."""
    return _fitted(blocks, columns, _margins, partial(_boosted, columns=columns, bins=bins, s=s))


def _boosted(run: Rounds | InTask, columns: int, bins: int, s: Boosting) -> list[Tree]:
    def prior(b: Block, _: np.ndarray) -> np.ndarray:
        return np.array([(b.w * b.y).sum(), b.w.sum()])

    out: list[Tree] = []
    positive, total = run.sum(prior, (2,))
    if not 0 < positive < total:
        return out
    start = math.log(positive / (total - positive))
    for _ in range(s.trees):
        tree, level = Tree(), [1]
        for _ in range(s.depth):
            shares = run.best(_level_histogram(tree, level, bins, start), (columns, len(level), bins, 4), partial(near_best_splits, s=s))
            ahead = []
            for i, best in zip(level, best_splits(shares)):
                if best is None:
                    continue
                tree.split[i] = best[:3]
                del tree.value[i]
                for child, p in zip((2 * i, 2 * i + 1), best[3:]):
                    tree.value[child] = float(-s.rate * p[2] / max(p[3] + s.l2, 1e-16))
                    ahead.append(child)
            level = ahead
            if not level:
                break
        if not tree.split:
            break
        out.append(tree)
        run.add(tree)
    return out


def _level_histogram(tree: Tree, level: list[int], bins: int, start: float) -> Callable[[Block, np.ndarray], np.ndarray]:
    def histogram(b: Block, margin: np.ndarray) -> np.ndarray:
        slot = np.full(max(level) + 1, -1)
        slot[level] = np.arange(len(level))
        node = leaf_of(tree, b.x)
        at = slot[np.minimum(node, len(slot) - 1)]
        at[node >= len(slot)] = -1
        rows = np.flatnonzero(at >= 0)
        p = 1 / (1 + np.exp(-(margin[rows] + start)))
        w = b.w[rows]
        kinds = (b.n[rows], w, w * (p - b.y[rows]), w * p * (1 - p))
        base, out = at[rows] * bins, np.empty((len(b.x), len(level), bins, 4))
        for j, x in enumerate(b.x):
            cell = base + x[rows]
            for k, v in enumerate(kinds):
                out[j, :, :, k] = np.bincount(cell, v, len(level) * bins).reshape(len(level), bins)
        return out

    return histogram


# ---- forests -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Settings of a forest of classification trees: a bootstrap of the rows per tree, the root of the columns per node, Gini gains."""

    trees: int
    classes: int
    depth: int = 5
    seed: int = 42


def fit_forest(blocks: DataFrame, columns: int, bins: int, s: Forest) -> list[Tree]:
    """Trees that know nothing of each other, grown together: one pass over the blocks per level of as many as ``FOREST_BYTES`` hold.

    A split holds its gain times the weight of its node, the value of a node is its class. Sides that end in one class are no split.
    """
    return _fitted(blocks, columns, _no_margins, partial(_forest, columns=columns, bins=bins, s=s))


def _no_margins(b: Block, out: np.ndarray, trees: list) -> np.ndarray:
    return out


def _forest(run: Rounds | InTask, columns: int, bins: int, s: Forest) -> list[Tree]:
    out: list[Tree] = []
    together = max(1, FOREST_BYTES // (8 * 2 ** max(s.depth - 1, 0) * columns * bins * s.classes))
    for lo in range(0, s.trees, together):
        trees = [Tree() for _ in range(lo, min(lo + together, s.trees))]
        levels = [[1] for _ in trees]
        for _ in range(s.depth):
            width = max(map(len, levels))
            if not width:
                break
            histogram, choose = _forest_histogram(trees, levels, width, lo, bins, s), partial(forest_splits, levels=levels, lo=lo, s=s)
            found = run.best(histogram, (len(trees), width, columns, bins, s.classes), choose)
            for t, i, split, sides in (x for share in found for x in share):
                trees[t].split[i] = split
                trees[t].value |= {2 * i + k: side for k, side in enumerate(sides)}
            levels = [[2 * i + k for i in level if i in tree.split for k in (0, 1)] for tree, level in zip(trees, levels)]
        out += map(_pruned, trees)
    return out


def _forest_histogram(trees: list[Tree], levels: list[list[int]], width: int, lo: int, bins: int, s: Forest) -> Callable[[Block, np.ndarray], np.ndarray]:
    def histogram(b: Block, _: np.ndarray) -> np.ndarray:
        out = np.zeros((len(trees), width, len(b.x), bins, s.classes))
        cells = [x.astype(np.intp) * s.classes + b.y for x in b.x]
        each, name = b.w / b.n, int(b.id, 16)
        for t, (tree, level) in enumerate(zip(trees, levels)):
            if not level:
                continue
            # rows drawn with replacement: each comes as often as a Poisson draw says, and n rows as often as one of mean n
            w = np.random.default_rng([s.seed, lo + t, name]).poisson(b.n) * each
            slot = np.full(max(level) + 1, -1)
            slot[level] = np.arange(len(level))
            node = leaf_of(tree, b.x)
            at = slot[np.minimum(node, len(slot) - 1)]
            at[node >= len(slot)] = -1
            rows = np.flatnonzero((at >= 0) & (w > 0))
            base, w = at[rows] * (bins * s.classes), w[rows]
            for j, cell in enumerate(cells):
                out[t, :, j] = np.bincount(base + cell[rows], w, width * bins * s.classes).reshape(width, bins, s.classes)
        return out

    return histogram


def _gini(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = part.sum(axis=-1)
    share = part / np.where(total > 0, total, 1)[..., None]
    return 1 - (share * share).sum(axis=-1), total


def forest_splits(first: int, hist: np.ndarray, levels: list[list[int]], lo: int, s: Forest) -> list[tuple]:
    """(tree, node, (column, bound, gain times weight), (class below, class above)) of the best splits of trees from ``first`` on."""
    out, columns = [], hist.shape[2]
    some = columns if s.trees == 1 else math.ceil(math.sqrt(columns))
    for t, h in enumerate(hist, start=first):
        level = levels[t]
        left = np.cumsum(h[: len(level)], axis=2)
        whole = left[:, :, -1:]
        left = left[:, :, :-1]
        (il, nl), (ir, nr), (i, n) = _gini(left), _gini(whole - left), _gini(whole)
        gain = i - nl / np.where(n > 0, n, 1) * il - nr / np.where(n > 0, n, 1) * ir
        gain = np.where((nl > 0) & (nr > 0), gain, -1.0)
        for k, node in enumerate(level):
            asked = np.sort(np.random.default_rng([s.seed, lo + t, node]).choice(columns, some, replace=False))
            g = gain[k, asked]
            if g.size == 0 or g.max() <= 0:
                continue
            c, b = np.unravel_index(np.argmax(g), g.shape)
            c, b = int(asked[c]), int(b)
            sides = [float(x.argmax()) for x in (left[k, c, b], whole[k, c, 0] - left[k, c, b])]
            out.append((t, node, (c, b, float(gain[k, c, b] * n[k, c, 0])), sides))
    return out


def _pruned(tree: Tree) -> Tree:
    for i in sorted(tree.split, reverse=True):
        below = (2 * i, 2 * i + 1)
        if not any(c in tree.split for c in below) and tree.value[below[0]] == tree.value[below[1]]:
            tree.value[i] = tree.value[below[0]]
            del tree.split[i]
    return tree


# ---- importances -------------------------------------------------------------------------------


def stump_importance(stumps: list[Stump], columns: int) -> list[float]:
    """Share of the stage weights per column."""
    out = np.zeros(columns)
    for s in stumps:
        out[s.feature] += s.stage
    return _shares(out)


def tree_importance(trees: list[Tree], columns: int, kind: str) -> list[float]:
    """``share``: gains as a share of their tree, averaged; ``mean``: gain per split; ``splits``: number of splits, not scaled."""
    gain, splits, shares = np.zeros(columns), np.zeros(columns), np.zeros(columns)
    for t in trees:
        own = np.zeros(columns)
        for feature, _, g in t.split.values():
            own[feature] += g
            splits[feature] += 1
        gain += own
        shares += own / own.sum() if own.sum() > 0 else own
    if kind == "splits":
        return splits.tolist()
    return _shares(shares if kind == "share" else np.divide(gain, splits, out=np.zeros(columns), where=splits > 0))


def _shares(x: np.ndarray) -> list[float]:
    return (x / x.sum() if x.sum() > 0 else x).tolist()
