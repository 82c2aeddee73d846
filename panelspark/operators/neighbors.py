"""Exact k nearest neighbours as a shuffled block join.

Data rows are grouped around pivots whose number grows with the root of the table, in two levels: a row goes to the
nearest coarse pivot and to the nearest fine pivot below it. A query first meets the cell of its nearest pivot; its k-th
distance there is a bound, and by the triangle inequality only cells that may hold a row within the bound are met
after that. Rows with missing coordinates are indexed by a pattern of present ones: distances over a part of the
coordinates are lower bounds, and so is the numeric part of a distance with codes. The cells met later are sent in groups,
so a query goes once to a group and not to each of its cells; a task compares at most ``block_rows`` rows of both sides at
once. Equal vectors are compared once, and a task returns at most k rows per query, none beyond its bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.hashing import order_hash
from panelspark.functions.scalar import null_if_nan
from panelspark.operators.joins import attach_one_row
from panelspark.session import materialize

BLOCK_ROWS = 2048
#: rows per cell aimed at in a small table; a large one has as many cells as rows in a cell
CELL_ROWS = 256
#: bound of the table of pivots
PIVOT_BYTES = 16 << 20
#: patterns of present coordinates with pivots of their own; other rows join a pattern that they contain
PATTERNS = 64
SLICE = 1024
#: pairs whose exact distance is taken at once
PAIRS = 1 << 16
#: bytes of the vectors on one side of a task of the second phase, and the groups that a smaller table is dealt into
GROUP_BYTES = 32 << 20
GROUPS = 8


def _squared(q: np.ndarray, d: np.ndarray, nominal_from: int | None, penalty: float, gaps: bool) -> np.ndarray:
    """Squared distances of paired rows, one dimension at a time; a missing coordinate is NaN."""
    total = np.zeros(len(q))
    seen = np.zeros_like(total) if gaps else None
    for j in range(q.shape[1]):
        diff = q[:, j] - d[:, j]
        if nominal_from is not None and j >= nominal_from:
            total += penalty * (diff != 0)
        elif gaps:
            ok = ~np.isnan(diff)
            total += np.where(ok, diff * diff, 0.0)
            seen += ok
        else:
            total += diff * diff
    if gaps:
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(seen > 0, total * q.shape[1] / seen, np.nan)
    return total


def _rough(q: np.ndarray, d: np.ndarray, full: int, gaps: bool) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances over numeric coordinates by matrix products, and per query a bound of their rounding."""
    with np.errstate(all="ignore"):
        if not gaps:
            qq, dd = (q * q).sum(axis=1), (d * d).sum(axis=1)
            left = np.column_stack([-2 * q, qq, np.ones(len(q))])
            out, scale = left @ np.column_stack([d, np.ones(len(d)), dd]).T, 1
        else:
            has_q, has_d = (~np.isnan(q)).astype(float), (~np.isnan(d)).astype(float)
            q, d = np.nan_to_num(q), np.nan_to_num(d)
            qq, dd = (q * q).sum(axis=1), (d * d).sum(axis=1)
            out = np.hstack([q * q, has_q, -2 * q]) @ np.hstack([has_d, d * d, d]).T
            out, scale = out * full / (has_q @ has_d.T), full
        most = dd[np.isfinite(dd)].max(initial=0.0)
        return out, scale * (3 * q.shape[1] + 16) * 2.0**-52 * (np.where(np.isfinite(qq), qq, 0.0) + most)


class Nearest:
    """The k nearest rows so far of every query; ``limit`` bounds the squared distance of what may still come in.

    Matrix products choose the pairs that may be near, with room for their rounding, and only these are measured exactly.
    """

    def __init__(self, limit: np.ndarray, k: int, nominal_from: int | None = None, penalty: float = 0.0, gaps: bool = False, root: bool = True):
        self.limit, self.k, self.nominal_from, self.penalty, self.gaps, self.root = limit, k, nominal_from, penalty, gaps, root
        self.at, self.ids, self.dist = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def meet(self, rows: np.ndarray, q: np.ndarray, d: np.ndarray, ids: np.ndarray, wanted: Callable | None = None) -> None:
        """Queries ``q``, which are ``rows`` of the limits, meet data rows; ``wanted`` tells which pairs (row, data row) count."""
        dims = q.shape[1] if self.nominal_from is None else self.nominal_from
        rough, slack = _rough(q[:, :dims], d[:, :dims], q.shape[1], self.gaps)
        limit = self.limit[rows] + slack
        if not np.isfinite(limit).all() and len(d) > self.k:
            # the codes that rough distances leave out
            codes = self.penalty * (q.shape[1] - dims) * (q.shape[1] if self.gaps else 1)
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            limit = np.fmin(limit, kth * (1 + 1e-9) + codes + 2 * slack)
        # what is no number may overflow here alone, so it is measured
        i, j = np.nonzero(~(rough > limit[:, None]))
        if wanted is not None:
            some = wanted(rows[i], j)
            i, j = i[some], j[some]
        at, found, dist = [self.at], [self.ids], [self.dist]
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            with np.errstate(all="ignore"):
                far = _squared(q[a], d[b], self.nominal_from, self.penalty, self.gaps)
                far = np.sqrt(far) if self.root else far
            ok = np.isfinite(far)
            at.append(rows[a[ok]]), found.append(ids[b[ok]]), dist.append(far[ok])
        self.at, self.ids, self.dist = np.concatenate(at), np.concatenate(found), np.concatenate(dist)
        order = np.lexsort((self.ids, self.dist, self.at))
        place = self.at[order]
        place = np.arange(len(place)) - np.searchsorted(place, place)
        kept, last = order[place < self.k], order[place == self.k - 1]
        bound = self.dist[last] ** 2 if self.root else self.dist[last]
        self.limit[self.at[last]] = np.minimum(self.limit[self.at[last]], bound * (1 + 1e-9) + 1e-300)
        self.at, self.ids, self.dist = self.at[kept], self.ids[kept], self.dist[kept]


def nearest_of(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Place in ``d`` of the row nearest to each row of ``q``; ties go to the first."""
    out = np.zeros(len(q), dtype=np.int64)
    for lo in range(0, len(q), SLICE):
        part = q[lo : lo + SLICE]
        found = Nearest(np.full(len(part), np.inf), 1, root=False)
        for at in range(0, len(d), BLOCK_ROWS):
            rows = d[at : at + BLOCK_ROWS]
            found.meet(np.arange(len(part)), part, rows, np.arange(at, at + len(rows)))
        out[lo + found.at] = found.ids
    return out


def _pairs(qi: np.ndarray, found: Nearest) -> pd.DataFrame:
    return pd.DataFrame({"id": qi[found.at], "nn_id": found.ids, "dist": found.dist})


def _stacked(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(float)


def _block_top_k(k: int, nominal_from, penalty: float, gaps: bool):
    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"id": [], "nn_id": [], "dist": []})
        found = Nearest(np.full(len(q), np.inf), k, nominal_from, penalty, gaps)
        found.meet(np.arange(len(q)), _stacked(q["qvec"]), _stacked(d["vec"]), d["id"].to_numpy())
        return _pairs(q["qid"].to_numpy(), found)

    return run


def _group_top_k(index: Index, dims: int, k: int, nominal_from, penalty: float, gaps: bool, block_rows: int):
    """Compares queries (qid, qvec, met, bound) with the cells of a group that they may need and have not met."""

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        outs = [pd.DataFrame({"id": [], "nn_id": [], "dist": []})]
        if q.empty or d.empty:
            return outs[0]
        d = d.iloc[np.argsort(d["cell"].to_numpy(), kind="stable")]
        dv, di = _stacked(d["vec"]), d["id"].to_numpy()
        cells, starts = np.unique(d["cell"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(d))
        # queries of one cell need the same cells
        q = q.iloc[np.argsort([m[0] if len(m) else -1 for m in q["met"]], kind="stable")]
        for lo in range(0, len(q), block_rows):
            part = q.iloc[lo : lo + block_rows]
            qv, bound, met = _stacked(part["qvec"]), part["bound"].to_numpy(float), part["met"].tolist()
            wants = index.hits(qv[:, :dims], bound, met, not gaps)[:, cells]
            found = Nearest((bound * (1 + 1e-9) + 1e-12) ** 2, k, nominal_from, penalty, gaps)
            left = np.flatnonzero(wants.any(axis=0))
            while len(left):
                n = max(1, int(np.searchsorted(np.cumsum(ends[left] - starts[left]), block_rows, side="right")))
                some, left = left[:n], left[n:]
                rows = np.flatnonzero(wants[:, some].any(axis=1))
                at = np.concatenate([np.arange(starts[c], ends[c]) for c in some])
                of = np.repeat(some, ends[some] - starts[some])
                for cut in range(0, len(at), block_rows):
                    here, own = at[cut : cut + block_rows], of[cut : cut + block_rows]
                    found.meet(rows, qv[rows], dv[here], di[here], lambda i, j, own=own, wants=wants: wants[i, own[j]])
            outs.append(_pairs(part["qid"].to_numpy(), found))
        return pd.concat(outs)

    return run


def _shared(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances over the coordinates that both sides have."""
    total = np.zeros((len(v), len(centers)))
    for j in range(v.shape[1]):
        diff = v[:, j][:, None] - centers[:, j][None, :]
        total += np.where(np.isnan(diff), 0.0, diff * diff)
    return np.sqrt(total)


@dataclass
class Index:
    """Coarse and fine pivots; a coordinate outside a pivot's pattern is NaN. A cell is a number of a fine pivot.

    A row lies in a cell whose pattern it contains. ``reach`` are the largest distances of a cell's rows to its pivot, over
    the pattern, ``least`` the smallest; ``spread`` the largest distance of a group's rows to its coarse pivot.
    """

    coarse: np.ndarray
    fine: np.ndarray
    group: np.ndarray
    sizes: np.ndarray | None = None
    reach: np.ndarray | None = None
    least: np.ndarray | None = None
    spread: np.ndarray | None = None

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, distance to the coarse pivot) of data rows."""
        has = ~np.isnan(v)
        cell, r, far = np.zeros(len(v), dtype=np.int64), np.zeros(len(v)), np.zeros(len(v))
        fits = ~((~has).astype(float) @ (~np.isnan(self.coarse)).T.astype(float)).astype(bool)
        width = (~np.isnan(self.coarse)).sum(axis=1)
        # the widest pattern that the row contains, then the nearest pivot of that pattern
        widest = np.where(fits, width, -1).max(axis=1)
        d = np.where(fits & (width == widest[:, None]), _shared(v, self.coarse), np.inf)
        top = d.argmin(axis=1)
        for g in np.unique(top):
            rows, below = np.flatnonzero(top == g), np.flatnonzero(self.group == g)
            near = _shared(v[rows], self.fine[below])
            at = near.argmin(axis=1)
            cell[rows], r[rows], far[rows] = below[at], near[np.arange(len(rows)), at], d[rows, g]
        return cell, r, far

    def first(self, v: np.ndarray, need: int) -> list[list[int]]:
        """Cells that a query meets first: the nearest ones that hold ``need`` rows together."""
        out = []
        for lo in range(0, len(v), SLICE):
            d = np.where(self.sizes > 0, _shared(v[lo : lo + SLICE], self.fine), np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            enough = (np.cumsum(self.sizes[order], axis=1) < need).sum(axis=1)
            out += [[int(c) for c in o[: n + 1] if self.sizes[c]] for o, n in zip(order, enough)]
        return out

    def hits(self, v: np.ndarray, bound: np.ndarray, met: list, whole: bool) -> np.ndarray:
        """Whether a query has to meet a cell after those it has ``met``: one that may hold a row within ``bound``.

        ``whole`` says that no coordinate is missing.
        """
        scale = np.ones(len(v)) if whole else np.sqrt(v.shape[1] / np.maximum((~np.isnan(v)).sum(axis=1), 1))
        # a little slack keeps rounding from cutting off a true neighbour
        bound = bound * (1 + 1e-9) + 1e-12
        if not whole:
            # a query without coordinates is near to nothing
            bound = np.where(np.isnan(v).all(axis=1), -1.0, bound)
        out = np.zeros((len(v), len(self.fine)), dtype=bool)
        near = _shared(v, self.coarse)
        for g in range(len(self.coarse)):
            below = np.flatnonzero((self.group == g) & (self.sizes > 0))
            rows = np.flatnonzero((near[:, g] - self.spread[g]) * scale <= bound)
            if not len(rows) or not len(below):
                continue
            d = _shared(v[rows], self.fine[below])
            hit = (d - self.reach[below]) * scale[rows][:, None] <= bound[rows][:, None]
            if whole:
                hit &= self.least[below] - d <= bound[rows][:, None]
            out[np.ix_(rows, below)] = hit
        for i, m in enumerate(met):
            out[i, m] = False
        return out

    def groups(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, group) of every share of a cell: cells below one coarse pivot side by side, at most ``rows`` rows a group.

        A cell of more rows is cut into shares that are groups of their own.
        """
        cells, groups, now, held = [], [], -1, rows
        for c in np.argsort(self.group, kind="stable"):
            n = int(self.sizes[c])
            if not n:
                continue
            parts = -(-n // rows)
            if parts > 1 or held + n > rows:
                now, held = now + 1, 0
            cells += [int(c)] * parts
            groups += range(now, now + parts)
            now, held = now + parts - 1, rows if parts > 1 else held + n
        return np.array(cells, dtype=np.int64), np.array(groups, dtype=np.int64)


def _pivots(data: DataFrame, dims: int, n: int, whole: bool) -> Index:
    """Pivots drawn in hash order, as many as the root of the table asks for and ``PIVOT_BYTES`` allow.

    ``whole`` says that no coordinate is missing, so there is one pattern.
    """
    some = int(min(max(n // CELL_ROWS, 1), math.ceil(math.sqrt(n)) if n > CELL_ROWS**2 else n, PIVOT_BYTES // (8 * max(dims, 1))))
    if whole:
        shares = {"1" * dims: some} if dims else {}
        marked = data.select("id", "vec", F.lit("1" * dims).alias("mask"))
    else:
        mask = F.transform("vec", lambda x: F.when(F.isnan(x), "0").otherwise("1"))
        marked = data.select("id", "vec", F.array_join(mask, "").alias("mask"))
        counts = marked.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mask").limit(PATTERNS).collect()
        # a pattern without coordinates takes the rows that contain no other
        shares = {r["mask"]: max(1, round(some * r["n"] / n)) for r in counts if "1" in r["mask"]}
    coarse, fine, group = [np.full(dims, np.nan)], [np.full(dims, np.nan)], [0]
    if shares:
        wanted = data.sparkSession.createDataFrame(list(shares.items()), "mask string, share long")
        by = Window.partitionBy("mask").orderBy("_h", "id")
        drawn = marked.join(F.broadcast(wanted), "mask").withColumn("_h", order_hash(F.col("id"))).withColumn("_r", F.row_number().over(by))
        # the literal bound lets each task keep only its first rows before the shuffle
        drawn = drawn.where((F.col("_r") <= max(shares.values())) & (F.col("_r") <= F.col("share")))
        for _, rows in sorted(_by_mask(drawn.select("mask", "_r", "vec").collect()).items()):
            top = rows[: max(1, round(math.sqrt(len(rows))))]
            nearest = _shared(rows, top).argmin(axis=1)
            nearest[: len(top)] = np.arange(len(top))
            group += (nearest + len(coarse)).tolist()
            coarse += list(top)
            fine += list(rows)
    return Index(np.array(coarse), np.array(fine), np.array(group))


def _by_mask(rows: list) -> dict[str, np.ndarray]:
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["mask"], r["_r"])):
        out.setdefault(r["mask"], []).append(r["vec"])
    return {m: np.array(v, dtype=float) for m, v in out.items()}


def _numeric(series: pd.Series, dims: int) -> np.ndarray:
    """The coordinates that bound a distance; a missing one is NaN."""
    return np.stack(series.to_numpy()).astype(float)[:, :dims]


def _index(data: DataFrame, dims: int, n: int, whole: bool) -> tuple[Index, DataFrame]:
    """Pivots with the extents of their cells, and ``data`` (id, vec) with its cell, written."""
    index = _pivots(data.withColumn("vec", F.slice("vec", 1, dims)), dims, n, whole)

    @F.pandas_udf("cell long, r double, far double")
    def place(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("cell", "r", "far"), index.place(_numeric(v, dims)))))

    data = materialize(data.withColumn("_p", place("vec")).select("id", "vec", "_p.cell", "_p.r", "_p.far"), "cells")
    stats = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.min("r").alias("least"), F.max("far").alias("far")).collect()
    cells = len(index.fine)
    index.sizes, index.reach, index.least, index.spread = np.zeros(cells, dtype=np.int64), np.zeros(cells), np.zeros(cells), np.zeros(len(index.coarse))
    for s in stats:
        c, g = s["cell"], index.group[s["cell"]]
        index.sizes[c], index.reach[c], index.least[c] = s["n"], s["r"], s["least"]
        index.spread[g] = max(index.spread[g], s["far"])
    return index, data


def _met(queries: DataFrame, data: DataFrame, index: Index, block_rows: int, compare) -> DataFrame:
    """(id, nn_id, dist) of queries (qid, qvec, cell) and the rows of their cells, block by block."""
    spark = data.sparkSession
    load = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    shape = [(r["cell"], -(-int(index.sizes[r["cell"]]) // block_rows), -(-r["n"] // block_rows)) for r in load]
    if not shape:
        return spark.createDataFrame([], "id long, nn_id long, dist double")
    blocks = F.broadcast(spark.createDataFrame(shape, "cell long, _ns long, _nt long"))
    d = (
        data.select("id", "vec", "cell")
        .join(blocks, "cell")
        .withColumn("s", F.pmod(F.xxhash64("id"), "_ns"))
        .withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nt") - 1)))
        .select("id", "vec", "cell", "s", "t")
    )
    q = (
        queries.join(blocks, "cell")
        .withColumn("t", F.pmod(F.xxhash64("qid"), "_nt"))
        .withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ns") - 1)))
        .select("qid", "qvec", "cell", "s", "t")
    )
    return q.groupBy("cell", "s", "t").cogroup(d.groupBy("cell", "s", "t")).applyInPandas(compare, "id long, nn_id long, dist double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per id; each task cuts its own rows to k per id before the shuffle."""
    order = Window.partitionBy("id").orderBy("dist", "nn_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def routed(queries: DataFrame, data: DataFrame, k: int, nominal_from: int | None = None, penalty: float = 0.0, gaps: bool = False,
           block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, nn_id, dist, rank) for distinct queries, and (qid, cells) with the number of cells that each of them met."""
    spark = data.sparkSession
    missing = F.count_if(F.exists("vec", F.isnan))
    n, size, holes = data.agg(F.count(F.lit(1)), F.max(F.size("vec")), missing).first()
    if not n:
        return spark.createDataFrame([], "id long, nn_id long, dist double, rank int"), spark.createDataFrame([], "qid long, cells int")
    dims = size if nominal_from is None else nominal_from
    index, data = _index(data, dims, n, not holes)
    compare = _block_top_k(k, nominal_from, penalty, gaps)

    @F.pandas_udf("array<long>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(index.first(_numeric(v, dims), k))

    queries = queries.withColumn("met", nearest("qvec"))
    near = materialize(_best(_met(queries.select("qid", "qvec", F.explode("met").alias("cell")), data, index, block_rows, compare), k), "near")
    bound = near.where(F.col("rank") == k).select(F.col("id").alias("qid"), F.col("dist").alias("bound"))
    share, group = index.groups(_group_rows(n, size, block_rows))
    starts = np.flatnonzero(np.diff(group, prepend=-1))

    @F.pandas_udf("groups array<int>, cells int")
    def reachable(v: pd.Series, met: pd.Series, bound: pd.Series) -> pd.DataFrame:
        v, bound, out = _numeric(v, dims), bound.to_numpy(float), []
        for lo in range(0, len(v), SLICE):
            cut = slice(lo, lo + SLICE)
            hit = index.hits(v[cut], bound[cut], met.iloc[cut].tolist(), not gaps)
            some = np.logical_or.reduceat(hit[:, share], starts, axis=1)
            out += [(np.flatnonzero(x).astype(np.int32), c) for x, c in zip(some, hit.sum(axis=1))]
        return pd.DataFrame(out, columns=["groups", "cells"])

    far = queries.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    far = far.withColumn("_m", reachable("qvec", "met", "bound")).select("qid", "qvec", "met", "bound", "_m.groups", "_m.cells")
    far = materialize(far, "routes")
    rest = _grouped(far, data, dict(zip(share.tolist(), group.tolist())), share, size, block_rows, _group_top_k(index, dims, k, nominal_from, penalty, gaps, block_rows))
    met = far.select("qid", (F.size("met") + F.col("cells")).alias("cells"))
    return _best(near.drop("rank").unionByName(rest), k), met


def _group_rows(n: int, size: int, block_rows: int) -> int:
    """Rows of one side of a task of the second phase: few large tasks, as each row is sent to every task of its line."""
    return max(1, min(max(block_rows, -(-n // GROUPS)), max(block_rows, GROUP_BYTES // (8 * max(size, 1)))))


def _grouped(far: DataFrame, data: DataFrame, last: dict[int, int], share: np.ndarray, size: int, block_rows: int, compare) -> DataFrame:
    """(id, nn_id, dist) of the queries in ``far`` and the cells that they still need, one task per pair of blocks."""
    spark = data.sparkSession
    asked = far.select("qid", "qvec", "met", "bound", F.explode("groups").alias("g"))
    load = far.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    if not load:
        return spark.createDataFrame([], "id long, nn_id long, dist double")
    rows = _group_rows(max(r["n"] for r in load), size, block_rows)
    blocks = F.broadcast(spark.createDataFrame([(r["g"], -(-r["n"] // rows)) for r in load], "g int, _nt long"))
    parts = np.bincount(share)
    places = F.broadcast(spark.createDataFrame([(c, g - int(parts[c]) + 1, int(parts[c])) for c, g in last.items()], "cell long, _g int, _ns int"))
    d = (
        data.select("id", "vec", "cell")
        .join(places, "cell")
        .withColumn("g", (F.col("_g") + F.pmod(F.xxhash64("id"), "_ns")).cast("int"))
        .join(blocks, "g")
        .withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nt") - 1)))
        .select("id", "vec", "cell", "g", "t")
    )
    q = asked.join(blocks, "g").withColumn("t", F.pmod(F.xxhash64("qid"), "_nt")).drop("_nt")
    return q.groupBy("g", "t").cogroup(d.groupBy("g", "t")).applyInPandas(compare, "id long, nn_id long, dist double")


def knn_join(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    exclude_self: bool = False,
    nominal_from: int | None = None,
    penalty: float = 0.0,
    gaps: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, nn_id, dist, rank) for frames of (id long, vec array<double>): the k nearest data rows.

    Ties go to the smaller id. Coordinates from ``nominal_from`` on count ``penalty`` when they differ.
    With ``gaps`` missing coordinates (NaN) are skipped and the rest scaled up. Of rows with equal vectors the k (or k + 1)
    smallest ids are compared, as no other can be among the nearest, and equal queries are asked once.
    """
    need = k + 1 if exclude_self else k
    same = Window.partitionBy("vec").orderBy("id")
    rows = data.select("id", "vec").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= need).drop("_r")
    asked = queries.select("id", F.col("vec").alias("qvec"))
    ones = materialize(asked.groupBy("qvec").agg(F.min("id").alias("qid")), "asked")
    found, _ = routed(ones, rows, need, nominal_from, penalty, gaps, block_rows)
    back = asked.join(ones, "qvec").select(F.col("qid").alias("_asked"), F.col("id").alias("_id"))
    out = found.drop("rank").join(back, F.col("id") == F.col("_asked")).select(F.col("_id").alias("id"), "nn_id", "dist")
    return _best(out.where("id <> nn_id") if exclude_self else out, k)


def as_vector(*cols: str):
    """array<double> of columns, NaN for null."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])


def impute_knn(df: DataFrame, cols: list[str], row_id: str = "row_id", k: int = 3, **kw) -> DataFrame:
    """Fill a gap with the mean of the column over the k nearest rows that have it.

    Distance uses the coordinates both rows have, scaled up for the missing ones; a row with no usable
    donor gets the column mean. NaN is missing too.
    """
    df = df.withColumns({c: null_if_nan(F.col(c)) for c, kind in df.dtypes if c in cols and kind in ("float", "double")})
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    work = df.select(F.col(row_id).alias("id"), as_vector(*cols).alias("vec"), *cols)
    out = df
    for c in [c for c in cols if gaps[c]]:
        nn = knn_join(work.where(F.col(c).isNull()), work.where(F.col(c).isNotNull()), k, gaps=True, **kw)
        donors = work.where(F.col(c).isNotNull()).select(F.col("id").alias("nn_id"), F.col(c).alias("_v"))
        guess = nn.join(donors, "nn_id").groupBy(F.col("id").alias(row_id)).agg(F.avg("_v").alias(f"{c}__knn"))
        mean = df.agg(F.avg(c).alias(f"{c}__mean"))
        out = attach_one_row(out.join(guess, row_id, "left"), mean).withColumn(
            c, F.coalesce(F.col(c).cast("double"), f"{c}__knn", f"{c}__mean")
        ).drop(f"{c}__knn", f"{c}__mean")
    return out.select(*df.columns)
