"""Rolling time windows (t - w, t] per key, one output per input row.

A sliding window frame is re-read for every row, which is quadratic in the rows of a frame. Here time is cut
into blocks as long as the window, so a frame is

    the rows of the own block up to t  +  the rows of the previous block that have not expired at t.

Both ends are running aggregates with frames that only grow: each row is repeated once per period, shifted to
the moment it expires, and the repeats are made after the one shuffle by key. Sums are never subtracted.

A hot key would put its whole history in one task. Its rows are spread over (key, short block) instead: the
same two ends, plus the whole blocks in between, which are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import MICROS_PER_DAY, micros, nan_to_null
from panelspark.operators.joins import hot_keys
from panelspark.operators.ranks import prefix_sums
from panelspark.session import materialize

#: rows of a key from which on its history is spread, where it has one rolling column; more columns lower it
HOT_HISTORY_ROWS = 1_000_000
#: rows times rolling columns of one task
TASK_CELLS = 500_000
BLOCKS_PER_WINDOW = 256


@dataclass(frozen=True)
class Spec:
    """One rolling column: ``{key}_n_{col}_{func}_{days}``."""

    key: str
    col: str
    func: str  # sum, mean, min, max, cnt (distinct values)
    days: int

    @property
    def name(self) -> str:
        return f"{self.key}_n_{self.col}_{self.func}_{self.days}"


def _pieces(specs: list[Spec]) -> dict[str, tuple[str, str]]:
    """Mergeable pieces the specs need: name -> (kind, column); a mean is a sum and a count."""
    out = {}
    for s in specs:
        kinds = {"mean": ("sum", "n"), "cnt": ()}.get(s.func, (s.func,))
        out |= {f"{k}_{s.col}": (k, s.col) for k in kinds}
    return out


def _agg(kind: str, x: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "n": F.count}[kind](x)


def _merge(kind: str, cols: list[Column]) -> Column:
    if kind == "n":
        return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    if kind == "sum":
        some = reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])
        return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols]))
    return (F.least if kind == "min" else F.greatest)(*cols)


def _result(s: Spec, merged: dict[str, Column]) -> Column:
    if s.func == "mean":
        n = merged[f"n_{s.col}"]
        return F.when(n > 0, merged[f"sum_{s.col}"] / n)
    return merged[f"{s.func}_{s.col}"]


def tasks_for(df: DataFrame, n_rows: int, columns: int, cells: int = TASK_CELLS) -> int:
    """Tasks of the shuffle by key: a window sorts all rows of its task once for every column, so tasks grow with both."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, least, -(-n_rows * columns // cells))


def _by_key(df: DataFrame, key: str, specs: list[Spec], row_id: str, n_rows: int) -> DataFrame:
    """Ordinary keys: one shuffle by key; every later window only re-sorts inside its partition."""
    inputs = {s.col for s in specs}
    payload = [c for c in df.columns if c not in (key, "_us", row_id) and c not in inputs]
    rows = df.repartition(tasks_for(df, n_rows, len(specs)), key)
    own, expiring = ~F.col("_exp"), F.col("_exp")
    for d in sorted({s.days for s in specs}):
        mine = [s for s in specs if s.days == d]
        rows = rows.withColumn("_exp", F.explode(F.array(F.lit(False), F.lit(True))))
        rows = rows.withColumns(
            {"_us": F.when(expiring, F.col("_us") + d * MICROS_PER_DAY).otherwise(F.col("_us"))}
            | {c: F.when(own, F.col(c)) for c in payload}
        ).withColumn("_blk", F.floor(F.col("_us") / (d * MICROS_PER_DAY)).cast("long"))
        counted = [s.col for s in mine if s.func == "cnt"]
        for i, c in enumerate(counted):
            # a value counts from its first row in the block on, and until its last expiry; own rows sort first
            same = Window.partitionBy(key, "_blk", c).orderBy("_exp", "_us", row_id)
            all_ = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            rows = rows.withColumns(
                {
                    "_f": F.min(F.when(own, F.col("_us"))).over(all_),
                    "_l": F.max(F.when(expiring, F.col("_us"))).over(all_),
                    "_top": F.lag(F.lit(1)).over(same).isNull(),
                    "_end": F.lead(F.lit(1)).over(same).isNull(),
                }
            )
            known = F.col(c).isNotNull()
            starts, ends = known & own & F.col("_top"), known & expiring & F.col("_end")
            apart = F.col("_l").isNull() | F.col("_f").isNull() | (F.col("_l") <= F.col("_f"))
            rows = rows.withColumns(
                {f"_d{i}": F.when(starts & apart, 1).when(ends & apart, -1).otherwise(0), f"_o{i}": ends.cast("int")}
            ).drop("_f", "_l", "_top", "_end")
        rising = Window.partitionBy(key, "_blk").orderBy("_us")
        upto = rising.rangeBetween(Window.unboundedPreceding, 0)
        block = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # in falling order, the frame holds the rows that expire strictly after t
        after = Window.partitionBy(key, "_blk").orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, -1)
        pieces = _pieces(mine)
        heads = {f"_h_{p}": _agg(k, F.when(own, F.col(c))).over(upto) for p, (k, c) in pieces.items()}
        for i in range(len(counted)):
            heads |= {f"_c_{i}": F.sum(f"_d{i}").over(upto), f"_b_{i}": F.sum(f"_o{i}").over(block)}
        rows = rows.withColumns(heads)
        if pieces:
            rows = rows.withColumns(
                {f"_t_{p}": _agg(k, F.when(expiring, F.col(c))).over(after) for p, (k, c) in pieces.items()}
            )
        merged = {p: _merge(k, [F.col(f"_h_{p}"), F.col(f"_t_{p}")]) for p, (k, _) in pieces.items()}
        out = {}
        for s in mine:
            if s.func == "cnt":
                i = counted.index(s.col)
                out[s.name] = F.col(f"_b_{i}") + F.col(f"_c_{i}")
            else:
                out[s.name] = _result(s, merged)
        rows = rows.where(own).withColumns(out).drop(
            "_blk", "_exp",
            *[x + p for p in pieces for x in ("_h_", "_t_")],
            *[x + str(i) for i in range(len(counted)) for x in ("_d", "_o", "_c_", "_b_")],
        )
        payload += list(out)
    return rows


def _short_blocks(days: int, blocks: int) -> tuple[int, int]:
    """(blocks, block length): the window is a whole number of blocks."""
    width = days * MICROS_PER_DAY
    while width % blocks:
        blocks -= 1
    return blocks, width // blocks


def _hot_values(df: DataFrame, row_id: str, key: str, days: int, specs: list[Spec], blocks: int) -> DataFrame:
    """(row_id, one column per spec) for sum, mean, min and max of hot keys."""
    blocks, length = _short_blocks(days, blocks)
    pieces = _pieces(specs)
    inputs = sorted({c for _, c in pieces.values()})
    base = df.select(row_id, key, "_us", F.floor(F.col("_us") / length).cast("long").alias("_blk"), *inputs)
    both = base.withColumn("_exp", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns(
        {
            "_us": F.when(F.col("_exp"), F.col("_us") + days * MICROS_PER_DAY).otherwise(F.col("_us")),
            "_blk": F.when(F.col("_exp"), F.col("_blk") + blocks).otherwise(F.col("_blk")),
        }
    )
    block = Window.partitionBy(key, "_blk")
    upto = block.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    after = block.orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumns(
        {f"_h_{p}": _agg(k, F.when(~F.col("_exp"), F.col(c))).over(upto) for p, (k, c) in pieces.items()}
    ).withColumns({f"_t_{p}": _agg(k, F.when(F.col("_exp"), F.col(c))).over(after) for p, (k, c) in pieces.items()})
    # one row per (key, block) with data
    table = base.groupBy(key, "_blk").agg(*[_agg(k, F.col(c)).alias(p) for p, (k, c) in pieces.items()])
    between = Window.partitionBy(key).orderBy("_blk").rangeBetween(-(blocks - 1), -1)
    whole = lambda k, p: F.sum(p) if k == "n" else _agg(k, F.col(p))
    mid = table.select(key, "_blk", *[whole(k, p).over(between).alias(f"_m_{p}") for p, (k, _) in pieces.items()])
    done = both.where(~F.col("_exp")).join(mid, [key, "_blk"], "left")
    merged = {p: _merge(k, [F.col(f"_{x}_{p}") for x in "hmt"]) for p, (k, _) in pieces.items()}
    return done.select(row_id, *[_result(s, merged).alias(s.name) for s in specs])


def _hot_distinct(df: DataFrame, row_id: str, key: str, s: Spec, blocks: int) -> DataFrame:
    """(row_id, count of distinct values) for hot keys.

    A value is present from each occurrence until w later. Occurrences closer than w merge into one stay, so
    only the ends of stays change the count, and the count at t is a running sum of +1 and -1.
    """
    _, length = _short_blocks(s.days, blocks)
    width = s.days * MICROS_PER_DAY
    blk = F.floor(F.col("_us") / length).cast("long")
    seen = df.where(F.col(s.col).isNotNull()).select(key, F.col(s.col).alias("_v"), "_us").distinct().withColumn("_blk", blk)
    inside = Window.partitionBy(key, "_v", "_blk").orderBy("_us")
    near = seen.withColumns({"_prev": F.lag("_us").over(inside), "_next": F.lead("_us").over(inside)})
    # neighbours across blocks come from one row per (key, value, block)
    ends = seen.groupBy(key, "_v", "_blk").agg(F.min("_us").alias("_a"), F.max("_us").alias("_z"))
    along = Window.partitionBy(key, "_v").orderBy("_blk")
    ends = ends.select(key, "_v", "_blk", F.lag("_z").over(along).alias("_pz"), F.lead("_a").over(along).alias("_na"))
    near = near.join(ends, [key, "_v", "_blk"]).withColumns(
        {"_prev": F.coalesce("_prev", "_pz"), "_next": F.coalesce("_next", "_na")}
    )
    starts = near.where(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= width)).select(key, "_us", F.lit(1).alias("_d"))
    stops = near.where(F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= width)).select(
        key, (F.col("_us") + width).alias("_us"), F.lit(-1).alias("_d")
    )
    times = df.select(key, "_us", F.lit(0).alias("_d"))
    steps = starts.unionByName(stops).unionByName(times).groupBy(key, "_us").agg(F.sum("_d").alias("_d"))
    run = prefix_sums(steps.withColumn("_blk", blk), F.col("_us"), {"d": F.col("_d")}, [key], "_blk")
    at = run.select(key, "_us", (F.col("before_d") + F.col("_d")).alias(s.name))
    return df.select(row_id, key, "_us").join(at, [key, "_us"]).select(row_id, s.name)


def _hot_part(rows: DataFrame, row_id: str, key: str, specs: list[Spec], blocks: int) -> DataFrame:
    out = rows
    for days in sorted({s.days for s in specs}):
        values = [s for s in specs if s.days == days and s.func != "cnt"]
        if values:
            out = out.join(_hot_values(rows, row_id, key, days, values, blocks), row_id)
    for s in specs:
        if s.func == "cnt":
            out = out.join(_hot_distinct(rows, row_id, key, s, blocks), row_id)
    return out


def rolling_features(
    df: DataFrame,
    specs: list[Spec],
    time: str,
    row_id: str,
    hot_rows: int | None = None,
    blocks: int = BLOCKS_PER_WINDOW,
) -> DataFrame:
    """Add every rolling column; missing results become 0.

    Rows with equal times belong to each other's windows. A null key or time gives 0. NaN is a missing value. A key with
    more than ``hot_rows`` rows is spread, by default as many as keep rows times columns at ``HOT_HISTORY_ROWS``.
    """
    n_rows, written = df.count(), True
    floats = [c for c, kind in df.dtypes if kind in ("float", "double") and c in {s.col for s in specs}]
    out = nan_to_null(df.withColumns({f"_nan_{c}": F.coalesce(F.isnan(c), F.lit(False)) for c in floats}), floats)
    out = out.withColumn("_us", micros(F.col(time)))
    for key in dict.fromkeys(s.key for s in specs):
        mine = [s for s in specs if s.key == key]
        hot = hot_keys(df, [key], hot_rows or max(1, HOT_HISTORY_ROWS // len(mine)))
        if hot is None:
            out, written = _by_key(out, key, mine, row_id, n_rows), False
            continue
        if not written:
            # the parts below would repeat the windows of the keys before
            out = materialize(out, "rolled")
        marks = F.broadcast(hot.where(F.col(key).isNotNull()).select(F.col(key).alias("_hk"), F.lit(True).alias("_hot")))
        marked = out.join(marks, F.col(key) == F.col("_hk"), "left").drop("_hk")
        idle = F.col(key).isNull() | F.col("_us").isNull()
        cold = _by_key(marked.where(~idle & F.col("_hot").isNull()).drop("_hot"), key, mine, row_id, n_rows)
        void = marked.where(idle).drop("_hot").withColumns(
            {s.name: F.lit(None).cast(cold.schema[s.name].dataType) for s in mine}
        )
        warm = _hot_part(marked.where(~idle & F.col("_hot").isNotNull()).drop("_hot"), row_id, key, mine, blocks)
        out, written = cold.unionByName(warm).unionByName(void), False
    idle = {s.name: F.col(s.key).isNull() | F.col("_us").isNull() for s in specs}
    return out.withColumns(
        {s.name: F.when(idle[s.name], 0).otherwise(F.coalesce(F.col(s.name), F.lit(0))) for s in specs}
    ).withColumns(
        {c: F.when(F.col(f"_nan_{c}"), F.lit(float("nan"))).otherwise(F.col(c)) for c in floats}
    ).select(*df.columns, *[s.name for s in specs])


@dataclass(frozen=True)
class WindowAggregate:
    """A rolling aggregate of the caller's own.

    ``pieces`` names sums, minima or maxima of expressions of the column; ``finish`` makes the result of them. A
    piece without any row in the window is 0, so count the rows by a piece where that matters.
    """

    pieces: dict[str, tuple[str, Callable[[Column], Column]]]
    finish: Callable[[dict[str, Column]], Column]


WINDOW_AGGREGATES: dict[str, WindowAggregate] = {}


def register_window_aggregate(name: str, aggregate: WindowAggregate) -> None:
    WINDOW_AGGREGATES[name] = aggregate


def rolling_user(df: DataFrame, name: str, key: str, col: str, days: list[int], time: str, row_id: str, **kw) -> DataFrame:
    """Add ``{key}_n_{col}_{name}_{days}`` for a registered aggregate; all its pieces share the one pass."""
    aggregate = WINDOW_AGGREGATES[name]
    work = df.withColumns({f"_u_{p}": expr(F.col(col)) for p, (_, expr) in aggregate.pieces.items()})
    specs = {(d, p): Spec(key, f"_u_{p}", kind, d) for d in days for p, (kind, _) in aggregate.pieces.items()}
    out = rolling_features(work, list(specs.values()), time, row_id, **kw)
    made = {
        f"{key}_n_{col}_{name}_{d}": aggregate.finish({p: F.col(specs[d, p].name) for p in aggregate.pieces}) for d in days
    }
    return out.withColumns(made).select(*df.columns, *made)


def feature_grid(
    keys: list[str], targets: list[str], periods: list[int], funcs: list[str]
) -> list[Spec]:
    """Every key x target x period x function, without key = target."""
    return [Spec(k, c, f, p) for k in keys for c in targets if c != k for p in periods for f in funcs]
