"""Entities, per-key aggregates and automated feature synthesis."""

from __future__ import annotations

import logging
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.scalar import correlation, date_parts, haversine_distance, nan_to_null
from panelspark.operators.joins import BROADCAST_BYTES, HOT_ROWS, fetch_bounded, hot_keys, lookup_join, salted_join
from panelspark.operators.ranks import HOT_GROUP_ROWS, column_ranks, row_ranks, window_rank
from panelspark.operators.rolling import tasks_for
from panelspark.roles import Roles
from panelspark.session import materialize

#: no cut
MAX_FEATURES: int | None = None

log = logging.getLogger(__name__)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant column."""
    n = F.count(x)
    return F.when(n >= 3, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)))


@dataclass(frozen=True)
class Folded:
    """A caller's aggregate in plain Python that never sees a whole key.

    ``partial`` turns some rows of a key (one list per column, nulls left in) into a state, ``merge`` joins two states,
    ``finish`` gives a number or None. Any split of the rows must lead to the same result; states are pickled.
    """

    partial: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


@dataclass(frozen=True)
class Aggregate:
    """A per-key aggregate: how many columns it takes, of which kind, and how it is computed."""

    name: str
    arity: int
    kind: str  # num, bool or code
    fn: Callable[..., Column] | Folded | None  # None: one of the library's own with a plan below


AGGREGATES: dict[str, Aggregate] = {}
#: aggregates of the library that are no expression over columns
PLANNED = ("spearman", "num_unique", "mode")


def register_aggregate(name: str, arity: int, fn: Callable[..., Column] | Folded | None, kind: str = "num") -> None:
    """Add a user aggregate over one or two columns; it then takes part in feature synthesis.

    ``fn`` builds an aggregate expression from columns, or is a ``Folded`` where no expression exists.
    """
    if fn is None and name not in PLANNED:
        raise ValueError(f"aggregate {name!r} needs an expression or a Folded")
    AGGREGATES[name] = Aggregate(name, arity, kind, fn)


register_aggregate("min", 1, F.min)
register_aggregate("max", 1, F.max)
register_aggregate("mean", 1, F.avg)
register_aggregate("sum", 1, F.sum)
register_aggregate("std", 1, F.stddev_samp)
register_aggregate("skew", 1, sample_skewness)
register_aggregate("range", 1, lambda x: F.max(x) - F.min(x))
register_aggregate("pearson", 2, correlation)
register_aggregate("spearman", 2, None)
register_aggregate("percent_true", 1, lambda x: F.avg(x.cast("int")), "bool")
register_aggregate("all", 1, F.bool_and, "bool")
register_aggregate("any", 1, F.bool_or, "bool")
register_aggregate("num_unique", 1, None, "code")
register_aggregate("mode", 1, None, "code")


def entity_base(df: DataFrame, row_id: str, time: str, out: str = "target_id") -> DataFrame:
    """Surrogate row index taken from a unique column, and the time index as a timestamp."""
    return df.withColumn(out, F.col(row_id)).withColumn(time, F.col(time).cast("timestamp_ntz"))


def normalize_dimension(df: DataFrame, key: str, attrs: list[str], time: str, row_id: str) -> DataFrame:
    """One row per key: the attributes of its earliest row, a null value included."""
    first = F.min_by(F.struct(*attrs), F.struct(F.col(time), F.col(row_id)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_a")).select(key, *[f"_a.{a}" for a in attrs])


def aggregate_by_key(df: DataFrame, key: str, funcs: list[str], cols: list[str]) -> DataFrame:
    """``{func}__{col}`` for every single-column aggregate, in one groupBy with map-side partials."""
    exprs = [AGGREGATES[f].fn(F.col(c)).alias(f"{f}__{c}") for c in cols for f in funcs]
    return nan_to_null(df, cols).groupBy(key).agg(*exprs)


#: salts of the first merge of a folded aggregate
FOLD_SALTS = 64
_STATES = "_slot int, _state binary"


def folded_aggregates(df: DataFrame, key: str, feats: list[Feature]) -> DataFrame:
    """One row per key with the ``Folded`` aggregates of ``feats``.

    Every batch of rows folds into one state per key, states of a key meet by salt and then once more, one after the
    other, so a task holds a batch or two states, whatever the key's share of the rows.
    """
    cols = list(dict.fromkeys(c for f in feats for c in f.cols))
    folds = [AGGREGATES[f.agg].fn for f in feats]
    spots = [[cols.index(c) for c in f.cols] for f in feats]
    kind = df.schema[key].dataType.simpleString()
    typed = df.sparkSession.createDataFrame([], f"_key {kind}, _salt int, {_STATES}").toArrow().schema

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), typed)] if rows else [pa.array([], f.type) for f in typed], schema=typed)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(batches):
            groups: dict = {}
            for k, *row in zip(*[c.to_pylist() for c in b.columns]):
                groups.setdefault(k, []).append(row)
            out = []
            for k, rows in groups.items():
                wide = list(map(list, zip(*rows)))
                out += [(k, hash((n, i)) % FOLD_SALTS, i, pickle.dumps(f.partial(*[wide[j] for j in at]))) for i, (f, at) in enumerate(zip(folds, spots))]
            yield batch_of(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for k, salt, slot, data in zip(*[c.to_pylist() for c in b.columns]):
                if now == (k, salt, slot):
                    state = folds[slot].merge(state, pickle.loads(data))
                    continue
                if now is not None:
                    out.append((*now, pickle.dumps(state)))
                now, state = (k, salt, slot), pickle.loads(data)
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if now is not None:
            out.append((*now, pickle.dumps(state)))
        yield batch_of(out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [folds[s].finish(pickle.loads(d)) for s, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([None if x is None else float(x) for x in done], pa.float64())], ["_key", "_slot", "_value"])

    schema = f"_key {kind}, _salt int, {_STATES}"
    states = df.select(F.col(key).alias("_key"), *[F.col(c) for c in cols]).mapInArrow(partial, schema)
    by = ["_key", "_salt", "_slot"]
    salted = states.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by).mapInArrow(merge, schema)
    whole = salted.withColumn("_salt", F.lit(0)).repartition("_key", "_slot").sortWithinPartitions(*by).mapInArrow(merge, schema)
    values = whole.mapInArrow(finish, f"_key {kind}, _slot int, _value double")
    return values.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("_slot") == i, F.col("_value"))).alias(f.name) for i, f in enumerate(feats)])


def code_aggregates(df: DataFrame, key: str, cols: list[str], funcs: list[str] = ("num_unique", "mode")) -> DataFrame:
    """Distinct count and most frequent value (tie: smallest) per key.

    Works on counted (key, column, value) cells, so a hot key is pre-aggregated by value.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    df = nan_to_null(df, cols)
    cells = []
    for c in cols:
        num = F.col(c).cast("double") if isinstance(types[c], T.NumericType) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), num.alias("num"), F.col(c).cast("string").alias("str")))
    counts = (
        df.select(key, F.explode(F.array(*cells)).alias("c"))
        .groupBy(key, "c.column", "c.num", "c.str")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    exprs = []
    for c in cols:
        mine = (F.col("column") == c) & F.col("str").isNotNull()
        if "num_unique" in funcs:
            exprs.append(F.count_if(mine).alias(f"num_unique__{c}"))
        if "mode" in funcs:
            best = F.min(F.when(mine, F.struct(-F.col("cnt"), F.col("num"), F.col("str"))))
            exprs.append(best.getField("str").cast(types[c]).alias(f"mode__{c}"))
    return counts.groupBy(key).agg(*exprs)


def spearman_wide(df: DataFrame, key: str, pairs: list[tuple[str, str]], **kw) -> DataFrame:
    """(key, ``rho_{i}``, ``n_{i}`` per pair): Pearson correlation of average ranks inside each key.

    Columns without nulls share one ranking; a pair with nulls is ranked over its complete rows.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    df = nan_to_null(df, cols)
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    shared = [i for i, (a, b) in enumerate(pairs) if not holes[a] and not holes[b]]
    jobs = [(shared, df)] if shared else []
    for i, (a, b) in enumerate(pairs):
        if i not in shared:
            jobs.append(([i], df.where(F.col(a).isNotNull() & F.col(b).isNotNull())))
    out = None
    for idx, rows in jobs:
        used = list(dict.fromkeys(c for i in idx for c in pairs[i]))
        ranked = row_ranks(rows.where(F.col(key).isNotNull()), used, [key], **kw)
        aggs = []
        for i in idx:
            a, b = (f"{c}__rank" for c in pairs[i])
            aggs += [correlation(F.col(a), F.col(b)).alias(f"rho_{i}"), F.count(a).alias(f"n_{i}")]
        one = ranked.groupBy(key).agg(*aggs)
        out = one if out is None else out.join(one, key, "full")
    return out


def spearman_by_key(df: DataFrame, key: str, pairs: list[tuple[str, str]], **kw) -> DataFrame:
    """``spearman__{a}__{b}`` per pair."""
    wide = spearman_wide(df, key, pairs, **kw)
    return wide.select(key, *[F.col(f"rho_{i}").alias(f"spearman__{a}__{b}") for i, (a, b) in enumerate(pairs)])


def percentile_rank(df: DataFrame, col: str, out: str, **kw) -> DataFrame:
    """Average rank of the value over the non-null count; null stays null."""
    r = column_ranks(df, [col]).select(
        F.col("value").alias("_v"), (F.col("avg_rank") / F.col("total")).alias(out)
    )
    work = df.withColumn("_v", F.col(col).cast("double"))
    return lookup_join(work, r, "_v", **({"max_bytes": 0} | kw)).drop("_v")


#: bytes of a value and its percentile in a broadcast
RANK_BYTES = 32


def percentile_ranks(df: DataFrame, cols: list[str], prefix: str = "percentile__", **kw) -> DataFrame:
    """``df`` with ``percentile__{c}`` for every column, from one ranking of all of them."""
    rows = materialize(df, "rows")
    return attach_percentiles(rows, percentile_table(rows, cols), cols, prefix, **kw)


def percentile_table(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, cnt, total, _p), one row per distinct value of each column, written once."""
    ranks = column_ranks(rows, cols).select("column", "value", "cnt", "total", (F.col("avg_rank") / F.col("total")).alias("_p"))
    # adding zero gives -0.0 the rank of 0.0
    return materialize(ranks.withColumn("value", F.col("value") + F.lit(0.0)), "ranks")


def attach_percentiles(
    rows: DataFrame, ranks: DataFrame, cols: list[str], prefix: str = "percentile__", max_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` with the percentiles that ``ranks`` gives to the values of ``cols``; rows may be read more than once.

    Columns of few values are broadcast, ``max_bytes`` in all. A single other column meets its ranks in one shuffle of the
    rows; several are joined as narrow cells, so the shuffled bytes grow with the columns and not with their square.
    """
    held = {r["column"]: r for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).collect()}
    small, room = [], max_bytes
    for c in sorted(cols, key=lambda c: held[c]["n"] if c in held else 0):
        room -= RANK_BYTES * (held[c]["n"] if c in held else 0)
        if room >= 0:
            small.append(c)
    large, out = [c for c in cols if c not in small], rows
    if len(large) == 1:
        c = large[0]
        hot = ranks.where((F.col("column") == c) & (F.col("cnt") > hot_rows)).select(F.col("value").alias("_v"), F.col("cnt").alias("n_rows"))
        # at most one per ``hot_rows`` rows
        local, work, mine = hot.toArrow(), _with_value(out, c), _ranks_of(ranks, c, prefix)
        if local.num_rows or out.count() - held[c]["total"] > hot_rows:
            out = salted_join(work, mine, ["_v"], rows.sparkSession.createDataFrame(local, schema=hot.schema)).drop("_v")
        else:
            out = work.join(mine, "_v", "left").drop("_v")
    elif large:
        out = _percentiles_by_cells(out, ranks, large, prefix, hot_rows)
    for c in small:
        out = _with_value(out, c).join(F.broadcast(_ranks_of(ranks, c, prefix)), "_v", "left").drop("_v")
    return out.select(*rows.columns, *[prefix + c for c in cols])


def _with_value(rows: DataFrame, c: str) -> DataFrame:
    value = F.col(c).cast("double")
    return rows.withColumn("_v", F.when(~F.isnan(value), value + F.lit(0.0)))


def _ranks_of(ranks: DataFrame, c: str, prefix: str) -> DataFrame:
    return ranks.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("_p").alias(prefix + c))


def _percentiles_by_cells(rows: DataFrame, ranks: DataFrame, cols: list[str], prefix: str, hot_rows: int) -> DataFrame:
    # written, as another run may number the rows in another way
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    cells = rows.select("_row", F.explode(F.array(*parts)).alias("_c")).select("_row", "_c.column", "_c.value")
    cells = cells.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value") + F.lit(0.0))
    found = lookup_join(cells, ranks.select("column", "value", "_p"), ["column", "value"], "inner", max_bytes=0, hot_rows=hot_rows)
    wide = found.groupBy("_row").agg(*[F.max(F.when(F.col("column") == c, F.col("_p"))).alias(prefix + c) for c in cols])
    return rows.join(wide, "_row", "left").drop("_row")


def point_distances(points: list[tuple[str, str]]) -> dict[str, Column]:
    """``haversine__{lat}__{lat}`` in miles for every two points of a row, named after their latitude columns."""
    return {
        f"haversine__{a[0]}__{b[0]}": haversine_distance(*[F.col(c) for c in (*a, *b)]) for a, b in combinations(points, 2)
    }


def transform_columns(time: str) -> dict[str, Column]:
    return {f"{k}__{time}": v for k, v in date_parts(F.col(time)).items()}


@dataclass(frozen=True)
class Feature:
    agg: str
    cols: tuple[str, ...]

    @property
    def name(self) -> str:
        return "__".join((self.agg, *self.cols))


def plan_features(
    numerics: list[str], bools: list[str], codes: list[str], max_features: int | None = MAX_FEATURES
) -> list[Feature]:
    """Every registered aggregate over every fitting column or pair, in a fixed order.

    A limit cuts the list and logs the features that it leaves out.
    """
    cols = {"num": list(numerics), "bool": list(bools), "code": list(codes)}
    feats = [
        Feature(a.name, combo) for a in AGGREGATES.values() for combo in combinations(cols[a.kind], a.arity)
    ]
    if max_features is not None and len(feats) > max_features:
        left = [f.name for f in feats[max_features:]]
        log.warning("max_features=%d leaves out %d of %d features: %s", max_features, len(left), len(feats), ", ".join(left))
    return feats[:max_features]


#: rows times columns and features of one task
DEALT_CELLS = 16_000_000


def compute_features(df: DataFrame, key: str, feats: list[Feature], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """One row per key with every planned feature."""
    return _features(df, df, key, feats, {}, hot_rows)


def _features(base: DataFrame, wide: DataFrame, key: str, feats: list[Feature], gaps: dict[str, str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """``compute_features`` of ``wide``.

    ``base`` has the same rows without the columns that cost a join; ``gaps`` names the column of ``base`` that is missing
    where such a column is. Rows of a key are shuffled whole, as the states of many aggregates are wider than the few rows
    of most keys; keys of more than ``hot_rows`` rows are aggregated before the shuffle.
    """
    cols = list(dict.fromkeys(c for f in feats for c in f.cols))
    wide = nan_to_null(wide.where(F.col(key).isNotNull()), cols)
    base = wide if not gaps else nan_to_null(base.where(F.col(key).isNotNull()), [c for c in cols if c not in gaps])
    paired = list(dict.fromkeys(gaps.get(c, c) for f in feats if f.agg == "spearman" for c in f.cols))
    counts = base.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()) for c in paired]).first()
    n_rows, holes = counts[0], {c for c, n in zip(paired, counts[1:]) if n}
    hot = hot_keys(base.select(key), [key], hot_rows) if n_rows > hot_rows else None
    if hot is None:
        return _whole_keys(base, wide, key, feats, gaps, holes, n_rows)
    marks = F.broadcast(hot.select(key))
    cold = _whole_keys(base.join(marks, key, "left_anti"), wide.join(marks, key, "left_anti"), key, feats, gaps, holes, n_rows)
    return cold.unionByName(_spread_keys(base.join(marks, key, "left_semi"), wide.join(marks, key, "left_semi"), key, feats, hot_rows))


def _kinds(feats: list[Feature]) -> tuple[list[Feature], list[Feature], list[str], list[tuple[str, ...]]]:
    """Folded features, those that are expressions, columns of codes, pairs to rank."""
    folded = [f for f in feats if isinstance(AGGREGATES[f.agg].fn, Folded)]
    direct = [f for f in feats if AGGREGATES[f.agg].fn is not None and f not in folded]
    coded = list(dict.fromkeys(f.cols[0] for f in feats if f.agg in ("num_unique", "mode")))
    return folded, direct, coded, [f.cols for f in feats if f.agg == "spearman"]


def _expressions(direct: list[Feature]) -> list[Column]:
    return [AGGREGATES[f.agg].fn(*[F.col(c) for c in f.cols]).alias(f.name) for f in direct]


def _joined(frames: list[DataFrame], key: str, feats: list[Feature]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "left")
    return out.select(key, *[f.name for f in feats])


def _whole_keys(
    base: DataFrame, wide: DataFrame, key: str, feats: list[Feature], gaps: dict[str, str], holes: set[str], n_rows: int
) -> DataFrame:
    """Two shuffles of narrow rows by key, one for numbers and flags, one for codes; all the rest stays inside the tasks."""
    folded, direct, coded, pairs = _kinds(feats)
    used = list(dict.fromkeys(c for f in feats if f in direct or f.agg == "spearman" for c in f.cols))
    tasks = tasks_for(wide, n_rows, len(used) + len(feats), DEALT_CELLS)
    frames = []
    if used:
        ranks: dict[tuple[str, str | None], Column] = {}

        def rank(c: str, other: str) -> Column:
            """Rank of ``c`` over the rows that have ``other`` too; columns without missing values share one."""
            beside = gaps.get(other, other)
            if beside not in holes or beside == gaps.get(c, c):
                beside = None
            x = F.col(c).cast("double")
            if (c, beside) not in ranks:
                ranks[c, beside] = window_rank(x if beside is None else F.when(F.col(other).isNotNull(), x), [key]).alias(f"_rank_{len(ranks)}")
            return F.col(f"_rank_{list(ranks).index((c, beside))}")

        rho = [correlation(rank(a, b), rank(b, a)).alias(f"spearman__{a}__{b}") for a, b in pairs]
        dealt = wide.select(key, *used).repartition(tasks, key).select("*", *ranks.values())
        frames.append(dealt.groupBy(key).agg(*_expressions(direct), *rho))
    if coded:
        frames.append(code_aggregates(base.select(key, *coded).repartition(tasks, key), key, coded))
    if folded:
        frames.append(folded_aggregates(wide, key, folded))
    return _joined(frames, key, feats)


def _spread_keys(base: DataFrame, wide: DataFrame, key: str, feats: list[Feature], hot_rows: int) -> DataFrame:
    """Aggregates that are folded before the shuffle, for keys of many rows."""
    folded, direct, coded, pairs = _kinds(feats)
    frames = []
    if direct:
        frames.append(wide.groupBy(key).agg(*_expressions(direct)))
    if coded:
        frames.append(code_aggregates(base, key, coded))
    if pairs:
        frames.append(spearman_by_key(wide, key, pairs, hot_rows=hot_rows))
    if folded:
        frames.append(folded_aggregates(wide, key, folded))
    return _joined(frames, key, feats)


def feature_synthesis(
    df: DataFrame,
    item: str,
    roles: Roles,
    parent: DataFrame | None = None,
    parent_key: str | None = None,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """Depth-2 features per item: aggregates of base columns, of transforms, and of parent attributes.

    Transforms are the date parts of the time, the percentile of every numeric column over all rows, and the distance of
    every two points. The label never takes part.
    """
    # columns any aggregate will read; the label and unused columns are dropped before the shuffle
    rows = df
    numerics = [c for c in roles.numerics if c != roles.label]
    codes = [c for c in roles.codes if c != roles.label]
    bools = [c for c in roles.flags if c != roles.label]
    if roles.time:
        parts = transform_columns(roles.time)
        rows = rows.withColumns(parts)
        codes += list(parts)
    distances = point_distances(list(roles.points))
    gaps = {f"percentile__{c}": c for c in numerics}
    if numerics:
        keep = dict.fromkeys([item, *numerics, *bools, *codes, *([parent_key] if parent is not None else []), *[c for p in roles.points for c in p]])
        rows = materialize(rows.select(*keep), "rows")
        ranks = percentile_table(rows, numerics)
    ranked, numerics = numerics, numerics + list(gaps)
    if distances:
        rows = rows.withColumns(distances)
        numerics += list(distances)
    if parent is not None:
        attrs = [f for f in parent.schema.fields if f.name not in (parent_key, roles.label)]
        renamed = parent.select(parent_key, *[F.col(f.name).alias(f"parent__{f.name}") for f in attrs])
        local = fetch_bounded(renamed)
        # a shuffled join is written, as the rows are read several times
        rows = rows.join(F.broadcast(local), parent_key, "left") if local is not None else materialize(lookup_join(rows, renamed, parent_key, max_bytes=0), "rows")
        for f in attrs:
            kind = numerics if isinstance(f.dataType, T.NumericType) else bools if isinstance(f.dataType, T.BooleanType) else codes
            kind.append(f"parent__{f.name}")
    used = list(dict.fromkeys([item, *numerics, *bools, *codes]))
    base = rows.select(*[c for c in used if c not in gaps])
    # codes are read from ``base``; only numbers and flags take part in the join of the percentiles
    wide = attach_percentiles(base.select(*dict.fromkeys([item, *[c for c in numerics if c not in gaps], *bools])), ranks, ranked) if ranked else base
    return _features(base, wide, item, plan_features(numerics, bools, codes, max_features), gaps)


def attach_features(rows: DataFrame, features: DataFrame, key: str, drop: list[str] = (), **kw) -> DataFrame:
    """Left-join the feature columns that ``rows`` does not have yet, then drop the surrogate columns."""
    fresh = [c for c in features.columns if c != key and c not in rows.columns]
    return lookup_join(rows, features.select(key, *fresh), key, **kw).drop(*drop)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form; rows with a null in either column are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n_rows"))
