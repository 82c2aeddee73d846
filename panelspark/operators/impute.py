"""Imputation: fit a one-row table of fill values or a model, then apply."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.clean import NO_TEXT, null_profile
from panelspark.operators.joins import attach_one_row
from panelspark.operators.ranks import exact_quantiles
from panelspark.session import materialize, scratch_dir

METHODS = ("mean", "most", "median", "linear_reg", "random_forest", "random_forest_code", "knn")
ROUNDS = 10
TOLERANCE = 1e-3


def _present(df: DataFrame, c: str):
    """The value with NaN read as null."""
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), F.col(c))
    return F.col(c)


def fit_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the most frequent value per column, the smallest on ties.

    All columns are counted in one shuffle of (column, value) pairs with map-side partial counts.
    """
    cells = []
    for c in cols:
        dt = df.schema[c].dataType
        num = F.col(c).cast("double") if isinstance(dt, T.NumericType) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), num.alias("num"), _present(df, c).cast("string").alias("str")))
    counts = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .where(F.col("str").isNotNull())
        .groupBy("column", "num", "str")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    best = F.struct(-F.col("cnt"), F.col("num"), F.col("str"))
    return counts.agg(
        *[
            F.min(F.when(F.col("column") == c, best)).getField("str").cast(df.schema[c].dataType).alias(c)
            for c in cols
        ]
    )


def fit_fill(df: DataFrame, cols: list[str], method: str) -> DataFrame:
    """One-row table of fill values for mean, median or most."""
    if method == "mean":
        return df.agg(*[F.avg(_present(df, c)).alias(c) for c in cols])
    if method == "median":
        q = exact_quantiles(df, cols, {"m": 0.5})
        return q.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in cols])
    if method == "most":
        return fit_mode(df, cols)
    raise ValueError(f"no constant fill for method {method!r}")


def apply_fill(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    named = params.select(*[F.col(c).alias(f"{c}__fill") for c in cols])
    out = attach_one_row(df, named).withColumns({c: F.coalesce(_present(df, c), F.col(f"{c}__fill")) for c in cols})
    return out.select(*df.columns)


STATE = (
    "round int, step int, column string, mean double, intercept double, coefficients array<double>, others array<string>, model string"
)


def _fit_chain(df: DataFrame, cols: list[str], row_id: str, fit_step, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(filled table, state) of round-robin regression of each column on the others, starting from column means.

    Columns go in order of ascending null count; rounds stop when the largest change falls below TOLERANCE times the
    largest observed magnitude. Each round is written out, so plans stay short. The state has a row per column with its
    mean (round 0) and one per regression in the order of their use: coefficients, or where the model is kept. A column
    without any value stays null and predicts nothing.
    """
    flags = {f"{c}__gap": _present(df, c).isNull() for c in cols}
    work = df.withColumns(flags)
    means = fit_fill(df, cols, "mean").first()
    known = [c for c in cols if means[c] is not None]
    state = [(0, i, c, float(means[c]), None, None, None, None) for i, c in enumerate(known)]
    spark = df.sparkSession
    if not known:
        return df, spark.createDataFrame(state, STATE)
    stats = work.agg(
        *[F.count_if(f"{c}__gap").alias(f"{c}__n") for c in known],
        F.max(F.greatest(F.lit(0.0), *[F.abs(_present(df, c).cast("double")) for c in known])).alias("_big"),
    ).first()
    todo = sorted([c for c in known if stats[f"{c}__n"]], key=lambda c: (stats[f"{c}__n"], cols.index(c)))
    if not todo or len(known) == 1:
        return apply_chain(df, spark.createDataFrame(state, STATE)), spark.createDataFrame(state, STATE)
    limit = TOLERANCE * float(stats["_big"])
    start = {c: F.coalesce(_present(df, c).cast("double"), F.lit(float(means[c]))) for c in known}
    cur = materialize(work.withColumns(start), "impute")
    # with one gappy column its predictors never change, so one round is the fixed point
    for k in range(1, 2 if len(todo) == 1 else rounds + 1):
        before = cur.select(row_id, *[F.col(c).alias(f"{c}__old") for c in todo])
        nxt = cur
        for i, c in enumerate(todo):
            others = [o for o in known if o != c]
            row = (k, i, c, None, *fit_step(nxt, c, others, f"{k}-{i}"))
            state.append(row)
            nxt = _step(nxt, row, F.col(f"{c}__gap"))
        cur = materialize(nxt.select(*cur.columns), "impute")
        if len(todo) > 1:
            moved = cur.join(before, row_id).agg(
                F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"{c}__old")) for c in todo]))
            )
            if (moved.first()[0] or 0.0) < limit:
                break
    return cur.select(*df.columns), spark.createDataFrame(state, STATE)


def _step(df: DataFrame, row: tuple, gap) -> DataFrame:
    """``df`` with the gaps of one column predicted by one row of a state."""
    _, _, c, _, intercept, coefficients, others, model = row
    if model is None:
        guess = F.lit(float(intercept))
        for w, o in zip(coefficients, others):
            guess = guess + F.lit(float(w)) * F.col(o)
        return df.withColumn(c, F.when(gap, guess).otherwise(F.col(c)))
    scored = RandomForestRegressionModel.load(model).transform(VectorAssembler(inputCols=others, outputCol="_x").transform(df))
    return scored.withColumn(c, F.when(gap, F.col("prediction")).otherwise(F.col(c))).select(*df.columns)


def apply_chain(df: DataFrame, state: DataFrame) -> DataFrame:
    """Fill the gaps of any table by a fitted chain: means first, then every regression in the order of the fit.

    A gap in a column that had none in the fit takes the mean. The state has rounds x columns rows.
    """
    rows = sorted(tuple(r) for r in state.select(*[c.split()[0] for c in STATE.split(", ")]).collect())
    means = {r[2]: r[3] for r in rows if r[0] == 0}
    gaps = {f"{c}__gap": _present(df, c).isNull() for c in means}
    out = df.withColumns(gaps).withColumns({c: F.coalesce(_present(df, c).cast("double"), F.lit(m)) for c, m in means.items()})
    for row in rows:
        if row[0]:
            out = _step(out, row, F.col(f"{row[2]}__gap"))
    return out.select(*df.columns)


def _linear_step(cur: DataFrame, c: str, others: list[str], _: str) -> tuple:
    v = VectorAssembler(inputCols=others, outputCol="_x").transform(cur)
    model = LinearRegression(featuresCol="_x", labelCol=c, solver="normal", regParam=0.0).fit(v.where(~F.col(f"{c}__gap")).select("_x", c))
    return float(model.intercept), [float(x) for x in model.coefficients], others, None


def _forest_step(path: str, trees: int):
    def step(cur: DataFrame, c: str, others: list[str], name: str) -> tuple:
        v = VectorAssembler(inputCols=others, outputCol="_x").transform(cur)
        model = RandomForestRegressor(featuresCol="_x", labelCol=c, numTrees=trees, seed=42).fit(v.where(~F.col(f"{c}__gap")).select("_x", c))
        model.write().overwrite().save(f"{path}/models/{name}")
        return None, None, others, f"{path}/models/{name}"

    return step


def fit_linear(df: DataFrame, cols: list[str], row_id: str, path: str, rounds: int = ROUNDS) -> DataFrame:
    """``df`` filled by chained linear regressions, which are kept at ``path`` for ``apply_saved``."""
    out, state = _fit_chain(df, cols, row_id, _linear_step, rounds)
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
    return out


def fit_forest(df: DataFrame, cols: list[str], row_id: str, path: str, trees: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """``df`` filled by chained forests, which are kept at ``path`` for ``apply_saved``."""
    out, state = _fit_chain(df, cols, row_id, _forest_step(path, trees), rounds)
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
    return out


def apply_saved(df: DataFrame, path: str) -> DataFrame:
    """Fill ``df`` by what ``fit_linear``, ``fit_forest`` or a constant fill kept at ``path``, without a new fit."""
    return apply_chain(df, df.sparkSession.read.schema(STATE).parquet(f"{path}/state"))


def impute_linear(df: DataFrame, cols: list[str], row_id: str, rounds: int = ROUNDS) -> DataFrame:
    return _fit_chain(df, cols, row_id, _linear_step, rounds)[0]


def impute_forest(df: DataFrame, cols: list[str], row_id: str, trees: int = 100, rounds: int = ROUNDS) -> DataFrame:
    return fit_forest(df, cols, row_id, scratch_dir(df.sparkSession, "forest"), trees, rounds)


def impute_forest_code(df: DataFrame, col: str, features: list[str], trees: int = 20) -> DataFrame:
    """Fill a code column from complete numeric columns with a forest classifier; without a known code nothing changes."""
    known = df.where(F.col(col).isNotNull())
    if known.isEmpty():
        return df
    index = StringIndexer(inputCol=col, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=42).fit(
        assembler.transform(index.transform(known)).select("_x", "_y")
    )
    scored = model.transform(assembler.transform(df))
    names = F.array(*[F.lit(v) for v in index.labels])
    guess = F.get(names, F.col("prediction").cast("int"))
    return scored.withColumn(col, F.coalesce(F.col(col), guess)).select(*df.columns)


def impute(df: DataFrame, cols: list[str], method: str, row_id: str = "row_id", **kw) -> DataFrame:
    """All seven methods by name."""
    if method in ("mean", "most", "median"):
        return apply_fill(df, fit_fill(df, cols, method), cols)
    if method == "linear_reg":
        return impute_linear(df, cols, row_id, **kw)
    if method == "random_forest":
        return impute_forest(df, cols, row_id, **kw)
    if method == "random_forest_code":
        return impute_forest_code(df, cols[-1], cols[:-1], **kw)
    if method == "knn":
        from panelspark.operators.neighbors import impute_knn

        return impute_knn(df, cols, row_id, **kw)
    raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")


def impute_codes(df: DataFrame, cols: list[str], texts: list[str], path: str) -> DataFrame:
    """Most frequent value for code, key and date columns; marker for texts; fill values kept at ``path``."""
    fit_fill(df, cols, "most").write.mode("overwrite").parquet(path)
    out = apply_fill(df, df.sparkSession.read.parquet(path), cols)
    return out.withColumns({t: F.coalesce(F.col(t), F.lit(NO_TEXT)) for t in texts}) if texts else out


def impute_amounts(df: DataFrame, cols: list[str], method: str, path: str, row_id: str = "row_id", **kw) -> DataFrame:
    """Chosen method for amounts; fill values and chained models are kept at ``path`` for ``apply_saved``.

    The neighbour method keeps nothing: its model is the table itself.
    """
    if method in ("mean", "most", "median"):
        fill = fit_fill(df, cols, method).first()
        means = [(0, i, c, float(fill[c]), None, None, None, None) for i, c in enumerate(cols) if fill[c] is not None]
        df.sparkSession.createDataFrame(means, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        return apply_saved(df, path)
    if method == "linear_reg":
        return fit_linear(df, cols, row_id, path, **kw)
    if method == "random_forest":
        return fit_forest(df, cols, row_id, path, **kw)
    return impute(df, cols, method, row_id, **kw)


def impute_remaining(df: DataFrame) -> DataFrame:
    """Most frequent value for every column that still holds nulls."""
    holes = [r["column"] for r in null_profile(df).where("n_null > 0 and column <> '__total__'").collect()]
    return apply_fill(df, fit_fill(df, holes, "most"), holes) if holes else df
