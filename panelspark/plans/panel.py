"""The reference jobs end to end, as chains of lazy DataFrames; only fits are actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions import scalar
from panelspark.operators import clean, encode, impute, quantile, rolling, sampling, scale, select, stats, synth, text
from panelspark.operators.resample import rebalance
from panelspark.roles import Roles
from panelspark.session import materialize, scratch_dir
from panelspark.sources import tables as src


def panel_features(df: DataFrame, roles: Roles, specs: list[rolling.Spec], positive: Column) -> DataFrame:
    """Log amounts, quantile bands, rolling windows and a 0/1 label ``f`` for every row."""
    amounts = list(roles.amounts)
    fitted = quantile.fit_thresholds(df, amounts)
    out = rolling.rolling_features(df, specs, roles.time, roles.row_id)
    out = quantile.quantile_bands(out, amounts, fitted)
    out = out.withColumns({f"{a}_log": scalar.amt_log(F.col(a)) for a in amounts})
    return out.withColumn("f", F.when(positive, 1).otherwise(0))


@dataclass(frozen=True)
class PreprocessRules:
    allowed: list
    noise: list
    label_tests: list
    drop: list
    one_hot: dict
    business_id: str | None = None
    amount_method: str = "median"
    text_method: str = "lda"
    vec_size: int = 4


def preprocess(df: DataFrame, roles: Roles, rules: PreprocessRules) -> DataFrame:
    """Noise rows out, labels, imputation, flags, one-hot, text vectors, log and sign columns, narrow types.

    Every statistic and model is fitted on the whole table.
    """
    spark = df.sparkSession
    out = clean.drop_noise_rows(df, rules.allowed, rules.noise)
    out = clean.label_multiclass(out, rules.label_tests, rules.drop)
    out = impute.impute_codes(out, [*roles.codes, *roles.keys], list(roles.texts), scratch_dir(spark, "codes"))
    out = impute.impute_amounts(out, list(roles.numerics), rules.amount_method, scratch_dir(spark, "amounts"), roles.row_id)
    if rules.business_id:
        out = out.withColumn(rules.business_id, scalar.business_code_flag(F.col(rules.business_id)))
    for col, values in rules.one_hot.items():
        out = encode.one_hot_list(out, col, values)
    if roles.texts:
        out = text.text_features(out, list(roles.texts), rules.text_method, rules.vec_size, row_id=roles.row_id)
    out = out.withColumns({f"{c}_log": scalar.amt_log(F.col(c)) for c in roles.amounts})
    out = out.withColumns({f"{c}_sign": scalar.add_sign(F.col(c)) for c in roles.numerics})
    return clean.narrow_types(materialize(out, "preprocess"))


def rolling_stage(df: DataFrame, roles: Roles, periods=(7, 15, 30)) -> DataFrame:
    """Global quantile bands, the whole rolling grid, remaining nulls filled, strings dropped, types narrowed."""
    fitted = quantile.fit_thresholds(df, list(roles.amounts))
    specs = rolling.feature_grid(list(roles.keys), list(roles.amounts), list(periods), ["sum", "mean", "min", "max"])
    specs += rolling.feature_grid(list(roles.keys), list(roles.codes), list(periods), ["cnt"])
    out = rolling.rolling_features(df, specs, roles.time, roles.row_id)
    out = materialize(quantile.quantile_bands(out, list(roles.amounts), fitted), "rolling")
    return clean.narrow_types(clean.drop_string_columns(impute.impute_remaining(out)))


def synthesis_stage(df: DataFrame, item: str, business: str, attrs: list[str], roles: Roles, max_features: int | None = synth.MAX_FEATURES) -> DataFrame:
    """Business dimension, depth-2 features per item, attached to every row."""
    base = synth.entity_base(df, roles.row_id, roles.time)
    parent = synth.normalize_dimension(base, business, attrs, roles.time, roles.row_id)
    feats = synth.feature_synthesis(base, item, roles, parent, business, max_features)
    return synth.attach_features(base, materialize(feats, "features"), item, drop=["target_id"])


def selection_stage(df: DataFrame, cols: list[str], label: str, k: int = select.TOP_K, trees: int = select.TREES, needed: int = select.VOTES_NEEDED) -> DataFrame:
    """Robust scaling, six selectors and their vote."""
    scaled = materialize(scale.scale(clean.fill_constant(df.select(label, *cols)), cols, "robust"), "scaled")
    votes = [
        select.select_correlation(scaled, cols, label, k),
        select.select_anova_f(scaled, cols, label, k),
        select.select_logistic(scaled, cols, label),
        select.select_forest(scaled, cols, label, trees),
        select.select_rfe(scaled, cols, label, k),
        select.select_boosting(scaled, cols, label, trees),
    ]
    return select.vote_features(votes, needed)


def training_tables(df: DataFrame, cols: list[str], label: str, row_id: str, kind: str = "standard", types: str = "None", over: str | None = None, under: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Stratified hold-out, scaler fitted on train, rebalanced train: (train, test) of (id, vec, label).

    ``cate_smote`` takes integer columns as codes: they stay unscaled and stand behind the others in ``vec``.
    """
    codes = [c for c in cols if over == "cate_smote" and isinstance(df.schema[c].dataType, T.IntegralType)]
    numbers = [c for c in cols if c not in codes]
    cols, extra = numbers + codes, {"nominal_from": len(numbers)} if over == "cate_smote" else {}
    split = sampling.stratified_split(df, label, row_id)
    train, test = (split.where(F.col("role") == r) for r in ("train", "test"))
    train, test = scale.fit_apply_scaler(train, test, numbers, kind, scratch_dir(df.sparkSession, "scaler"))
    shape = lambda d: d.select(F.col(row_id).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"), F.col(label).alias("label"))
    return rebalance(materialize(shape(train), "train"), types, over, under, **extra), shape(test)


def statistics_stage(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Normality, correlation and significance verdicts in one long table."""
    return (
        stats.normality_report(df, cols, label)
        .unionByName(stats.correlation_report(df, cols, label))
        .unionByName(stats.significance_report(df, cols, label))
    )


def sharding_stage(df: DataFrame, key: str, path: str, shards: int = src.DEFAULT_SHARDS) -> DataFrame:
    return src.shard_by_key(df, key, path, shards)
