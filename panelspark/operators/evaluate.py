"""Evaluation of scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranks import column_ranks


def _counts(label: str, positive: Column) -> list[Column]:
    y = F.col(label) == 1
    return [
        F.count_if(y & positive).alias("tp"),
        F.count_if(y & ~positive).alias("fn"),
        F.count_if(~y & positive).alias("fp"),
        F.count_if(~y & ~positive).alias("tn"),
    ]


def confusion_counts(df: DataFrame, label: str, score: str, cutoff: float = 0.5, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_counts(label, F.col(score) >= cutoff))


def binary_metrics(df: DataFrame, label: str, score: str, cutoff: float = 0.5, by: list[str] = ()) -> DataFrame:
    """recall, precision and f1; null when the denominator is zero."""
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    c = confusion_counts(df, label, score, cutoff, by)
    return c.select(
        *by,
        "tp", "fn", "fp", "tn",
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def threshold_eval_log(df: DataFrame, label: str, score: str, rnd: str, cutoff: float = 0.5) -> DataFrame:
    """recall and precision per training round."""
    return binary_metrics(df, label, score, cutoff, [rnd]).select(rnd, "recall", "precision")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC from average ranks of the distinct scores; rows without a label are left out."""
    r = column_ranks(df.where(F.col(label).isNotNull()), [score], split={"n1": F.col(label) == 1})
    n1 = F.col("n1").cast("double")
    s = r.agg(F.sum("cnt").cast("double").alias("n"), F.sum(n1).alias("p"), F.sum(n1 * F.col("avg_rank")).alias("rs"))
    p, n = F.col("p"), F.col("n")
    return s.select(F.try_divide(F.col("rs") - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def focal_loss(
    df: DataFrame, label: str, probs: list[str], gamma: float = 2.0, alpha: float = 4.0, eps: float = 1e-9
) -> DataFrame:
    """Mean over rows of the largest per-class term alpha * y * (1-p)^gamma * -ln p."""
    terms = []
    for i, c in enumerate(probs):
        y, p = F.when(F.col(label) == i, 1.0).otherwise(0.0), F.col(c) + eps
        terms.append(alpha * y * F.pow(1 - p, F.lit(gamma)) * -F.log(p))
    return df.agg(F.avg(F.array_max(F.array(*terms))).alias("focal_loss"))


def balanced_class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * n_c)."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = per.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return per.crossJoin(F.broadcast(tot)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
