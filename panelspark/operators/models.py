"""Model fit and batch scoring on tables."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = (128, 64, 32, 16)


def fit_mlp(df: DataFrame, cols: list[str], label: str, classes: int = 2, max_iter: int = 100, seed: int = 42):
    """Tabular network with hidden layers 128-64-32-16."""
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(df).select(
        "features", F.col(label).cast("double").alias("label")
    )
    net = MultilayerPerceptronClassifier(layers=[len(cols), *HIDDEN, classes], maxIter=max_iter, seed=seed)
    return net.fit(data)


def score_table(model, df: DataFrame, cols: list[str], out: str = "score") -> DataFrame:
    """Probability of class 1 and the predicted class for every row."""
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    scored = model.transform(data)
    return scored.withColumns(
        {out: vector_to_array("probability").getItem(1), "predicted": F.col("prediction").cast("int")}
    ).select(*df.columns, out, "predicted")
