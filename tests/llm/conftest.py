import pytest


@pytest.fixture()
def table(spark):
    """A table from rows, in a few partitions, with columns that clash with internal names."""

    def make(rows, schema, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema).repartition(3)
        return df.withColumns({"_part": F.lit(7), "score": F.lit("x"), "n_words": F.lit(None).cast("int")}) if extra else df

    return make
