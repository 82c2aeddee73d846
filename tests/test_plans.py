"""The end-to-end jobs on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from panelspark.plans import panel
from panelspark.queries.base import Tables
from panelspark.roles import Roles
from panelspark.session import scratch_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_preprocess(t):
    docs = t.documents.select((F.col("doc_id") % 1000).alias("row_id"), "text").dropDuplicates(["row_id"])
    df = t.panel_nulls.join(docs, "row_id", "left").withColumn("ident", F.lpad(F.col("row_id").cast("string"), 8, "0"))
    df = df.withColumn("grade", F.when(F.col("row_id") % 2 == 0, "Y").otherwise("N"))
    roles = Roles(keys=("key",), time="t", codes=("code", "grade"), amounts=("amt",), texts=("text",))
    rules = panel.PreprocessRules(
        allowed=[("code", "error"), ("code", "view"), ("code", "click")], noise=[("grade", "O")],
        label_tests=[F.col("code") == "error"], drop=[], one_hot={"grade": ["Y", "N", "O"]}, business_id="ident",
    )
    out = panel.preprocess(df, roles, rules)
    assert {"target", "amt_log", "amt_sign", "grade_Y", "text_0", "text_3"} <= set(out.columns)
    assert "text" not in out.columns and "grade" not in out.columns
    assert out.where("amt is null or code is null").count() == 0
    assert out.count() == df.where("code in ('error', 'view', 'click')").count()


def test_rolling_stage(t):
    roles = Roles(keys=("key",), time="t", codes=("code",), amounts=("amt",))
    out = panel.rolling_stage(t.panel_nulls, roles, periods=(7,))
    assert out.count() == t.panel_nulls.count()
    assert "code" not in out.columns and {"key_n_amt_max_7", "key_n_code_cnt_7", "amt_4th_yn"} <= set(out.columns)


def test_synthesis_selection_and_training(t):
    rows = t.orders_panel.withColumns({"late": F.month("t") > 6, "target": (F.col("status") == "F").cast("int"), "item": F.col("row_id") % 40})
    roles = Roles(keys=("key",), time="t", amounts=("amt",), codes=("priority",), flags=("late",), label="target")
    wide = panel.synthesis_stage(rows, "item", "key", ["status", "priority"], roles)
    assert wide.count() == rows.count() and "mean__amt" in wide.columns and not [c for c in wide.columns if c.endswith("__target")]
    cols = ["amt", "mean__amt", "std__amt", "num_unique__priority", "skew__amt"]
    votes = panel.selection_stage(wide, cols, "target", k=3, trees=3, needed=3)
    assert votes.count() == len(cols)
    train, test = panel.training_tables(
        wide.na.fill(0.0, cols), cols, "target", "row_id", types="both", over="ros", under="rus"
    )
    assert train.groupBy("label").count().select("count").distinct().count() == 1
    assert train.join(test, "id", "left_semi").count() == 0


def test_statistics_stage(t):
    out = panel.statistics_stage(t.stat, ["x1", "x2"], "f")
    assert {r["test"] for r in out.select("test").distinct().collect()} >= {"shapiro", "kendall", "label_spearman", "ttest"}
    assert out.where("verdict is null").count() == 0


def test_sharding_stage(t, spark):
    out = panel.sharding_stage(t.panel, "key", scratch_dir(spark, "shards"), 6)
    assert out.count() == t.panel.count()
    assert out.groupBy("key").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_categorical_smote_by_column_type(spark):
    rows = [(i, float(i % 13), i % 3, float(i % 7), int(i % 6 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, a double, code int, b double, y int")
    train, test = panel.training_tables(df, ["a", "code", "b"], "y", "row_id", types="over", over="cate_smote")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts[0] == counts[1] and {r.vec[2] for r in train.collect()} <= {0.0, 1.0, 2.0}
    assert test.count() == 24 and len({r.id for r in train.collect()}) == train.count()
