"""Poisson mixing against its SQL, the line field against enumeration, and the pipeline stage by stage."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from cases import DOCS, documents
from panelspark.llm import mixing, quality

SF = "/root/testdata/sf0.001"


# ---- mixing --------------------------------------------------------------------------------------


def test_mixing_matches_its_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert compare(mixing.mix_sources(docs).toArrow(), connect(SF).sql(mixing.SQL).to_arrow_table()) is None


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 4, "mid").otherwise(None).alias("source"))
    out = mixing.mix_sources(docs, {"rare": 3.0, "mid": 1.0}, default_weight=0.0, size=80_000)
    n = Counter(r.source for r in out.select("source").collect())
    # 2,000 documents with a mean of 30, drawn in two parts; 6,000 with a mean of 3.3; none of the null source
    assert abs(n["rare"] - 60_000) < 5 * math.sqrt(60_000) and abs(n["mid"] - 20_000) < 5 * math.sqrt(20_000) and set(n) == {"rare", "mid"}
    counts = [r["count"] for r in out.where("source = 'mid'").groupBy("doc_id").count().collect()]
    assert abs(np.var(counts + [0] * (6000 - len(counts))) - 10 / 3) < 0.4


def test_mixing_repeats_itself_and_keeps_columns(table):
    rows = documents()
    df = table(rows, DOCS).withColumn("mix_key", F.lit("old"))
    a, b = ([tuple(r) for r in mixing.mix_sources(df.repartition(n), size=100).collect()] for n in (1, 4))
    assert sorted(a, key=str) == sorted(b, key=str)
    out = mixing.mix_sources(df, size=100)
    assert out.columns == [*df.drop("mix_key").columns, "mix_copy", "mix_key"]
    keys = [[r.mix_key for r in part] for part in out.rdd.glom().collect()]
    assert all(k == sorted(k) for k in keys) and {r.source for r in out.collect()} == {r[3] for r in rows}
    assert mixing.mix_sources(table([], DOCS)).count() == 0


# ---- quality -------------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 5, 2])
    unary, pair = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    marginal, pairs = quality.forward_backward(unary, pair, lines)
    at = 0
    for k, n in enumerate(lines):
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += p
            one += p * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += p
        assert np.allclose(marginal[at : at + n], one / total) and np.allclose(pairs[k], two / total)
        at += n


def test_line_features():
    texts = [b"", b"Plain words here.\nAGAIN AGAIN AGAIN!!", b"a | b | c |\n\n### $$$", b"x" * 5000]
    x, size, lines = quality.line_features(texts)
    assert lines.tolist() == [1, 2, 3, 1] and len(x) == 7 and np.isfinite(x).all() and x.shape[1] == quality.FEATURES
    assert size.tolist() == [1, 18, 20, 12, 1, 8, 5001]
    one = np.concatenate([quality.line_features([t])[0] for t in texts])
    assert np.allclose(one, x)


def test_scores_do_not_depend_on_company(table):
    field = quality.LineField(np.random.default_rng(1).normal(size=quality.FEATURES), np.array([[1.0, -1], [-1, 1]]))
    rows = documents()
    got = sorted((str(r.doc_id), r.score, r.predicted, r.held_out) for r in quality.score_quality(table(rows, DOCS), field).collect())
    want = []
    for r in rows:
        s = field.scores([r[1]])[0]
        want.append((str(r[0]), s, int(s >= 0.3), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert all(g[1] == pytest.approx(w[1]) and g[2:] == w[2:] for g, w in zip(got, sorted(want)))
    kept = quality.keep_good(table(rows, DOCS), field)
    assert kept.columns[:4] == ["doc_id", "text", "lang", "source"] and kept.count() == sum(w[2] for w in want)


def test_training_without_labels(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.train_quality(table(documents(), DOCS), none)
    assert field.scores(["any", None]).tolist() == [0.5, 0.5]
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (99, 1)], "doc_id long, quality int")
    assert np.isfinite(quality.train_quality(table(documents(), DOCS), odd).weights).all()
    assert quality.score_quality(table([], DOCS), field).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs, quality.train_quality(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark):
    from test_simhash import expected
    from test_text_scans import contaminated

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    stages = dict(corpus_pipeline.STAGES)
    field = quality.train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r[0] for r in rows if field.scores([r[1]])[0] >= 0.3}
    df = stages["quality"](spark, docs, SF)
    assert df.columns == docs.columns and {r.doc_id for r in df.collect()} == kept
    rows = [r for r in rows if r[0] in kept]
    df = stages["near_duplicates"](spark, df, SF).cache()
    assert df.columns == docs.columns and sorted(r.doc_id for r in df.collect()) == sorted({e[2] for e in expected(rows)})
    left = {r.doc_id for r in df.collect()}
    rows = [r for r in rows if r[0] in left]
    df = stages["decontamination"](spark, df, SF)
    bad = {c[0] for c in contaminated(rows, items) if c[-1]}
    assert bad and df.columns == docs.columns and {r.doc_id for r in df.collect()} == left - bad
    mixed = stages["mixing"](spark, df, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= left - bad
    files = stages["token_files"](spark, mixed, SF)
    assert files.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and files.count() == mixed.count()
    assert corpus_pipeline.run(spark, SF).count() == files.count()


def test_stages_of_awkward_and_empty_tables(spark, table):
    for rows in (documents(), []):
        df = table(rows, DOCS, extra=False).withColumn("n_chars", F.length("text"))
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            assert df.count() <= max(4 * len(rows), 0), name
