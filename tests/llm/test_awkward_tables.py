"""Clashing names, repeated rows, rare sources, missing ids and letters of every plane."""

from collections import Counter

import corpus_pipeline
import pytest
from cases import DOCS, documents
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, language, mixing, quality, simhash

SF = "/root/testdata/sf0.001"
CLASH = ("_n", "_keep_id", "_keep_hash", "_bad_id", "_bad_hash", "_twice_id", "mix_copy", "mix_key", "_mix_count", "_mix_source", "i", "h", "row", "fp", "root")


def test_stages_keep_columns_of_any_name(spark, table):
    df = table(documents() * 2, DOCS).withColumns({c: F.lit(c) for c in CLASH}).withColumn("n_chars", F.length("text"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert all(r[c] == c for r in out.collect() for c in CLASH), name
        df = out


def test_the_survivor_does_not_depend_on_the_order(spark):
    rows = [(1, "a b c d e f", "en", s) for s in "zyxw"] + [(2, "quite another text with words", "en", "q")]
    kept = [
        sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(some, DOCS).repartition(n)).collect())
        for some in (rows, rows[::-1]) for n in (1, 3)
    ]
    assert kept[0] == [(1, "a b c d e f", "en", "w"), (2, "quite another text with words", "en", "q")] and all(k == kept[0] for k in kept)


def test_training_rows_do_not_depend_on_the_order(spark):
    rows = [(i, f"{'Good prose goes here. ' * 5}{j}" if j else "|||| ### $$", "en", "s") for i in range(1, 40) for j in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    fields = [quality.train_quality(spark.createDataFrame(r, DOCS).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 4))]
    assert fields[0].scores(["some text", "###"]) == pytest.approx(fields[1].scores(["some text", "###"]), abs=1e-9)


def test_one_document_of_a_rare_source_is_made_in_pieces(spark):
    rows = [(i, f"text {i}", "en", "big") for i in range(2000)] + [(9999, "rare text", "en", "rare")]
    df = spark.createDataFrame(rows, DOCS)
    whole = mixing.mix_sources(df)
    pieces = mixing.mix_sources(df, copies_at_once=100)
    n = Counter(r.source for r in pieces.collect())
    assert abs(n["rare"] - 1000.5) < 5 * 1000**0.5
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces.collect()))
    assert sorted(r.mix_copy for r in pieces.where("source = 'rare'").collect()) == list(range(n["rare"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_without_id_draw_on_their_own(spark, seed):
    rows = [(None, f"text {i}", "en", "a") for i in range(400)] + [(i, f"other {i}", "en", "b") for i in range(400)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), seed=seed)
    n = Counter(r.source for r in out.collect())
    assert abs(n["a"] - 400) < 5 * 20 and out.select("mix_key").distinct().count() == out.count()


def test_letters_of_every_plane():
    parser = language.CrossParser(("zh", "xx"), ("\U00030000\U00030001\U00030002" * 30, "abc def " * 30))
    lang, score = parser.predict(["\U00030000\U00030001", "123 !?", "abc def"])
    assert lang[0] == "zh" and lang[1] == language.UNKNOWN and lang[2] == "xx" and score[0] > 0


@pytest.mark.parametrize("pair_rows", [10, 60])
def test_links_at_forced_depths(spark, pair_rows):
    """Node pairs that are cut a bit at a time link the same components, and no fingerprint is copied more often than nodes lie near."""
    import random

    from panelspark.llm.components import components

    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(150)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:60]}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    sets = []
    for rows in (pair_rows, 1 << 20):
        found = components(simhash.links(df, 4, rows, 2)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.root, set()).add(r.node)
        sets.append(sorted(map(sorted, groups.values())))
    assert sets[0] == sets[1] and sets[0]


def test_clean_documents_with_clashing_ids(spark, table):
    items = spark.createDataFrame([(1, documents()[0][1])], "item_id long, text string")
    df = table(documents(), DOCS).withColumns({c: F.lit(c) for c in CLASH})
    kept = decontaminate.keep_clean(df, items)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
