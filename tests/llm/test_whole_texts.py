"""Rows of one doc_id are cut into several parts."""

import hashlib

import pytest
from cases import DOCS, prose
from pyspark.sql import functions as F

from panelspark.llm import common, minhash, token_file


@pytest.fixture()
def crowded(monkeypatch, table):
    """A third of the rows without an id, a third with one id, some of them without a text or with the same one."""
    monkeypatch.setattr(common, "PART_ROWS", 16)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, None if i % 50 == 0 else prose(i // 2 if i % 20 == 1 else i, 6 + i % 9), "en", "s") for i in range(360)]
    return rows, table(rows, DOCS)


def test_rows_of_one_id_are_cut_into_parts_in_order(crowded):
    rows, df = crowded
    parts = common.ordered_parts(df)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got = [(r.doc_id, r.text) for r in parts.orderBy("_part", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()).collect()]
    assert got == [(r[0], r[1]) for r in order]
    assert parts.groupBy("_part").count().agg(F.max("count")).first()[0] < 60


def test_next_texts_go_on_through_the_parts_of_one_id(crowded):
    rows, df = crowded
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = sorted(
        (str(a[0]), hashlib.sha256(minhash.edited_text(a[1] or "", b[1] or "").encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1])
    )
    assert sorted((str(r.doc_id), r.edited_sha256) for r in minhash.edited_fingerprints(df).collect()) == want


def test_token_file_keeps_the_order_of_texts_of_one_id(spark, crowded, tmp_path):
    rows, df = crowded
    token_file.write_tokens(df, str(tmp_path / "t"))
    got = token_file.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    encoded = token_file.encoder(token_file.default_tokenizer()).encode([r[1] for r in order])
    assert [len(r.tokens) for r in got] == [len(x) // token_file.ID + 1 for x in encoded]


def test_first_text_of_a_part_is_found_without_gathering(crowded):
    plan = minhash._guests(common.ordered_parts(crowded[1]))._jdf.queryExecution().toString()
    assert "collect_set" not in plan
