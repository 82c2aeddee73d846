"""Passages of items without an id count as hits."""

import hashlib

from cases import DOCS, prose

from panelspark.llm import decontaminate


def test_items_without_an_id_hit_too(spark, table):
    text = prose(40, 30)
    rows = [(1, "so " + text + " it ends", "en", "s"), (2, prose(41, 30), "en", "s"), (3, text + " " + prose(42, 20), "en", "s")]
    items = spark.createDataFrame([(None, text), (7, prose(42, 20))], "item_id long, text string")
    df = table(rows, DOCS)
    got = {r.doc_id: r for r in decontaminate.contamination(df, items).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(30, 0, True), (0, 0, False), (50, 1, True)]
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert [r.doc_id for r in decontaminate.keep_clean(df, items).collect()] == [2]
