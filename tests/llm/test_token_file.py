"""Token files against whole-text encoding, and the length histogram against a plain count."""

import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents
from panelspark.llm import token_counts, token_file
from panelspark.llm.encoder import Encoder
from panelspark.session import scratch_dir

TEXTS = [
    "a  b", " a", "a ", "a\n b", "x\t y z", "it's don't  'll 've", "a b\n", "\n a b", "<|endoftext|> a", "a\x1c b", "", " ", "\n",
    "a\n\nb", "a\r\nb c", "a<|endoftext|>b", "x <|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endof text|>", "a. b.c, d!! e?\nf'll.", "a　b c", "é ü, ñ.",
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_file.default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [3, 1000])
def test_cut_texts_encode_like_whole_ones(whole, limit):
    e = Encoder(token_file.default_tokenizer(), cache_words=limit)
    for _ in range(2):
        assert e.encode([*TEXTS, None]) == [array("I", whole(t)).tobytes() for t in [*TEXTS, None]]


def test_file_round_trip(spark, table, whole):
    rows = documents()
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(table(rows, DOCS), path)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for r in order:
        ids = [*whole(r[1]), 0]
        want.append((r[0], start, ids))
        start += len(ids)
    got = sorted((r.start, r.doc_id, list(r.tokens)) for r in token_file.read_tokens(spark, path).collect())
    assert [(i, s, t) for s, i, t in got] == want
    digests = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.read_digests(spark, path).collect())
    assert digests == [(s, i, len(t), zlib.crc32(array("I", t).tobytes())) for i, s, t in want]
    few = token_file.read_tokens(spark, path, [10, 13]).collect()
    assert sorted((r.doc_id, list(r.tokens)) for r in few) == sorted((i, t) for i, _, t in want if i in (10, 13))


def test_other_dictionary_is_refused(spark, table):
    a, b = scratch_dir(spark, "tokens"), scratch_dir(spark, "tokens")
    token_file.write_tokens(table([(1, "one two", "en", "s")], DOCS), a)
    blocks = spark.read.parquet(f"{a}/blocks").withColumn("dict_id", F.lit("another"))
    blocks.write.parquet(f"{b}/blocks")
    for name in ("dictionary", "parts"):
        spark.read.parquet(f"{a}/{name}").write.parquet(f"{b}/{name}")
    with pytest.raises(Exception, match="needs dictionary"):
        token_file.read_digests(spark, b).collect()


def test_wide_ids_and_empty_table(spark, table):
    wide = array("I", [70_000, 1]).tobytes()
    assert token_file.deserialize(token_file.serialize(wide, 0)).tolist() == [70_000, 1, 0]
    assert token_file.deserialize(token_file.serialize(b"", 0)).tolist() == [0]
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(table([], DOCS), path)
    assert token_file.read_digests(spark, path).count() == 0


def test_length_histogram(table, whole):
    rows = documents()
    lengths = [len(whole(r[1])) for r in rows]
    t = token_counts.context_table(token_counts.length_histogram(table(rows, DOCS)))
    for r in t.collect():
        limit = r.n_tokens
        assert r.n_docs == lengths.count(limit) and r.docs_total == len(rows) and r.tokens_total == sum(lengths)
        assert r.docs_longer == sum(x > limit for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths)
        assert r.cdf == pytest.approx(sum(x <= limit for x in lengths) / len(rows))
    assert token_counts.total_within(t, 7) == sum(min(x, 7) for x in lengths)
    assert token_counts.quantile(t, 0.5) == sorted(lengths)[(len(lengths) - 1) // 2]


def test_length_histogram_of_nothing(table):
    t = token_counts.context_table(token_counts.length_histogram(table([], DOCS)))
    assert t.count() == 0 and token_counts.quantile(t, 0.5) is None and token_counts.total_within(t, 5) == 0


def test_length_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "LENGTHS_PER_BUCKET", 3)
    h = spark.createDataFrame([(i, i % 4 + 1) for i in range(0, 40, 2)], "n_tokens long, n_docs long")
    every = [i for i in range(0, 40, 2) for _ in range(i % 4 + 1)]
    for r in token_counts.context_table(h).collect():
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in every)


def test_words_that_never_come_back_push_none_out(whole):
    e = Encoder(token_file.default_tokenizer(), cache_words=400)
    often = [f"often{i}" for i in range(60)]
    e.encode([" ".join(often), " ".join(often)])
    for k in range(30):
        e.encode([" ".join(f"x{k}y{i}." for i in range(100))])
    made, learn = [], e.many_words
    e.many_words = lambda words, *a: made.extend(words) or learn(words, *a)
    text = " ".join([*often, "often1.", "a\tb", "new"])
    assert e.encode([text, text]) == [array("I", whole(text)).tobytes()] * 2
    assert not set(made) & set(often[1:])
    assert len(e.known) <= 400 and len(e.known.fresh) <= 400


def test_marks_behind_a_word_are_pieces_of_their_own(whole):
    e = Encoder(token_file.default_tokenizer())
    texts = [f"{w}{m} {w}{m}\n{w}{m}" for w in ("ab", "it's", "x9", "é", "a_b", "٣", "ab$c") for m in ("'", "''", "$$$", "%", "_", "__.", "'.", "(", "~`", "\\", "]^", "s'", "'s!")]
    assert e.encode(texts) == [array("I", whole(t)).tobytes() for t in texts]
