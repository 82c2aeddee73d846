"""Text columns to tokens, bags of words and vectors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.clean import NO_TEXT
from panelspark.operators.joins import lookup_join
from panelspark.session import materialize

TOKEN = r"[\p{L}\p{N}]+"
ID_RANGE = 32_000
TOPIC_FLOOR = 0.01


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits over the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokenize_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """``{c}_tokens`` per column; text with no token gives the tokens of the no-text marker."""
    out = {}
    for c in cols:
        t = tokens_of(F.coalesce(F.col(c), F.lit(NO_TEXT)))
        out[f"{c}_tokens"] = F.when(F.size(t) > 0, t).otherwise(tokens_of(F.lit(NO_TEXT)))
    return df.withColumns(out)


def token_id(token: Column, id_range: int = ID_RANGE) -> Column:
    """Adler-32 of the UTF-8 bytes modulo the id range; each batch hashes its distinct tokens once."""

    def run(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        ids = np.array([zlib.adler32(w.encode()) % id_range for w in distinct] or [0], dtype="int32")
        return pd.Series(ids[codes])

    return F.pandas_udf(run, "int")(token)


def _ids(words: pa.Array, id_range: int) -> np.ndarray:
    """Hashed ids of many words; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    ids = np.array([zlib.adler32(w.encode()) % id_range for w in coded.dictionary.to_pylist()] or [0], dtype=np.int64)
    return ids[coded.indices.to_numpy(zero_copy_only=False)]


def hashed_bow(df: DataFrame, doc: str, tokens: str, id_range: int = ID_RANGE) -> DataFrame:
    """(doc, token_id, cnt) in long form, one row per id of a document. Rows are counted where they are: nothing is shuffled.

    A row without tokens gives nothing; a null token is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words, owner = lists.flatten(), np.repeat(np.arange(b.num_rows), size)
            if words.null_count:
                known = words.is_valid()
                words, owner = words.filter(known), owner[known.to_numpy(zero_copy_only=False)]
            found, counts = np.unique(owner * id_range + _ids(words, id_range), return_counts=True)
            yield pa.record_batch([b.column(0).take(pa.array(found // id_range)), pa.array(found % id_range, pa.int32()), pa.array(counts, pa.int64())], names)

    names = [doc, "token_id", "cnt"]
    kind = df.schema[doc].dataType.simpleString()
    return df.select(doc, tokens).mapInArrow(run, f"`{doc}` {kind}, token_id int, cnt bigint")


def id_words(tokens: Column, id_range: int = ID_RANGE) -> Column:
    """The hashed id of every token as a word, in the order of the tokens."""

    def run(lists: pa.Array) -> pa.Array:
        ids = _ids(lists.flatten(), id_range)
        size = pc.fill_null(pc.list_value_length(lists), 0)
        ends = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids).cast(pa.string()))

    return F.arrow_udf(run, "array<string>")(tokens)


def bag_vectors(df: DataFrame, tokens: str, out: str = "_bow", id_range: int = ID_RANGE) -> DataFrame:
    """Add the hashed bag as a sparse vector over the whole id range; every token counts, and the counting stays in the JVM."""
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(id_range)], inputCol="_ids", outputCol=out, minTF=1.0)
    present = F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda w: w.isNotNull())
    return counter.transform(df.withColumn("_ids", id_words(present, id_range))).drop("_ids")


def lda_fit(df: DataFrame, tokens: str, vec_size: int = 4, path: str | None = None, seed: int = 42, max_iter: int = 10):
    """The topic model over hashed bags; each of the ``max_iter`` passes sees every document.

    A model that was saved under ``path`` is loaded and used again; a new one is saved there.
    """
    if path and (model := lda_load(df.sparkSession, path)) is not None:
        return model
    # written once: every pass would take the texts apart again
    rows = materialize(bag_vectors(df.select(tokens), tokens).select("_bow"), "bags")
    model = LDA(k=vec_size, seed=seed, maxIter=max_iter, featuresCol="_bow", subsamplingRate=1.0).fit(rows)
    if path:
        model.write().overwrite().save(f"{path}/topics")
    return model


def lda_load(spark: SparkSession, path: str) -> LocalLDAModel | None:
    """The model saved under ``path``, or None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/topics/metadata/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return LocalLDAModel.load(f"{path}/topics")


def topic_ids(model, n: int = 10) -> DataFrame:
    """(topic, place, token_id, weight): the n heaviest ids of each topic."""
    top = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "z"))
    return top.select("topic", "place", F.col("z.termIndices").alias("token_id"), F.col("z.termWeights").alias("weight"))


def spread_missing(topics: Column, floor: float = TOPIC_FLOOR) -> Column:
    """Topics below the floor share the mass the others leave, equally."""
    kept = F.transform(topics, lambda p: F.when(p >= floor, p).otherwise(F.lit(0.0)))
    held = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p)
    gone = F.size(F.filter(kept, lambda p: p == 0))
    return F.transform(kept, lambda p: F.when(p == 0, (1 - held) / gone).otherwise(p))


def lda_vectors(df: DataFrame, tokens: str, model: LocalLDAModel, out: str) -> DataFrame:
    scored = model.transform(bag_vectors(df, tokens))
    return scored.withColumn(out, spread_missing(vector_to_array("topicDistribution"))).select(*df.columns, out)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of every token, its row) of lists of tokens; null tokens are left out."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), size)
    if words.null_count:
        known = words.is_valid()
        words, owner = words.filter(known), owner[known.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner


def _context_sums(vec_size: int, window: int, seed: int):
    """Per batch of token lists one row per distinct word: the sum of the directions around its places, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, codes, owner = _flat(b.column(0))
            if not len(words):
                continue
            hexes = ["".join(hashlib.md5(f"{w}~{seed}~{i}".encode()).hexdigest() for i in range(-(-vec_size // 32))) for w in words.to_pylist()]
            signs = np.array([[1.0 if h >= "8" else -1.0 for h in x[:vec_size]] for x in hexes])
            at, first, last = np.arange(len(codes)), np.searchsorted(owner, owner), np.searchsorted(owner, owner, side="right")
            lo, hi = np.maximum(at - window, first), np.minimum(at + window + 1, last)
            sums = [np.concatenate([[0.0], np.cumsum(col[codes])]) for col in signs.T]
            near = [np.bincount(codes, c[hi] - c[lo] - col[codes], len(words)) for c, col in zip(sums, signs.T)]
            places = np.bincount(codes, hi - lo - 1, len(words)).astype(np.int64)
            yield pa.record_batch([words, *[pa.array(n) for n in near], pa.array(places)], ["_w", *[f"_c{j}" for j in range(vec_size)], "_m"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_doc, _w, _n) of batches (_doc, tokens)."""
    for b in batches:
        words, codes, owner = _flat(b.column(1))
        if not len(words):
            continue
        found, counts = np.unique(owner * len(words) + codes, return_counts=True)
        cols = [b.column(0).take(pa.array(found // len(words))), words.take(pa.array(found % len(words))), pa.array(counts, pa.int64())]
        yield pa.record_batch(cols, ["_doc", "_w", "_n"])


def doc_embedding(df: DataFrame, tokens: str, out: str, vec_size: int = 4, window: int = 3, seed: int = 42, min_count: int = 1) -> DataFrame:
    """Mean of word vectors per document, without a vocabulary in the driver or in any task.

    Every word has a hashed direction of ``vec_size`` signs. The vector of a word is the mean direction of the words
    within ``window`` places of it, over all its places, summed where the rows are; no single token is shuffled. Words of
    fewer than ``min_count`` places are left out before that; a document without words has a vector of zeros.
    """
    rows = materialize(df.withColumn("_doc", F.monotonically_increasing_id()), "docs")
    lists = rows.select("_doc", F.col(tokens).alias("_t"))
    if min_count > 1:
        words = rows.select("_doc", F.posexplode(tokens).alias("_at", "_w")).where("_w is not null")
        often = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select("_w")
        words = lookup_join(words, materialize(often, "often"), "_w", "inner")
        kept = F.array_sort(F.collect_list(F.struct("_at", "_w")))
        lists = materialize(words.groupBy("_doc").agg(F.transform(kept, lambda x: x["_w"]).alias("_t")), "lists")
    sums = ", ".join(f"_c{j} double" for j in range(vec_size))
    context = lists.select("_t").mapInArrow(_context_sums(vec_size, window, seed), f"_w string, {sums}, _m bigint")
    mean = [F.coalesce(F.try_divide(F.sum(f"_c{j}"), F.sum("_m")), F.lit(0.0)).alias(f"_e{j}") for j in range(vec_size)]
    vectors = materialize(context.groupBy("_w").agg(*mean), "words")
    counted = materialize(lists.mapInArrow(_word_counts, "_doc bigint, _w string, _n bigint"), "counts")
    # a word of very many documents is a hot key, which the join salts
    met = lookup_join(counted, vectors, "_w", "inner")
    total = F.sum("_n")
    found = met.groupBy("_doc").agg(F.array(*[F.sum(F.col("_n") * F.col(f"_e{j}")) / total for j in range(vec_size)]).alias(out))
    zeros = F.array(*[F.lit(0.0)] * vec_size)
    return rows.join(found, "_doc", "left").withColumn(out, F.coalesce(out, zeros)).select(*df.columns, out)


def spread_vectors(df: DataFrame, vec: str, prefix: str, size: int) -> DataFrame:
    """array -> ``{prefix}_0 .. {prefix}_{size-1}``."""
    return df.withColumns({f"{prefix}_{i}": F.col(vec).getItem(i).cast("double") for i in range(size)}).drop(vec)


def text_features(
    df: DataFrame, cols: list[str], method: str = "lda", vec_size: int = 4, path: str | None = None, row_id: str = "row_id"
) -> DataFrame:
    """Replace the text columns by ``vec_size`` numeric columns each; one model serves all columns."""
    toks = tokenize_columns(df, cols)
    long = toks.select(
        row_id, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_tokens").alias("tokens")) for c in cols])).alias("_d")
    ).select(row_id, "_d.c", "_d.tokens")
    if method == "lda":
        vecs = lda_vectors(long, "tokens", lda_fit(long, "tokens", vec_size, path), "vec")
    elif method == "doc2vec":
        vecs = doc_embedding(long, "tokens", "vec", vec_size)
    else:
        raise ValueError(f"unknown method {method!r}")
    picks = [
        F.max(F.when(F.col("c") == c, F.col("vec")[i])).alias(f"{c}_{i}") for c in cols for i in range(vec_size)
    ]
    if len(cols) == 1:
        wide = vecs.select(row_id, *[F.col("vec")[i].alias(f"{cols[0]}_{i}") for i in range(vec_size)])
    else:
        wide = vecs.groupBy(row_id).agg(*picks)
    return df.drop(*cols).join(wide, row_id)
