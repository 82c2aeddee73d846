"""From raw documents to a token file: filter, deduplicate, decontaminate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, mixing, quality, simhash, token_file
from panelspark.llm.common import fresh_names
from panelspark.session import materialize, scratch_dir

#: some stages have no SQL form (learned scores, XXH64 components, tokenizer); tests check them by brute force
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; it learns from the labelled ones among ``docs``.

    A null or empty text is scored as an empty line; repeated rows share their fate. Columns stay as they are.
    """
    return quality.keep_good(docs, quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest doc_id.

    Texts without a word are one group; a missing doc_id comes last; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; a null or empty text holds none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards equal weights of their sources, in random order; columns of any name stay as they are."""
    copy, order = fresh_names(docs, "mix_copy", "mix_key")
    return mixing.mix_sources(docs, copy=copy, order=order).drop(copy, order)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and return what its documents read back as; a null or empty text is its end id alone."""
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(docs, path)
    return token_file.read_digests(spark, path)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder and the next one reads it.

    An empty table goes through all stages and gives no row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
