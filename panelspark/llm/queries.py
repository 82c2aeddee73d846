"""The queries of the training-data operators, each over whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import conversations, decontaminate, language, licenses, minhash, mixing, quality, simhash, spelling, suffix_dedup, token_counts, token_file, warc
from panelspark.llm.common import documents
from panelspark.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op6_poisson_mixing": mixing.SQL, "op11_conversation_repair": conversations.SQL, "op12_spelling_variants": spelling.SQL, "op13_warc": warc.SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_file.write_tokens(documents(spark, sf_dir), path)
    return token_file.read_digests(spark, path)


@query
def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict_language(docs, language.train_language(docs))


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(documents(spark, sf_dir))


@query
def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), items).drop("text_hash")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


@query
def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(documents(spark, sf_dir))


@query
def op8_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, field)


@query
def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_histogram(documents(spark, sf_dir)))


@query
def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_table(documents(spark, sf_dir))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_dir(spark, "warc"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
