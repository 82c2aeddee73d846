"""Exact token counts for every context limit from one histogram of encoded lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import small_batches
from panelspark.llm.encoder import ID, encoder
from panelspark.llm.token_file import SLICE, default_tokenizer
from panelspark.session import materialize

LENGTHS_PER_BUCKET = 256


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length.

    Whole texts are encoded; a null or empty text has length 0. Every task counts its own documents first, so a
    length shared by a third of all documents costs one row per task. Repeated rows count each time.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                seen.update(len(x) // ID for x in encoder(tokenizer).encode(b.column(0).slice(lo, SLICE).to_pylist()))
        yield pa.record_batch({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    counted = small_batches(docs.select(F.col("text").cast("string"))).mapInArrow(run, "n_tokens long, n_docs long")
    # written, as its readers go over it more than once and encoding is the dear part
    return materialize(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def context_table(histogram: DataFrame) -> DataFrame:
    """One row per length that occurs, read as a context limit.

    n_tokens, n_docs, docs_longer, docs_total, tokens_total, tokens_longer (tokens of longer documents),
    truncated_tokens (tokens left when every document is cut to this limit) and cdf (share of documents of at most
    this length; the q-quantile is the first length whose cdf reaches q). Sums from the long end give all of them.
    An empty histogram gives no row. Lengths go into blocks of ``LENGTHS_PER_BUCKET``; block totals give offsets,
    so a window never holds all lengths.
    """
    h = histogram.withColumns(
        {"_b": F.expr(f"n_tokens div {LENGTHS_PER_BUCKET}"), "_t": F.col("n_tokens") * F.col("n_docs")}
    )
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    # one row per LENGTHS_PER_BUCKET lengths: bounded by the longest document
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_b", F.coalesce(F.sum("_bd").over(above), F.lit(0)).alias("_od"), F.coalesce(F.sum("_bt").over(above), F.lit(0)).alias("_ot"),
        F.sum("_bd").over(every).alias("docs_total"), F.sum("_bt").over(every).alias("tokens_total"),
    )
    later = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = h.join(F.broadcast(blocks), "_b").withColumns(
        {
            "docs_longer": F.col("_od") + F.coalesce(F.sum("n_docs").over(later), F.lit(0)),
            "tokens_longer": F.col("_ot") + F.coalesce(F.sum("_t").over(later), F.lit(0)),
        }
    )
    return rows.select(
        "n_tokens", "n_docs", "docs_longer", "docs_total", "tokens_total", "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("cdf"),
    )


def quantile(table: DataFrame, q: float) -> int | None:
    """Smallest length that at least a share ``q`` of the documents do not exceed; None without documents."""
    return table.where(F.col("cdf") >= q).agg(F.min("n_tokens")).first()[0]


def total_within(table: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to ``limit``, for any limit, listed or not."""
    below = F.col("n_tokens") <= limit
    row = table.agg(F.sum(F.when(below, F.col("n_tokens") * F.col("n_docs"))), F.sum(F.when(~below, F.col("n_docs")))).first()
    return (row[0] or 0) + limit * (row[1] or 0)
