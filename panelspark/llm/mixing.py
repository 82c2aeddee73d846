"""Poisson replication of documents towards target weights of their sources; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_broadcast, fresh_names, shuffle_parts
from panelspark.session import materialize

SEED = 42
#: a mean above this is drawn as a sum of equal parts below it
PART_MEAN = 16.0
#: terms of the distribution function; at mean 16 the tail beyond is below 1e-25, less than one step of the draw
TERMS = 80
#: copies of one document that one task makes from one row
COPIES_AT_ONCE = 10_000


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws("~", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: int | None = None) -> DataFrame:
    """(source, n_docs, rate, parts, cdf): mean repetitions that bring every source to its share of ``size`` rows.

    A source that ``weights`` does not name has ``default_weight``; a null source is a source of its own. ``size``
    defaults to the number of documents. ``cdf`` is the distribution function of a Poisson variable with mean
    rate / parts.
    """
    named = F.lit(float(default_weight))
    for source, w in (weights or {}).items():
        named = F.when(F.col("source") == source, F.lit(float(w))).otherwise(named)
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("weight", named)
    sums = counts.agg(F.sum("n_docs").alias("_all"), F.sum("weight").alias("_weights"))
    rates = counts.crossJoin(F.broadcast(sums))  # one row
    wanted = F.lit(float(size)) if size is not None else F.col("_all").cast("double")
    rates = rates.withColumn("rate", wanted * F.col("weight") / (F.col("_weights") * F.col("n_docs")))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-mean)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c"),
        ),
        lambda a: a["c"],
    )
    return rates.select("source", "n_docs", "rate", "parts", grown.alias("cdf"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: int | None = None, seed: int = SEED,
    copy: str = "mix_copy", order: str = "mix_key", copies_at_once: int = COPIES_AT_ONCE,
) -> DataFrame:
    """Repeat or leave out every document by a Poisson draw with its source's mean rate, then shuffle all rows.

    The draw inverts the distribution at a number hashed from the seed, doc_id, source and text, so runs and retried
    tasks agree, and rows without doc_id draw each on their own; only rows equal in all three draw alike. Adds ``copy``
    (0, 1, ...) and the hash ``order``; older columns of these names are replaced. All other columns, null or not, stay.
    Rows land in the partition and place that the hash says. No row of an empty table; none of a source whose weight is 0.

    A document of a rare source may be repeated very often. Where more than ``copies_at_once`` copies are possible, they
    are made in two steps with a shuffle in between, so one task makes at most that many of one document.
    """
    docs = docs.drop(copy, order)
    name, parts, cdf, count, many, table = fresh_names(docs, "_mix_source", "_mix_parts", "_mix_cdf", "_mix_count", "_mix_many", "_mix_text")
    rates = materialize(repetition_rates(docs, weights, default_weight, size), "rates")
    often = not rates.where(F.col("parts") * TERMS > copies_at_once).isEmpty()
    rates = rates.select(F.col("source").alias(name), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in docs.columns else F.lit("")
    # hashed in front of the join, so that no draw repeats it
    rows = docs.withColumn(table, text).join(bounded_broadcast(rates), F.col("source").cast("string").eqNullSafe(F.col(name)))
    key = [F.lit(seed), F.col("doc_id"), F.col("source"), F.col(table)]

    def draws(j: Column) -> Column:
        u = unit_draw(*key, j)
        return F.size(F.filter(cdf, lambda c: u >= c))

    drawn = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda a, j: a + draws(j))
    rows = rows.withColumn(count, drawn).where(F.col(count) > 0)
    if not often:
        rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    else:
        rare = F.col(parts) * TERMS > copies_at_once
        pieces = F.sequence(F.lit(0), F.floor((F.col(count) - 1) / copies_at_once).cast("int"))
        spread = rows.where(rare).withColumn(many, F.explode(pieces)).repartition(shuffle_parts(docs), F.col(table), F.col(many), F.col("doc_id"))
        rows = rows.where(~rare).withColumn(many, F.lit(0)).unionByName(spread)
        upto = F.least(F.lit(copies_at_once), F.col(count) - F.col(many) * copies_at_once) - 1
        rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), upto))).withColumn(copy, F.col(many) * copies_at_once + F.col(copy))
    place = F.md5(F.concat_ws("~", *[F.coalesce(p.cast("string"), F.lit("")) for p in (*key, F.lit("order"), F.col(copy))]))
    rows = rows.withColumn(order, place).drop(name, parts, cdf, count, many, table)
    return rows.repartition(shuffle_parts(docs), order).sortWithinPartitions(order)


#: the same mixture with equal weights, for DuckDB
SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_docs, 1.0::DOUBLE AS weight FROM documents GROUP BY source),
sums AS (SELECT sum(n_docs)::DOUBLE AS a, sum(weight) AS w FROM counts),
rated AS (SELECT source, a * weight / (w * n_docs) AS rate FROM counts, sums),
rates AS (SELECT source, greatest(ceil(rate / {PART_MEAN}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART_MEAN}), 1)::INT AS mean FROM rated),
cdf AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {TERMS - 1}
),
keyed AS (
    SELECT DISTINCT doc_id, source, md5(coalesce(text, '')) AS th,
        concat_ws('~', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), md5(coalesce(text, ''))) AS key FROM documents
),
drawn AS (
    SELECT key, d.source, concat('0x', substr(md5(concat_ws('~', key, j::VARCHAR)), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS u, j
    FROM keyed d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(r.parts) t(j)
),
counted AS (
    SELECT key, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM drawn.source AND drawn.u >= c.c)) AS n
    FROM drawn GROUP BY key
)
SELECT d.*, i::INT AS mix_copy, md5(concat_ws('~', k.key, 'order', i::VARCHAR)) AS mix_key
FROM documents d JOIN keyed k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source AND md5(coalesce(d.text, '')) = k.th
JOIN counted n USING (key), range(n.n::BIGINT) t(i)
"""
