"""Mixing sources to target weights by Poisson replication.

Each document gets a number of copies from a hash-seeded Poisson distribution whose mean is the target repetition
rate of its source, by inverting the distribution function; copies are exploded and shuffled globally by a hash.
Only DataFrame and SQL operations. The sources' table is a row per source with about as many numbers as its rate, so a lookup
costs about what its copies do; it is broadcast only up to MAX_BROADCAST rows and MAX_NUMBERS numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name

SEED = "mix-1"
#: The sources' table is broadcast only up to this many rows; beyond, a shuffled join that AQE splits on skew.
MAX_BROADCAST = 2_000
MAX_NUMBERS = 1_000_000


def uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) from the MD5 of seed and parts: the first 52 bits, half a step off the ends."""
    head = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def distribution(rates: DataFrame) -> DataFrame:
    """rates (source, rate) -> source, rate, cdf: P(copies <= k) for k = 0, 1, ... until the rest is under 1e-16."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    by_k = Window.partitionBy("source").orderBy("k")
    log_step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    return (
        rates.filter("rate > 0")
        .withColumn("k", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("log_p", F.sum(log_step).over(by_k))
        .withColumn("c", F.sum(F.exp("log_p")).over(by_k))
        .groupBy("source", "rate")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    )


def target_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """(source, rate): weight x total / rows of the source. Without weights all sources weigh alike; total: rows of docs.

    weights (source, weight) need not sum to 1. A source without a weight gets rate 0, as does a weight <= 0.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    weighted = (
        sizes.withColumn("weight", F.lit(1.0))
        if weights is None
        else sizes.join(weights.select("source", "weight"), "source", "left").fillna(0.0, ["weight"])
    ).withColumn("weight", F.greatest("weight", F.lit(0.0)))
    weight_sum, n_rows = weighted.agg(F.sum("weight"), F.sum("n_rows")).first()
    wanted = float(total if total is not None else n_rows or 0)
    rate = F.when(F.lit(weight_sum or 0.0) > 0, F.col("weight") / F.lit(weight_sum or 1.0) * F.lit(wanted) / F.col("n_rows"))
    return weighted.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs with columns `copy` (from 1) and `shuffle_key`, each row as often as its Poisson draw says, none at 0.

    Where docs has columns of these names, they stay, and the new ones get an underscore more. A null source is the source ''. Rows that
    repeat a doc_id get the same number of copies each. Null doc_id: hashed as the empty text. An empty table gives an empty result. Sources
    not in rates are dropped (their rate is 0).
    """
    copy, order = (free_name(x, docs.columns) for x in ("copy", "shuffle_key"))
    own, cdf, u, n = (free_name(x, docs.columns) for x in ("__source", "__cdf", "__u", "__n"))
    table = distribution(rates).select(F.col("source").alias(own), F.col("cdf").alias(cdf))
    rows, numbers = rates.agg(F.count(F.lit(1)), F.sum(F.col("rate") + 12 * F.sqrt("rate") + 30)).first()
    few = rows <= MAX_BROADCAST and (numbers or 0) <= MAX_NUMBERS
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = (
        docs.withColumn(u, uniform(F.lit("n"), key))
        .join(F.broadcast(table) if few else table, F.coalesce("source", F.lit("")) == F.col(own))
        .withColumn(n, F.size(F.filter(cdf, lambda c: c < F.col(u))))
    )
    copies = drawn.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    return copies.withColumn(
        order, F.md5(F.concat_ws(":", F.lit(SEED), F.lit("s"), key, F.col(copy).cast("string")).cast("binary"))
    ).drop(own, cdf, u, n)


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Replicated docs in a global random order: rows are range-partitioned and sorted by the key of the shuffle, their last column."""
    copies = replicate(docs, target_rates(docs, weights, total))
    return copies.orderBy(copies.columns[-1])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH sizes AS (SELECT coalesce(source, '') AS source, count(*) AS n_rows FROM documents GROUP BY 1),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes)
                 * (SELECT sum(n_rows) FROM sizes)::DOUBLE / n_rows AS rate FROM sizes),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT + 1)) AS k FROM rates),
lp AS (SELECT source, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k::DOUBLE) END)
              OVER (PARTITION BY source ORDER BY k) AS log_p FROM ks),
cdf AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS c FROM lp),
d AS (SELECT doc_id, source,
             (('0x' || substr(md5('mix-1:n:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
             / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.source, count(*) AS n FROM d JOIN cdf ON coalesce(d.source, '') = cdf.source AND cdf.c < d.u
      GROUP BY ALL)
SELECT doc_id, text, lang, d.source, n_chars, copy::INT AS copy,
       md5('mix-1:s:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM n) JOIN documents d USING (doc_id)
"""
