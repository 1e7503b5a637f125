"""Cost and payment analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.money import cost_units, rounded


def with_costs(usage: DataFrame) -> DataFrame:
    return usage.withColumn("units", cost_units(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")))


def owner_of(usage: DataFrame, owners: DataFrame, key: str, name: str) -> DataFrame:
    """usage with `name`, the user_id of owners (key, user_id). Calls whose key is null have no owner; they are dealt out by a hash of the row, not all to one task."""
    dealt = usage.withColumn("__dealt", F.coalesce(key, F.xxhash64(*usage.columns)))
    held = owners.select(F.col(key).alias("__key"), F.col("user_id").alias(name))
    return dealt.join(held, (F.col(key) == F.col("__key")) & (F.col("__dealt") == F.col("__key")), "left").drop("__dealt", "__key")


def with_owner(usage: DataFrame, messages: DataFrame, papers: DataFrame) -> DataFrame:
    """Two left joins; the message's owner wins over the paper's."""
    both = owner_of(owner_of(usage, messages, "message_id", "m_user"), papers, "paper_id", "p_user")
    return both.withColumn("user_id", F.coalesce("m_user", "p_user")).drop("m_user", "p_user")


def cost_per_request_by_type(usage: DataFrame) -> DataFrame:
    """The mean is over calls, the number of requests over distinct messages or papers."""
    n = F.count(F.lit(1))
    return with_costs(usage).groupBy("type").agg(
        rounded(F.sum("units"), n, 100).alias("avg_cost_usd"), F.countDistinct(F.coalesce("message_id", "paper_id")).alias("total_requests"),
        rounded(F.sum("units"), F.lit(1), 10_000).alias("total_cost_usd"), F.sum("prompt_tokens").alias("prompt_tokens"),
    )


def cost_per_user_by_type(owned: DataFrame) -> DataFrame:
    """Per user and type: requests, total, and total over requests. Calls without an owner are left out after grouping."""
    g = owned.groupBy("user_id", "type").agg(F.countDistinct(F.coalesce("message_id", "paper_id")).alias("requests"), F.sum("units").alias("u"))
    return g.filter("user_id is not null").select("user_id", "type", "requests", rounded(F.col("u"), F.lit(1), 10_000).alias("total_cost_usd"), rounded(F.col("u"), F.col("requests"), 100).alias("avg_cost_usd"))


def overall_cost_by_type(owned: DataFrame) -> DataFrame:
    """Distinct users, mean per user, and ratio of sums, of calls with an owner."""
    g = owned.filter("user_id is not null").groupBy("user_id", "type").agg(F.countDistinct(F.coalesce("message_id", "paper_id")).alias("requests"), F.sum("units").alias("u"))
    return g.groupBy("type").agg(
        F.count(F.lit(1)).alias("users"), rounded(F.sum("u"), F.count(F.lit(1)), 100).alias("avg_per_user_usd"), rounded(F.sum("u"), F.sum("requests"), 100).alias("avg_per_request_usd")
    )


def cost_by_model(usage: DataFrame, usage_type: str | None = None) -> DataFrame:
    rows = usage if usage_type is None else usage.filter(F.col("type") == usage_type)
    return (
        with_costs(rows).groupBy("type", "provider", "model")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), rounded(F.sum("units"), F.lit(1), 10_000).alias("total_cost_usd"), rounded(F.sum("units"), F.count(F.lit(1)), 100).alias("avg_cost_usd"))
        .orderBy(F.desc("total_cost_usd"), "provider", "model", "type")
    )


def daily_cost(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return with_costs(usage.filter(F.col("created_at") >= since)).groupBy(F.to_date("created_at").alias("day"), "type").agg(F.count(F.lit(1)).alias("calls"), rounded(F.sum("units"), F.lit(1), 10_000).alias("cost_usd")).orderBy(F.desc("day"), "type")


def user_payment_stats(payments: DataFrame) -> DataFrame:
    settled = F.when(F.col("payment_status") == "settled", F.col("cents"))
    return payments.filter("user_id is not null").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("payment_status") == s).alias(s) for s in ("settled", "verified", "failed")],
        F.coalesce(F.sum(settled), F.lit(0)).alias("settled_cents"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def orphans(rows: DataFrame, referring: DataFrame, key: str) -> DataFrame:
    return rows.join(referring.select(key), key, "left_anti")


def prefix_price(rows: DataFrame, path: str, routes: DataFrame, fallback: float) -> DataFrame:
    """rows with `price`: that of the first route (pos, route, price) that begins the row's path, or the fallback. Rows stay as they are, alike ones too.

    A distinct path meets the routes by equality, through its beginnings of those lengths that routes have (as many numbers as there are lengths);
    neither side need be small. An empty route begins every path; a null path has none.
    """
    lengths = sorted(r[0] for r in routes.select(F.length("route")).distinct().collect() if r[0] is not None)
    paths = rows.select(F.col(path).alias("__path")).filter("__path is not null").distinct()
    parts = F.filter(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(n <= F.length("__path"), F.substring(F.col("__path"), F.lit(1), n))), lambda x: x.isNotNull())
    first = paths.select("__path", F.explode(parts).alias("route")).join(routes.select("route", "pos", F.col("price").alias("__price")), "route").groupBy("__path").agg(F.min_by("__price", "pos").alias("price"))
    return rows.join(first, F.col(path) == F.col("__path"), "left").drop("__path").withColumn("price", F.coalesce("price", F.lit(fallback)))
