"""Queries of plain relational rows: filters, joins, orders, sets, nested arrays, dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.bindings import table

from .catalog import AS_OF, query


@query("P2_conjunctive_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def p2(s, d):
    return table(s, d, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("P6_not_null", "SELECT doc_id FROM documents WHERE text IS NOT NULL")
def p6(s, d):
    return table(s, d, "documents").filter(F.col("text").isNotNull()).select("doc_id")


@query("J5_embedded_row", "SELECT o_orderkey, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j5(s, d):
    c = table(s, d, "customer")
    nested = table(s, d, "orders").join(c.select("c_custkey", F.struct("c_custkey", "c_name").alias("customer")), F.col("o_custkey") == F.col("c_custkey"), "left")
    return nested.select("o_orderkey", F.col("customer.c_name").alias("customer_name"))


@query("J19_answers_by_index", "SELECT q.conv_id, q.turn, coalesce(max_by(a.text, a.text), '(No answer provided)') AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user' GROUP BY q.conv_id, q.turn")
def j19(s, d):
    c = table(s, d, "conversations")
    a = c.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max("text").alias("answer"))
    return c.filter("role = 'user'").select("conv_id", "turn").distinct().join(a, ["conv_id", "turn"], "left").withColumn("answer", F.coalesce("answer", F.lit("(No answer provided)")))


@query("A9_max_level", "SELECT p_brand, coalesce(max(coalesce(p_size, 0)), -1) AS level FROM part GROUP BY 1")
def a9(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.coalesce(F.max(F.coalesce("p_size", F.lit(0))), F.lit(-1)).alias("level"))


@query("N9_batches", "SELECT source, ceil(count(*) / 100.0)::BIGINT AS batches FROM documents GROUP BY 1")
def n9(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.ceil(F.count(F.lit(1)) / 100).alias("batches"))


@query("N10_first_non_empty", "SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'unknown') AS label FROM documents")
def n10(s, d):
    first = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(s, d, "documents").select("doc_id", F.coalesce(first("lang"), first("source"), F.lit("unknown")).alias("label"))


@query("U7_known_keys", "SELECT DISTINCT event_id % 97 AS k FROM events WHERE event_id % 97 IN (SELECT item_id FROM benchmark)")
def u7(s, d):
    known = table(s, d, "benchmark").select(F.col("item_id").alias("k"))
    return table(s, d, "events").select((F.col("event_id") % 97).alias("k")).join(known, "k", "left_semi").distinct()


@query("D3_default_expiry", "SELECT event_id, ts + INTERVAL 30 DAY AS expires FROM events")
def d3(s, d):
    return table(s, d, "events").select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(30))).alias("expires"))


@query("D6_step_timing", "SELECT event_id, epoch_us(lead(ts) OVER w) // 1000 - epoch_us(ts) // 1000 AS took_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def d6(s, d):
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").select("event_id", (ms(after) - ms(F.col("ts"))).alias("took_ms"))


@query("M11_seconds_until_reset", f"SELECT user_id, greatest(1, 86400 - (epoch(TIMESTAMP '{AS_OF}')::BIGINT - floor(epoch(min(ts)))::BIGINT)) AS reset_s FROM events GROUP BY 1")
def m11(s, d):
    now = F.unix_timestamp(F.lit(AS_OF).cast("timestamp"))
    return table(s, d, "events").groupBy("user_id").agg(F.greatest(F.lit(1), 86400 - (now - F.unix_timestamp(F.min("ts").cast("timestamp")))).alias("reset_s"))
