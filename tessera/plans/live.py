"""Queries through functions of SQL, streams whose state ends by itself, loads in batches and writes that reach storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.sources import loading, readers, versions
from tessera.sources.bindings import TOKEN_USAGE, owners, table, token_usage
from tessera.streaming import expiry, scans

from .catalog import AS_OF, query, usd
from .records import LEASES, lease_events


def streamed(s, d, name: str):
    """A table as a stream of its files (a pattern, as a stream's path may not be a single file). Those that are there are one micro-batch: they needn't be in order of time, and no row of one is late for another."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parquet*")


def call(s, d, text: str):
    """A statement of SQL over the functions, registered for these tables."""
    sql.register(s, token_usage(s, d), owners(s, d, False), owners(s, d, True))
    return s.sql(text)


# --- functions of SQL ------------------------------------------------------------------------------------------------
@query("X1_sql_pricing", f"WITH {TOKEN_USAGE} SELECT id, in_cents / 100::DOUBLE AS input_cost, out_cents / 100::DOUBLE AS output_cost FROM priced")
def x1_pricing(s, d):
    return call(s, d, "SELECT t.id, CAST(p.input_cost_per_million AS DOUBLE) AS input_cost, CAST(p.output_cost_per_million AS DOUBLE) AS output_cost FROM token_usage t, LATERAL get_model_pricing(t.provider, t.model, t.prompt_tokens) p")


@query("X1_sql_cost", f"WITH {TOKEN_USAGE} SELECT id, units / 1e8::DOUBLE AS cost_usd FROM cost")
def x1_cost(s, d):
    return call(s, d, "SELECT id, CAST(calculate_token_cost(provider, model, prompt_tokens, completion_tokens) AS DOUBLE) AS cost_usd FROM token_usage")


@query("X2_sql_per_request", f"""WITH {TOKEN_USAGE} SELECT type AS usage_type, {usd('sum(units)', 'count(*)', 100)} AS avg_cost, count(DISTINCT coalesce(message_id, paper_id)) AS total_requests, {usd('sum(units)', '1', 10000)} AS total_cost,
  ((sum(prompt_tokens) * 2 + count(*)) // (count(*) * 2))::BIGINT AS prompt, ((sum(completion_tokens) * 2 + count(*)) // (count(*) * 2))::BIGINT AS completion FROM cost GROUP BY type""")
def x2_request(s, d):
    return call(s, d, "SELECT usage_type, CAST(avg_cost_usd AS DOUBLE) AS avg_cost, total_requests, CAST(total_cost_usd AS DOUBLE) AS total_cost, CAST(avg_prompt_tokens AS BIGINT) AS prompt, CAST(avg_completion_tokens AS BIGINT) AS completion FROM get_avg_cost_per_request_by_type()")


BY_USER = f"WITH {TOKEN_USAGE}, g AS (SELECT user_id, type, count(DISTINCT coalesce(message_id, paper_id)) AS requests, sum(units) AS u, sum(prompt_tokens)::BIGINT AS prompt, sum(completion_tokens)::BIGINT AS completion FROM owned WHERE user_id IS NOT NULL GROUP BY 1, 2)"


@query("X2_sql_per_user", BY_USER + f" SELECT user_id, type AS usage_type, {usd('u', 'requests', 100)} AS avg_cost, requests AS total_requests, {usd('u', '1', 10000)} AS total_cost, prompt, completion FROM g")
def x2_user(s, d):
    return call(s, d, "SELECT user_id, usage_type, CAST(avg_cost_per_request AS DOUBLE) AS avg_cost, total_requests, CAST(total_cost_usd AS DOUBLE) AS total_cost, total_prompt_tokens AS prompt, total_completion_tokens AS completion FROM get_avg_cost_per_user_by_type()")


@query("X2_sql_overall", BY_USER + f""" SELECT type AS usage_type, count(*) AS num_users, {usd('sum(u)', 'count(*)', 10000)} AS avg_per_user, ((sum(requests) * 200 + count(*)) // (count(*) * 2))::DOUBLE / 100 AS avg_requests,
  {usd('sum(u)', 'sum(requests)', 100)} AS avg_per_request, {usd('sum(u)', '1', 10000)} AS total_cost, sum(requests)::BIGINT AS total_requests FROM g GROUP BY type""")
def x2_overall(s, d):
    return call(s, d, """SELECT usage_type, num_users, CAST(avg_cost_per_user AS DOUBLE) AS avg_per_user, CAST(avg_requests_per_user AS DOUBLE) AS avg_requests, CAST(avg_cost_per_request AS DOUBLE) AS avg_per_request,
      CAST(total_cost_usd AS DOUBLE) AS total_cost, total_requests FROM get_overall_avg_cost_per_type()""")


@query("X2_sql_by_model", f"""WITH {TOKEN_USAGE} SELECT o.o_orderpriority AS asked, c.type AS usage_type, provider, model, count(*) AS calls, {usd('sum(units)', '1', 10000)} AS total_cost, {usd('sum(units)', 'count(*)', 100)} AS avg_cost
  FROM (SELECT DISTINCT o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'chat' WHEN '2' THEN 'deep-research' WHEN '3' THEN 'no such' END AS type FROM orders) o JOIN cost c ON o.type IS NULL OR o.type = c.type GROUP BY ALL""")
def x2_model(s, d):
    """Joined laterally: each row asks for a type of its own, or, with a null, for all of them."""
    table(s, d, "orders").createOrReplaceTempView("asking_orders")
    return call(s, d, """SELECT a.o_orderpriority AS asked, m.usage_type, m.provider, m.model, m.total_calls AS calls, CAST(m.total_cost_usd AS DOUBLE) AS total_cost, CAST(m.avg_cost_per_call AS DOUBLE) AS avg_cost
      FROM (SELECT DISTINCT o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'chat' WHEN '2' THEN 'deep-research' WHEN '3' THEN 'no such' END AS kind FROM asking_orders) a, LATERAL get_cost_by_model(a.kind) m""")


@query("X2_sql_daily", f"""WITH {TOKEN_USAGE} SELECT created_at::DATE AS day, type AS usage_type, count(DISTINCT coalesce(message_id, paper_id)) AS total_requests, {usd('sum(units)', '1', 10000)} AS total_cost
  FROM cost WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1, 2""")
def x2_daily(s, d):
    return call(s, d, f"SELECT day, usage_type, total_requests, CAST(total_cost_usd AS DOUBLE) AS total_cost FROM get_daily_cost_summary(14, TIMESTAMP_NTZ '{AS_OF}')")


# --- streams that end what is silent ---------------------------------------------------------------------------------
@query("E2_stale_runs", LEASES + """, b AS (SELECT conv, run, tm, n, kind, own, epoch_us(tm) // 1000 AS ms FROM g WHERE kind = 'start' OR (fits AND NOT over)),
  x AS (SELECT *, coalesce(lead(ms) OVER (PARTITION BY conv ORDER BY tm, n), (SELECT max(epoch_us(ts) // 1000) FROM events)) AS after FROM b)
  SELECT conv, any_value(own)::BIGINT AS root, min(ms) + 14400000 AS stale_ms FROM x WHERE kind <> 'finish' AND after >= ms + 14400000 GROUP BY conv, run""")
def e2_stale(s, d):
    """A stream over the events, with a timer for each run."""
    events = lease_events(s, d, streamed(s, d, "events"))
    return expiry.run_through(s, expiry.stale_runs_stream(events), readers.scratch(s))[0]


def file_updates(events):
    """The events as updates of files' status: a user's files are told apart by their properties."""
    return events.select(F.col("user_id").alias("conv"), F.concat(F.lit("file-"), (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("string")).alias("file"), F.col("ts").alias("at"), F.col("event_id").alias("n"), F.col("event_type").alias("status"))


@query("E11_status_sweep", """WITH u AS (SELECT user_id AS conv, 'file-' || json_extract_string(props, '$.k')::BIGINT % 4 AS file, ts, event_id AS n, event_type AS status, epoch_us(ts) // 1000 AS ms FROM events),
  x AS (SELECT *, coalesce(lead(ms) OVER (PARTITION BY conv, file ORDER BY ts, n), (SELECT max(epoch_us(ts) // 1000) FROM events)) AS after FROM u)
  SELECT conv, file, status, ms + 43200000 AS ended_ms FROM x WHERE ms + 43200000 < after""")
def e11_sweep(s, d):
    """A stream over the events, with a session window for each record of a user's file."""
    return expiry.run_through(s, expiry.swept_stream(file_updates(streamed(s, d, "events")), 720), readers.scratch(s))[0]


# --- writes that reach storage ---------------------------------------------------------------------------------------
FITS = 60_000


@query("W17_failing_batches", f"""WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch, text IS NULL OR length(text) > {FITS} AS bad FROM documents)
  SELECT batch, count(*) AS n, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'loaded' END AS status, max(CASE WHEN bad THEN 'ValueError' END) AS error FROM b GROUP BY 1""")
def w17_failing(s, d):
    """Documents go in by batches; a batch with a text that is too long fails, and the others are there."""
    report = loading.load(table(s, d, "documents").select("doc_id", "text"), "doc_id", readers.scratch(s), loading.embeddable(FITS))
    return report.select("batch", "n", "status", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


@query("W4_copy_on_write", """WITH u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey <= 20 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey NOT BETWEEN 31 AND 35)
  SELECT * FROM u UNION ALL SELECT o_orderkey + 1000000000, 1, 'N' FROM orders WHERE o_custkey = 1""")
def w4_stored(s, d):
    """Updates and deletes by key, and inserts of what isn't there, as versions of a stored table, read back."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = versions.Table(s, readers.scratch(s))
    stored.create(orders.repartitionByRange("o_custkey"))
    stored.update_by_key(orders.filter("o_custkey <= 20").select("o_orderkey", F.lit("X").alias("o_orderstatus")), "o_orderkey")
    stored.delete_by_key(orders.filter("o_custkey between 31 and 35"), "o_orderkey")
    more = orders.filter("o_custkey = 1").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    stored.upsert_ignore(more.unionByName(orders.filter("o_custkey <= 20")), "o_orderkey")
    return stored.read()


@query("S2_incremental_scan", r"""SELECT lang, source, md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS line, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2, 3, 4""")
def s2_incremental(s, d):
    """The documents as text files in nested folders, scanned twice: once with one language there, and again when the others and a file in another encoding have come."""
    folder, store = readers.scratch(s), readers.scratch(s)
    line = F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    rows = table(s, d, "documents").filter("text is not null").select("lang", "source", line)
    rows.filter("lang = 'en'").write.partitionBy("lang", "source").text(folder)
    scans.scan_new(s, folder, store, "*.txt")
    taken = readers.kept(scans.texts(s, store).select("path"))
    rows.filter("lang <> 'en'").write.mode("append").partitionBy("lang", "source").text(folder)
    table(s, d, "nation").select("n_name").write.option("encoding", "UTF-16").csv(f"{folder}/other")
    scans.scan_new(s, folder, store, "*.{txt,csv}")
    found = scans.texts(s, store).join(taken.withColumn("early", F.lit(1)), "path", "left")
    lines = found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.coalesce("early", F.lit(2)).alias("run"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("lang", "source", F.md5("line").alias("line"), "run").agg(F.count(F.lit(1)).alias("n"))


# props within an object within an array, with empty ones, an escaped quote and a number at each level; text that Spark and DuckDB build alike
NESTED = """'{"b": [' || event_id || ', {"props": ' || props || ', "none": {}, "empty": [ ]}, "a' || chr(92) || '"{:,", [[' || user_id || ']]], "a" :' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '-1.5e3' ELSE '"x, y"' END || '}'"""
LAID_OUT = """{
  "b": [
    <event>,
    {
      "props": {
        "k": <k>
      },
      "none": {},
      "empty": []
    },
    "a\\"{:,",
    [
      [
        <user>
      ]
    ]
  ],
  "a": <a>
}"""


@query("S10_nested_json", f"""SELECT event_id, replace(replace(replace(replace('{LAID_OUT}', '<event>', event_id::VARCHAR), '<k>', json_extract_string(props, '$.k')), '<user>', user_id::VARCHAR),
  '<a>', CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '-1.5e3' ELSE '"x, y"' END) AS text FROM events""")
def s10_nested(s, d):
    return table(s, d, "events").selectExpr("event_id", f"{NESTED} AS x").select("event_id", readers.indented_json(F.col("x")).alias("text"))
