"""The operators' queries over the given tables, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import money, text, vectors
from tessera.operators import analytics, keyed, retrieval
from tessera.sources.bindings import PAYMENTS, TOKEN_USAGE, owners, payments, table, token_usage
from tessera.streaming import limits

AS_OF = "2024-01-31 00:00:00"
CATALOG: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        CATALOG[name] = (run, sql)
        return run

    return add


def usd(units: str, count: str, step: int) -> str:
    return f"CASE WHEN {count} > 0 THEN ((({units}) * 2 + ({count}) * {step}) // (({count}) * {2 * step}))::DOUBLE / {1e8 / step} END"


def owned(s, d):
    return analytics.with_owner(analytics.with_costs(token_usage(s, d)), owners(s, d, False), owners(s, d, True))


# --- costs -----------------------------------------------------------------------------------------------------------
@query("S1_full_scan", "SELECT * FROM region")
def s1(s, d):
    return table(s, d, "region")


@query("M1_model_pricing", f"WITH {TOKEN_USAGE} SELECT model, prompt_tokens > 200000 AS long, min(in_cents)::BIGINT AS in_cents, min(out_cents)::BIGINT AS out_cents FROM priced GROUP BY ALL")
def m1(s, d):
    a, b = money.model_price(F.col("model"), F.col("prompt_tokens"))
    return token_usage(s, d).select("model", (F.col("prompt_tokens") > 200000).alias("long"), a.alias("a"), b.alias("b")).groupBy("model", "long").agg(F.min("a").alias("in_cents"), F.min("b").alias("out_cents"))


@query("M2_token_cost", f"WITH {TOKEN_USAGE} SELECT id, units::BIGINT AS units FROM cost")
def m2(s, d):
    return analytics.with_costs(token_usage(s, d)).select("id", "units")


@query("A1_cost_per_request_by_type", f"""WITH {TOKEN_USAGE} SELECT type, {usd('sum(units)', 'count(*)', 100)} AS avg_cost_usd,
  count(DISTINCT coalesce(message_id, paper_id)) AS total_requests, {usd('sum(units)', '1', 10000)} AS total_cost_usd, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM cost GROUP BY type""")
def a1(s, d):
    return analytics.cost_per_request_by_type(token_usage(s, d))


@query("A2_cost_per_user_by_type", f"""WITH {TOKEN_USAGE}, g AS (SELECT user_id, type, count(DISTINCT coalesce(message_id, paper_id)) AS requests, sum(units) AS u FROM owned GROUP BY 1, 2)
  SELECT user_id, type, requests, {usd('u', '1', 10000)} AS total_cost_usd, {usd('u', 'requests', 100)} AS avg_cost_usd FROM g WHERE user_id IS NOT NULL""")
def a2(s, d):
    return analytics.cost_per_user_by_type(owned(s, d))


@query("A3_overall_cost_by_type", f"""WITH {TOKEN_USAGE}, g AS (SELECT user_id, type, count(DISTINCT coalesce(message_id, paper_id)) AS requests, sum(units) AS u FROM owned WHERE user_id IS NOT NULL GROUP BY 1, 2)
  SELECT type, count(*) AS users, {usd('sum(u)', 'count(*)', 100)} AS avg_per_user_usd, {usd('sum(u)', 'sum(requests)', 100)} AS avg_per_request_usd FROM g GROUP BY type""")
def a3(s, d):
    return analytics.overall_cost_by_type(owned(s, d))


@query("A4_cost_by_model", f"""WITH {TOKEN_USAGE} SELECT type, provider, model, count(*) AS calls, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens,
  {usd('sum(units)', '1', 10000)} AS total_cost_usd, {usd('sum(units)', 'count(*)', 100)} AS avg_cost_usd FROM cost GROUP BY ALL""")
def a4(s, d):
    return analytics.cost_by_model(token_usage(s, d))


@query("P7_optional_type_filter", f"""WITH {TOKEN_USAGE} SELECT type, provider, model, count(*) AS calls, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens,
  {usd('sum(units)', '1', 10000)} AS total_cost_usd, {usd('sum(units)', 'count(*)', 100)} AS avg_cost_usd FROM cost WHERE type = 'chat' GROUP BY ALL""")
def p7(s, d):
    return analytics.cost_by_model(token_usage(s, d), "chat")


@query("A5_daily_cost", f"""WITH {TOKEN_USAGE} SELECT created_at::DATE AS day, type, count(*) AS calls, {usd('sum(units)', '1', 10000)} AS cost_usd FROM cost
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1, 2""")
def a5(s, d):
    return analytics.daily_cost(token_usage(s, d), AS_OF, 14)


@query("A6_user_payment_stats", f"""WITH {PAYMENTS} SELECT user_id, count(*) AS total, count(*) FILTER (WHERE payment_status = 'settled') AS settled,
  count(*) FILTER (WHERE payment_status = 'verified') AS verified, count(*) FILTER (WHERE payment_status = 'failed') AS failed,
  coalesce(sum(cents) FILTER (WHERE payment_status = 'settled'), 0)::BIGINT AS settled_cents, min(created_at) AS first_at, max(created_at) AS last_at FROM payments WHERE user_id IS NOT NULL GROUP BY user_id""")
def a6(s, d):
    return analytics.user_payment_stats(payments(s, d))


@query("J1_usage_with_owner", f"WITH {TOKEN_USAGE} SELECT id, type, user_id, units::BIGINT AS units FROM owned")
def j1(s, d):
    return owned(s, d).select("id", "type", "user_id", "units")


@query("A7_exact_count", "SELECT count(*) AS n FROM embeddings")
def a7(s, d):
    return table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))


@query("A10_tokens_by_user", "SELECT user_id, sum(floor(value * 1000))::BIGINT AS tokens FROM events GROUP BY 1")
def a10(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 1000)).alias("tokens"))


@query("A11_margin", f"""WITH {PAYMENTS}, r AS (SELECT user_id, sum(cents) FILTER (WHERE payment_status <> 'failed')::BIGINT AS revenue, sum(cents // 10)::BIGINT AS cost FROM payments GROUP BY 1)
  SELECT user_id, CASE WHEN coalesce(revenue, 0) = 0 THEN 0.0::DOUBLE ELSE round((revenue - cost)::DOUBLE / revenue * 100, 6) END AS margin FROM r""")
def a11(s, d):
    g = payments(s, d).groupBy("user_id").agg(F.sum(F.when(F.col("payment_status") != "failed", F.col("cents"))).alias("revenue"), F.sum(F.call_function("div", F.col("cents"), F.lit(10))).alias("cost"))
    return g.select("user_id", F.when(F.coalesce("revenue", F.lit(0)) == 0, 0.0).otherwise(F.round((F.col("revenue") - F.col("cost")).cast("double") / F.col("revenue") * 100, 6)).alias("margin"))


@query("A13_counts_by_state", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def a13(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("A16_distinct_levels", "SELECT DISTINCT p_size AS level FROM part")
def a16(s, d):
    return table(s, d, "part").select(F.col("p_size").alias("level")).distinct()


@query("A17_assistant_count", "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY 1")
def a17(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n"))


@query("A18_nonblank_lines", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')))::INT - 1 AS n FROM documents")
def a18(s, d):
    return table(s, d, "documents").select("doc_id", (F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\r]"))) - 1).alias("n"))


@query("A19_joined_turns", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS history FROM conversations GROUP BY 1")
def a19(s, d):
    line = F.concat("role", F.lit(": "), "text")
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


# --- keyed writes, dedup, windows ------------------------------------------------------------------------------------
@query("W3_upsert_ignore", """WITH new AS (SELECT c_custkey + 50 AS c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0)
  SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def w3(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return keyed.upsert_ignore(c, c.filter("c_custkey % 2 = 0").withColumn("c_custkey", F.col("c_custkey") + 50), "c_custkey")


@query("W4_update_by_key", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def w4(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return keyed.update_by_key(c, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("double").alias("c_acctbal")), "c_custkey")


@query("W6_delete_by_key", "SELECT * FROM supplier WHERE s_suppkey % 5 <> 0")
def w6(s, d):
    t = table(s, d, "supplier")
    return t.join(t.filter("s_suppkey % 5 = 0").select("s_suppkey"), "s_suppkey", "left_anti").select(t.columns)


@query("W9_strip_large_fields", "SELECT page_id, url, NULL::VARCHAR AS html, strlen(html)::INT AS html_bytes FROM pages")
def w9(s, d):
    return table(s, d, "pages").select("page_id", "url", F.lit(None).cast("string").alias("html"), F.octet_length("html").alias("html_bytes"))


@query("N1_keep_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def n1(s, d):
    return keyed.keep_first(table(s, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h")), ["h"], ["doc_id"]).select("doc_id", "source")


@query("N2_collision_suffix", "SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '_' || n ELSE p_brand END AS p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def n2(s, d):
    return keyed.collision_suffix(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query("N4_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def n4(s, d):
    e = table(s, d, "events").withColumn("o", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "o")
    return keyed.latest_by(e, "user_id", "o").select("user_id", "event_id", "event_type")


@query("N5_previous_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n BETWEEN 2 AND 4")
def n5(s, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(s, d, "conversations").withColumn("n", n).filter("n between 2 and 4").select("conv_id", "turn", "role")


LOAD = "WITH r AS (SELECT event_id, user_id, event_type AS action, floor(epoch(ts))::BIGINT AS epoch FROM events) "


def requests(s, d):
    return table(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))


@query("N7_offered_load", LOAD + "SELECT event_id, count(*) OVER (PARTITION BY user_id, action ORDER BY epoch RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window FROM r")
def n7(s, d):
    return keyed.offered_load(requests(s, d), 86400, "user_id", "action").select("event_id", "in_window")


@query("E1_rate_limit", """WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS now, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
  w AS (SELECT user_id, event_type, event_id, n, TRUE AS admitted, [now] AS entries FROM r WHERE n = 1 UNION ALL
  SELECT user_id, event_type, event_id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, now) ELSE list_filter(kept, lambda e: e <> now) END
  FROM (SELECT r.*, list_filter(w.entries, lambda e: e > now - 604800) AS kept FROM w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.n = w.n + 1)) SELECT event_id, admitted FROM w""")
def e1(s, d):
    return limits.admitted(requests(s, d), 3, 86400 * 7).select("event_id", "admitted")


@query("N8_next_level", "SELECT p_brand, coalesce(max(coalesce(p_size, 0)), -1) + 1 AS next_level FROM part GROUP BY 1")
def n8(s, d):
    return table(s, d, "part").groupBy("p_brand").agg((F.coalesce(F.max(F.coalesce("p_size", F.lit(0))), F.lit(-1)) + 1).alias("next_level"))


@query("E9_change_detect", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def e9(s, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").withColumn("p", before).filter("p is null or p <> event_type").select("event_id")


@query("E7_change_notices", "SELECT conv_id, turn, 'conversation:' || conv_id AS channel, '{\"conv_id\":' || conv_id || ',\"turn\":' || turn || ',\"has_content\":' || (length(coalesce(text, '')) > 0) || ',\"content_length\":' || length(coalesce(text, '')) || '}' AS payload FROM conversations")
def e7(s, d):
    return limits.notifications(table(s, d, "conversations"))


@query("E11_ttl", f"SELECT event_id FROM events WHERE ts + INTERVAL 1440 MINUTE > TIMESTAMP '2024-01-15 00:00:00'")
def e11(s, d):
    return limits.live(table(s, d, "events"), "2024-01-15 00:00:00", 1440).select("event_id")


# --- sets, joins, sorts ----------------------------------------------------------------------------------------------
@query("U1_bag_union", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def u1(s, d):
    o = table(s, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_orderkey").unionByName(o.filter("o_orderstatus = 'P'").select("o_orderkey"))


@query("U3_new_texts", "SELECT doc_id FROM documents WHERE trim(text) NOT IN (SELECT trim(text) FROM benchmark WHERE text IS NOT NULL)")
def u3(s, d):
    key = F.trim("text").alias("k")
    return table(s, d, "documents").select("doc_id", key).join(table(s, d, "benchmark").filter("text is not null").select(key), "k", "left_anti").select("doc_id")


@query("J3_left_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j3(s, d):
    return analytics.orphans(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("J4_left_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j4(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("J6_two_hop_lookup", "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j6(s, d):
    c, n = table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "nation").select("n_nationkey", "n_name")
    return table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "n_name")


@query("J9_last_wins_index", "SELECT k, max_by(event_id, event_id) AS event_id FROM (SELECT user_id AS k, event_id FROM events UNION ALL SELECT event_id % 97 AS k, event_id FROM events) GROUP BY 1")
def j9(s, d):
    e = table(s, d, "events").select(F.explode(F.array(F.col("user_id"), F.col("event_id") % 97)).alias("k"), "event_id")
    return e.groupBy("k").agg(F.max_by("event_id", "event_id").alias("event_id"))


@query("J16_price_lookup", "SELECT l_orderkey, round(sum(p_retailprice), 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j16(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("K1_order_desc_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def k1(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("K3_knn_threshold", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity, list_cosine_similarity(embedding::DOUBLE[], q) AS x FROM embeddings, q)
  SELECT vec_id, similarity FROM s WHERE x > 0.1 ORDER BY x DESC, vec_id LIMIT 20""")
def k3(s, d):
    e = table(s, d, "embeddings")
    return retrieval.match(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")), 0.1, 20)


@query("K6_group_cap", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def k6(s, d):
    return keyed.top_per_group(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id")


@query("M3_cosine", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q")
def m3(s, d):
    e = table(s, d, "embeddings")
    q = e.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


def last_mark(mark: str, size: int) -> str:
    """SQL of the place from 0, after a, of the last mark that begins at most at a + 2000."""
    part = f"substr(text, a + 1, 2000 + {size})"
    return f"(CASE WHEN contains({part}, {mark}) THEN length({part}) - strpos(reverse({part}), reverse({mark})) - {size} + 1 ELSE -1 END)"


PARAGRAPH, LINE, SENTENCE, WORD = last_mark("chr(10) || chr(10)", 2), last_mark("chr(10)", 1), last_mark("'. '", 2), last_mark("' '", 1)
CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, text, 0 AS i, 0 AS a FROM d UNION ALL
  SELECT doc_id, text, i + 1, e FROM (SELECT *, CASE WHEN a + 2000 >= length(text) THEN length(text) WHEN {PARAGRAPH} > 1000 THEN a + {PARAGRAPH} + 1 WHEN {LINE} > 1000 THEN a + {LINE} + 1 WHEN {SENTENCE} > 1000 THEN a + {SENTENCE} + 2
  WHEN {WORD} > 1000 THEN a + {WORD} + 1 ELSE a + 2000 END AS e FROM s) WHERE e < length(text)), o AS (SELECT doc_id, i AS chunk_index, a AS chunk_start, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY i), length(text)) AS chunk_end, text FROM s),
  t AS (SELECT *, trim(substr(text, chunk_start + 1, chunk_end - chunk_start), ' ' || chr(10) || chr(9) || chr(13)) AS content FROM o)
  SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, chunk_start, chunk_end, content FROM t WHERE content <> ''"""


@query("G1_chunker", CHUNKS)
def g1(s, d):
    return retrieval.chunk(table(s, d, "documents"))


@query("Y12_split_turns", "SELECT q.conv_id, q.turn, q.text AS question, a.text AS content FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def y12(s, d):
    c = table(s, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])


# --- strings ---------------------------------------------------------------------------------------------------------
def text_query(name: str, source: str, key: str, column: str, spark, sql: str):
    @query(name, f"SELECT {key}, {sql} AS value FROM {source}")
    def run(s, d):
        return table(s, d, source).select(key, spark(F.col(column)).alias("value"))


text_query("T10_truncate", "documents", "doc_id", "text", lambda x: text.truncated(x, 300), "CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END")
text_query("T11_paper_filename", "pages", "page_id", "url", text.safe_filename, "regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), '__+', '_', 'g')")
text_query("T12_upload_filename", "pages", "page_id", "url", text.upload_filename, "regexp_replace(url, '[^a-zA-Z0-9.-_]', '_', 'g')")
text_query("T13_extension", "pages", "page_id", "url", text.extension, r"lower(regexp_extract(url, '(\.[^.]*)$', 1))")
text_query("T3_citekey", "pages", "page_id", "url", text.citekey, "substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^[^A-Za-z]', 'X'), 1, 64)")
text_query("T17_domain", "pages", "page_id", "url", text.domain_name, r"""(SELECT CASE WHEN len(l) < 2 THEN l[1] WHEN len(l) > 2 AND l[-2] IN ('co', 'com', 'gov', 'edu', 'ac', 'org', 'net') THEN l[-3] ELSE l[-2] END FROM (SELECT string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', ''), '.') AS l))""")
HTML_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'))"""


text_query("T20_html_text", "pages", "page_id", "html", text.html_text, HTML_TEXT)
text_query("T26_objective", "conversations", "conv_id", "text", lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("")), r"nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')")
text_query("T28_title_preview", "conversations", "conv_id", "text", lambda x: F.when(F.length(x) > 30, F.concat(F.substring(x, 1, 30), F.lit("..."))).otherwise(x), "CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END")
text_query("T31_basename", "pages", "page_id", "url", text.basename, "list_extract(string_split(url, '/'), -1)")
text_query("T35_lower_key", "customer", "c_custkey", "c_name", F.lower, "lower(c_name)")
text_query("T2_doi_citekey", "pages", "page_id", "url", lambda x: text.doi_citekey(F.lower(x)), "'doi_' || regexp_replace(lower(url), '[^a-z0-9]', '_', 'g')")
text_query("T19_trailing_punctuation", "documents", "doc_id", "text", lambda x: F.regexp_replace(x, r"[.,;:!?)]+\z", ""), r"regexp_replace(text, '[.,;:!?)]+$', '')")
text_query("M4_file_size", "documents", "doc_id", "n_chars", lambda x: money.file_size(x * 1000), """CASE WHEN n_chars = 0 THEN '0 Bytes' WHEN n_chars * 1000 < 1024 THEN printf('%.2f', n_chars * 1000.0::DOUBLE) || ' Bytes'
  WHEN n_chars * 1000 < 1048576 THEN printf('%.2f', round(n_chars * 1000 / 1024.0::DOUBLE, 2)) || ' KB' WHEN n_chars * 1000 < 1073741824 THEN printf('%.2f', round(n_chars * 1000 / 1048576.0::DOUBLE, 2)) || ' MB' ELSE printf('%.2f', n_chars * 1000 / 1073741824.0::DOUBLE) || ' GB' END""")
text_query("M6_base_units", "customer", "c_custkey", "c_acctbal", lambda x: money.base_units(F.abs(x).cast("decimal(20,2)").cast("string")), "CASE WHEN abs(c_acctbal) < 0.005 THEN '0' ELSE (round(abs(c_acctbal) * 100)::BIGINT * 10000)::VARCHAR END")
text_query("P12_non_blank", "documents", "doc_id", "text", lambda x: x.rlike(r"\S"), r"regexp_matches(text, '\S')")
text_query("G8_math_balance", "documents", "doc_id", "text", lambda x: F.regexp_count(F.regexp_replace(x, F.lit(r"\$\$[^$]*\$\$"), F.lit("")), F.lit(r"\$")) % 2 == 0, r"len(regexp_extract_all(regexp_replace(text, '\$\$[^$]*\$\$', '', 'g'), '\$')) % 2 = 0")
text_query("S21_page_text_cap", "pages", "page_id", "html", lambda x: F.substring(text.html_text(x), 1, 4000), f"substr({HTML_TEXT}, 1, 4000)")


@query("V1_check_domain", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def v1(s, d):
    return table(s, d, "orders").filter(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("V2_unique_key", "SELECT text_hash, count(*) AS n FROM (SELECT md5(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def v2(s, d):
    return table(s, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("V3_foreign_key", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def v3(s, d):
    return analytics.orphans(table(s, d, "labels").select("doc_id"), table(s, d, "documents"), "doc_id")


@query("P8_since", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def p8(s, d):
    return table(s, d, "events").filter(F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))).select("event_id")


@query("P3_membership", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def p3(s, d):
    return table(s, d, "events").filter(F.col("event_type").isin("click", "error")).select("event_id")


@query("P4_json_path_equality", "SELECT event_id FROM events WHERE regexp_extract(props, '\"k\": *([0-9]+)', 1) = '7'")
def p4(s, d):
    return table(s, d, "events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("P14_level_window", "SELECT p_partkey FROM part WHERE coalesce(p_size, 0) >= greatest(1, 50 - (2 - 1)) AND trim(p_name) <> ''")
def p14(s, d):
    return table(s, d, "part").filter((F.coalesce("p_size", F.lit(0)) >= F.greatest(F.lit(1), F.lit(50 - (2 - 1)))) & (F.trim("p_name") != "")).select("p_partkey")


@query("P26_wait_for_files", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN TRUE ELSE l.quality = 1 END AS done FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p26(s, d):
    l = table(s, d, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return table(s, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.when(F.col("there").isNull(), True).otherwise(F.col("quality") == 1).alias("done"))


@query("D1_day", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def d1(s, d):
    return table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
