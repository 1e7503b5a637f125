"""Queries of single records, writes, sorts, predicates, spans, retrieval stages and leases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import money, references, text
from tessera.operators import analytics, keyed, records, retrieval
from tessera.sources.bindings import PAYMENTS, TOKEN_USAGE, owners, payments, table, token_usage, view, with_views
from tessera.streaming import events as feeds
from tessera.streaming import limits

from .catalog import AS_OF, HTML_TEXT, query

# --- writes ----------------------------------------------------------------------------------------------------------
@query("W1_insert_one", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT max(r_regionkey) + 1, 'NEW' FROM region")
def w1(s, d):
    r = table(s, d, "region")
    return records.inserted(r, r.agg((F.max("r_regionkey") + 1).alias("r_regionkey")).withColumn("r_name", F.lit("NEW")))


@query("W2_bulk_insert", "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier")
def w2(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    return records.inserted(p, table(s, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("title")))


@query("W7_orphan_count", f"SELECT count(*) AS deleted FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 30 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def w7(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return records.deleted(o, table(s, d, "lineitem"), "l_orderkey", "o_orderdate", "1996-01-01 00:00:00", 30).agg(F.count(F.lit(1)).alias("deleted"))


@query("A8_deleted_rows", f"SELECT count(*) AS deleted FROM events WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND event_id NOT IN (SELECT doc_id FROM labels)")
def a8(s, d):
    labelled = table(s, d, "labels").select(F.col("doc_id").alias("event_id"))
    return records.deleted(table(s, d, "events"), labelled, "event_id", "ts", AS_OF, 14).agg(F.count(F.lit(1)).alias("deleted"))


@query("W5_rekey", "WITH m AS (SELECT c_custkey, c_custkey + 1000000 AS new_key FROM customer WHERE c_acctbal < 0) SELECT o_orderkey, coalesce(new_key, o_custkey) AS o_custkey FROM orders LEFT JOIN m ON c_custkey = o_custkey")
def w5(s, d):
    moves = table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 1000000).alias("new_id"))
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return records.migrated(users, moves, orders)[1].select("o_orderkey", F.col("user_id").alias("o_custkey"))


@query("W16_migrated_users", "WITH u AS (SELECT c_custkey, c_name FROM customer), m AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey + 1000000 END AS new_key FROM customer WHERE c_acctbal < 0) SELECT u.c_custkey, c_name FROM u ANTI JOIN m USING (c_custkey) UNION ALL SELECT new_key, c_name FROM u JOIN m USING (c_custkey) WHERE new_key NOT IN (SELECT c_custkey FROM u ANTI JOIN m USING (c_custkey))")
def w16(s, d):
    c = table(s, d, "customer")
    to = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1).otherwise(F.col("c_custkey") + 1000000)
    users = c.select(F.col("c_custkey").alias("user_id"), "c_name")
    out = records.migrated(users, c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"), to.alias("new_id")), users.select("user_id"))[0]
    return out.select(F.col("user_id").alias("c_custkey"), "c_name")


@query("W8_preserved_field", """SELECT event_id, coalesce(lag(CASE WHEN event_type <> 'error' THEN event_type || event_id END) OVER w, event_type || event_id) AS datasets, json_extract_string(props, '$.k') AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w8(s, d):
    """Stored is the document of the user's event before; that of an error has no datasets, and the first event finds none."""
    own, k = F.concat("event_type", F.col("event_id").cast("string")), F.get_json_object("props", "$.k")
    e = table(s, d, "events").withColumn("new", F.create_map(F.lit("k"), k, F.lit("uploadedDatasets"), own))
    kept = F.when(F.col("event_type") == "error", F.map_filter("new", lambda key, v: key == "k")).otherwise(F.col("new"))
    stored = F.lag(kept).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    merged = e.withColumn("stored", stored).select("event_id", records.preserved(F.col("stored"), F.col("new"), "uploadedDatasets").alias("m"))
    return merged.select("event_id", F.col("m")["uploadedDatasets"].alias("datasets"), F.col("m")["k"].alias("k"))


@query("W10_plan_feedback", """WITH g AS (SELECT user_id, list(event_type ORDER BY event_id) AS said, count(*) % 2 = 0 AS approved, CASE WHEN count(*) % 3 = 0 THEN 'new plan' END AS again FROM events GROUP BY 1)
  SELECT user_id, len(said) + 1 AS entries, (list_append(said, 'last'))[-1] AS last, CASE WHEN approved THEN 'plan_approved' ELSE 'plan_generated' END AS status, coalesce(again, 'plan ' || user_id) AS plan FROM g""")
def w10(s, d):
    n = F.count(F.lit(1))
    g = table(s, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("said"), (n % 2 == 0).alias("approved"), F.when(n % 3 == 0, "new plan").alias("again"))
    entries, status, plan = records.with_feedback(F.col("said"), F.lit("last"), F.col("approved"), F.concat(F.lit("plan "), F.col("user_id").cast("string")), F.col("again"))
    return g.select("user_id", F.size(entries).alias("entries"), F.element_at(entries, -1).alias("last"), status.alias("status"), plan.alias("plan"))


@query("W11_session_status", """WITH a AS (SELECT user_id AS session, ts, event_id, CASE event_type WHEN 'click' THEN 'answers_submitted' WHEN 'view' THEN 'plan_generated' WHEN 'purchase' THEN 'plan_approved' WHEN 'signup' THEN NULL ELSE 'abandoned' END AS status FROM events)
  SELECT session, coalesce(arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL), 'questions_generated') AS status FROM a GROUP BY 1""")
def w11(s, d):
    kind = F.create_map(*[F.lit(x) for x in ("click", "submit", "view", "set_plan", "purchase", "approve", "signup", "link", "error", "abandon")])
    a = table(s, d, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("at"), kind[F.col("event_type")].alias("action"))
    return records.session_status(a)


@query("W15_fork_conversation", "SELECT conv_id + 1000000 AS conv_id, turn, role, text, coalesce(CASE WHEN turn % 2 = 0 THEN role END, 'ui') AS source, NULL::BIGINT AS state_id, conv_id AS parent_id FROM conversations")
def w15(s, d):
    rows = table(s, d, "conversations").withColumns({"source": F.when(F.col("turn") % 2 == 0, F.col("role")), "state_id": F.col("conv_id")})
    return keyed.forked(rows, "conv_id", 1000000)


@query("W15_fork_state", "SELECT event_id, event_type AS objective, json_extract_string(props, '$.k') AS plan FROM events")
def w15_state(s, d):
    values = F.create_map(F.lit("objective"), F.col("event_type"), F.lit("plan"), F.get_json_object("props", "$.k"), F.lit("isRunning"), F.lit("true"), F.lit("steps"), F.lit("x"))
    copy = table(s, d, "events").select("event_id", keyed.forked_state(values).alias("m"))
    return copy.select("event_id", F.inline(F.array(F.struct(F.col("m")["objective"].alias("objective"), F.col("m")["plan"].alias("plan"))))).where("objective is not null")


@query("W17_batches", "SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS batch FROM embeddings) GROUP BY 1")
def w17(s, d):
    loaded = keyed.batched(table(s, d, "embeddings").select("vec_id"), "vec_id", 100)
    return loaded.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("W19_markdown", with_views("reports") + r""", b AS (SELECT p.page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, """ + HTML_TEXT + r""" AS abstract, body FROM pages p JOIN reports USING (page_id))
  SELECT page_id, '---' || chr(10) || 'title: |' || chr(10) || '  ' || title || chr(10) || 'author: "A \"B\" C"' || chr(10) || 'abstract: |' || chr(10) || '  ' || replace(abstract, chr(10), chr(10) || '  ') || chr(10) || 'bibliography: refs.bib' || chr(10) || 'biblio-style: unsrtnat' || chr(10) || 'natbiboptions: numbers' || chr(10) || 'header-includes: |' || chr(10) ||
  '  \usepackage{amsmath}' || chr(10) || '  \usepackage{amssymb}' || chr(10) || '  \usepackage{graphicx}' || chr(10) || '  \usepackage{booktabs}' || chr(10) || '---' || chr(10) || chr(10) || '# Research Snapshot' || chr(10) || chr(10) || abstract || chr(10) || chr(10) || '# Background' || chr(10) || chr(10) || body ||
  CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '# Key Insights' || chr(10) || chr(10) || '- ' || title || chr(10) || '- b' ELSE '' END || chr(10) || chr(10) || '## One' || chr(10) AS document FROM b""")
def w19(s, d):
    p = table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), text.html_text(F.col("html")).alias("abstract"))
    insights = F.when(F.col("page_id") % 2 == 0, F.array("title", F.lit("b"))).otherwise(F.array().cast("array<string>"))
    document = references.paper(F.col("title"), F.lit('A "B" C'), F.col("abstract"), F.col("abstract"), F.col("body"), insights, F.lit(None).cast("string"), F.array(F.lit("## One")), "refs.bib")
    return p.join(view(s, d, "reports"), "page_id").select("page_id", document.alias("document"))


@query("W20_payment_records", f"WITH {PAYMENTS} SELECT id, CASE WHEN id % 3 = 0 THEN 'settled' ELSE payment_status END AS payment_status, CASE WHEN id % 3 = 0 THEN 1 ELSE cents END AS cents, CASE WHEN id % 3 = 0 THEN 'tx' || id END AS tx_hash FROM payments UNION ALL SELECT c_custkey + 9000000, 'settled', 1, 'new' || c_custkey FROM customer")
def w20(s, d):
    p = payments(s, d).select("id", "payment_status", "cents").withColumn("tx_hash", F.lit(None).cast("string"))
    settled = p.filter("id % 3 = 0").select("id", F.lit("settled").alias("payment_status"), F.lit(1).cast("bigint").alias("cents"), F.concat(F.lit("tx"), F.col("id").cast("string")).alias("tx_hash"))
    new = table(s, d, "customer").select((F.col("c_custkey") + 9000000).alias("id"), F.lit("settled").alias("payment_status"), F.lit(1).cast("bigint").alias("cents"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("tx_hash"))
    return records.inserted(keyed.update_by_key(p, settled, "id"), new)


DATASETS = "WITH u AS (SELECT s_suppkey % 10 AS owner, s_suppkey AS id, 'data ' || (s_suppkey // 20) || '.csv' AS filename FROM supplier), g AS (SELECT owner, list({'id': id, 'filename': filename} ORDER BY id) AS x FROM u GROUP BY 1), n AS (SELECT owner, x, {'id': owner * 7 + CASE WHEN owner % 2 = 0 THEN 0 ELSE 100000 END, 'filename': 'data 2.csv'} AS y FROM g) "
SHOWN = "array_to_string(list_transform({0}, lambda v: v.id || ':' || v.filename), ',')"


def datasets(s, d):
    name = F.concat(F.lit("data "), F.floor(F.col("s_suppkey") / 20).cast("string"), F.lit(".csv"))
    g = table(s, d, "supplier").groupBy((F.col("s_suppkey") % 10).alias("owner")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), name.alias("filename")))).alias("x"))
    new = F.struct((F.col("owner") * 7 + F.when(F.col("owner") % 2 == 0, 0).otherwise(100000)).alias("id"), F.lit("data 2.csv").alias("filename"))
    return g.withColumn("y", new)


def shown(x):
    return F.array_join(F.transform(x, lambda v: F.concat(v["id"].cast("string"), F.lit(":"), v["filename"])), ",")


@query("W12_prepend_or_skip", DATASETS + f"SELECT owner, {SHOWN.format('CASE WHEN list_contains(list_transform(x, lambda v: v.id), y.id) THEN x ELSE list_prepend(y, list_filter(x, lambda v: v.filename <> y.filename)) END')} AS x FROM n")
def w12(s, d):
    return datasets(s, d).select("owner", shown(keyed.prepend_dataset(F.col("x"), F.col("y"))).alias("x"))


@query("W13_replace_last", DATASETS + f"SELECT owner, {SHOWN.format('list_append(list_filter(x, lambda v: v.filename <> y.filename), y)')} AS x FROM n")
def w13(s, d):
    return datasets(s, d).select("owner", shown(keyed.append_dataset(F.col("x"), F.col("y"))).alias("x"))


@query("W14_remove_by_id", DATASETS + f"SELECT owner, {SHOWN.format('list_filter(x, lambda v: v.id <> y.id)')} AS x FROM n")
def w14(s, d):
    return datasets(s, d).select("owner", shown(keyed.without_dataset(F.col("x"), F.col("y")["id"])).alias("x"))


# --- projections, predicates, joins ----------------------------------------------------------------------------------
@query("P1_projection", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def p1(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("P5_single", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 3")
def p5(s, d):
    one = records.expect_one(table(s, d, "region").filter("r_regionkey <> 3").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    return table(s, d, "nation").join(one, "n_regionkey").select("n_nationkey", "r_name")


SIMILAR = "WITH q AS (SELECT embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, e.label, list_cosine_similarity(embedding::DOUBLE[], q) AS x FROM embeddings e, q) "


def scored(s, d):
    e = table(s, d, "embeddings")
    return retrieval.scored(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")))


@query("P9_strict_threshold", SIMILAR + "SELECT vec_id, round(x, 6) AS similarity FROM s WHERE x > 0.1")
def p9(s, d):
    return scored(s, d).filter(F.col("similarity") > 0.1).select("vec_id", F.round("similarity", 6).alias("similarity"))


# relevance of a label to a query stands in for an outside scorer
SCORE = "(20 - vec_id % 23) / 20.0::DOUBLE"


def relevance(c):
    return (20 - c % 23) / F.lit(20.0)


@query("P10_score_threshold", SIMILAR + f"SELECT vec_id FROM s WHERE {SCORE} >= 0")
def p10(s, d):
    return scored(s, d).filter(relevance(F.col("vec_id")) >= 0.0).select("vec_id")


RANKED = SIMILAR + f", v AS (SELECT *, row_number() OVER (ORDER BY x DESC, vec_id) AS place FROM s WHERE x > -0.2 ORDER BY x DESC, vec_id LIMIT 20) SELECT vec_id, place, round(score, 6) AS score FROM (SELECT vec_id, place, {SCORE} AS score, row_number() OVER (ORDER BY {SCORE} DESC, place) AS n FROM v) WHERE n <= 5 AND score >= 0"


@query("K4_rerank", RANKED)
def k4(s, d):
    found = retrieval.placed(scored(s, d).filter(F.col("similarity") > -0.2), 20)
    return retrieval.reranked(found.withColumn("score", relevance(F.col("vec_id"))), 5).select("vec_id", "place", F.round("score", 6).alias("score"))


@query("G19_search", RANKED)
def g19(s, d):
    e = table(s, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return retrieval.search(e, q, lambda rows: relevance(F.col("vec_id")), -0.2, 20, 5).select("vec_id", "place", F.round("score", 6).alias("score"))


@query("J15_by_position", RANKED.replace("SELECT vec_id, place, round(score, 6) AS score FROM (SELECT", "SELECT vec_id, place FROM (SELECT"))
def j15(s, d):
    found = retrieval.placed(scored(s, d).filter(F.col("similarity") > -0.2), 20)
    answer = retrieval.reranked(found.withColumn("score", relevance(F.col("vec_id"))), 5).agg(F.array_sort(F.collect_list(F.col("place"))).alias("index"))
    return answer.select(F.explode("index").alias("place")).join(found, "place").select("vec_id", "place")


@query("P22_retry_statuses", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT + 425 IN (429, 500, 502, 503, 504)")
def p22(s, d):
    return table(s, d, "events").filter((F.get_json_object("props", "$.k").cast("int") + 425).isin(429, 500, 502, 503, 504)).select("event_id")


@query("P11_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%Std%' OR p_type ILIKE '%romo%'")
def p11(s, d):
    return table(s, d, "part").filter(F.col("p_type").ilike("%Std%") | F.col("p_type").ilike("%romo%")).select("p_partkey")


@query("J2_owned_aggregate", f"WITH {TOKEN_USAGE} SELECT user_id, type, count(DISTINCT coalesce(message_id, paper_id)) AS requests, sum(units)::BIGINT AS units FROM owned GROUP BY 1, 2")
def j2(s, d):
    owned = analytics.with_owner(analytics.with_costs(token_usage(s, d)), owners(s, d, False), owners(s, d, True))
    return owned.groupBy("user_id", "type").agg(F.countDistinct(F.coalesce("message_id", "paper_id")).alias("requests"), F.sum("units").alias("units"))


@query("J7_title_anti_join", "WITH t AS (SELECT p_name FROM part ORDER BY p_partkey LIMIT 10000), n AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' new' END AS title FROM part) SELECT title FROM n WHERE title NOT IN (SELECT p_name FROM t)")
def j7(s, d):
    p = table(s, d, "part")
    known = p.orderBy("p_partkey").limit(10000).select(F.col("p_name").alias("title"))  # the known titles are the first 10,000, as in the feature
    return p.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" new")).alias("title")).distinct().join(known, "title", "left_anti")


ROUTES = [("http://m.", 1), ("https://m.", 2), ("http://blog", 3), ("https://", 4)]


@query("J17_prefix_lookup", "SELECT page_id, CASE WHEN starts_with(url, 'http://m.') THEN 1.0 WHEN starts_with(url, 'https://m.') THEN 2.0 WHEN starts_with(url, 'http://blog') THEN 3.0 WHEN starts_with(url, 'https://') THEN 4.0 ELSE 0.01 END::DOUBLE AS price FROM pages")
def j17(s, d):
    routes = s.createDataFrame([(i, r, float(p)) for i, (r, p) in enumerate(ROUTES)], "pos int, route string, price double")
    return analytics.prefix_price(table(s, d, "pages").select("page_id", "url"), "url", routes, 0.01).select("page_id", "price")


@query("J18_owned_by", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def j18(s, d):
    c = table(s, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


# --- sorts, sets, scalars --------------------------------------------------------------------------------------------
@query("K2_order_asc", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def k2(s, d):
    return table(s, d, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", "role", "place").orderBy("conv_id", "turn")


@query("K5_merged_states", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 40 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def k5(s, d):
    o = table(s, d, "orders")
    order = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    lists = [o.filter(F.col("o_orderstatus") == x).orderBy(*order).limit(40) for x in ("F", "O", "P")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).orderBy(*order).limit(50).select("o_orderkey", "o_orderstatus")


@query("K10_composite_order", f"WITH {TOKEN_USAGE} SELECT user_id, type, row_number() OVER (ORDER BY user_id, type) AS place FROM (SELECT DISTINCT user_id, type FROM owned WHERE user_id IS NOT NULL)")
def k10(s, d):
    owned = analytics.with_owner(analytics.with_costs(token_usage(s, d)), owners(s, d, False), owners(s, d, True))
    return keyed.placed(owned.filter("user_id is not null").select("user_id", "type").distinct(), ["user_id", "type"])


@query("K8_first_k_cap", "SELECT conv_id, array_to_string(list_slice(list(turn ORDER BY turn), 1, 3), ',') AS turns FROM conversations GROUP BY 1")
def k8(s, d):
    top = keyed.top_per_group(table(s, d, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], 3)
    return top.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("turns"))


@query("U2_bag_of_fields", "WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW') SELECT o_custkey, count(*) AS papers FROM o GROUP BY 1")
def u2(s, d):
    of = lambda p: F.collect_list(F.when(F.col("o_orderpriority") == p, F.col("o_orderkey")))
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    g = table(s, d, "orders").groupBy("o_custkey").agg(*[of(p).alias(f"f{i}") for i, p in enumerate(names)])
    return g.select("o_custkey", F.size(F.concat("f0", "f1", "f2", "f3")).alias("papers")).filter("papers > 0")


@query("U6_ordered_candidates", "SELECT event_id, CASE event_type WHEN 'click' THEN 'google,openai,anthropic,openrouter' WHEN 'view' THEN 'openai,google,anthropic,openrouter' ELSE 'google,anthropic,openrouter' END AS candidates FROM events")
def u6(s, d):
    kind = F.col("event_type")
    given = F.array(F.when(kind == "click", "google"), F.when(kind.isin("click", "view"), "openai"), F.when(kind == "error", ""), F.lit("google"), F.lit("anthropic"), F.lit("openrouter"))
    return table(s, d, "events").select("event_id", F.array_join(F.array_distinct(F.filter(given, lambda x: F.coalesce(x, F.lit("")) != "")), ",").alias("candidates"))


@query("M5_mb_bytes", "SELECT p_partkey, p_size::BIGINT * 1048576 AS bytes FROM part")
def m5(s, d):
    return table(s, d, "part").select("p_partkey", money.mb_bytes(F.col("p_size").cast("bigint")).alias("bytes"))


@query("M7_backoff", "SELECT p_partkey, floor(least(10000, 1000 * pow(2, p_size % 8)) * 0.8)::BIGINT AS low, least(10000, 1000 * pow(2, p_size % 8))::BIGINT AS middle, floor(least(10000, 1000 * pow(2, p_size % 8)) * 1.2)::BIGINT AS high FROM part")
def m7(s, d):
    n = F.col("p_size") % 8
    return table(s, d, "part").select("p_partkey", money.backoff_ms(n, jitter=F.lit(-0.2)).alias("low"), money.backoff_ms(n).alias("middle"), money.backoff_ms(n, jitter=F.lit(0.2)).alias("high"))


@query("M10_guarded_ratio", "SELECT p_partkey, p_retailprice / nullif(p_size % 5, 0) AS ratio FROM part")
def m10(s, d):
    return table(s, d, "part").select("p_partkey", money.ratio(F.col("p_retailprice"), F.col("p_size") % 5).alias("ratio"))


@query("M12_price_string", "SELECT c_custkey, printf('%.2f', c_acctbal) AS price FROM customer")
def m12(s, d):
    return table(s, d, "customer").select("c_custkey", money.fixed(F.col("c_acctbal")).alias("price"))


@query("M13_stage_percent", """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 60 WHEN 4 THEN 75 WHEN 5 THEN 80 WHEN 6 THEN 90 WHEN 7 THEN 95 WHEN 8 THEN 100 ELSE 0 END AS percent FROM events""")
def m13(s, d):
    names = ["validating", "metadata", "figures", "discoveries", "bibliography", "latex_assembly", "compilation", "upload", "cleanup", "other"]
    stage = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 11).cast("int"))
    return table(s, d, "events").select("event_id", references.stage_percent(stage).alias("percent"))


@query("M14_phase_label", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Planning research' WHEN 'view' THEN 'Researching literature' WHEN 'purchase' THEN 'Analyzing data' WHEN 'signup' THEN 'Synthesizing findings' WHEN 'error' THEN 'Drafting response' END AS label FROM events")
def m14(s, d):
    phase = F.create_map(*[F.lit(x) for x in ("click", "planning", "view", "literature", "purchase", "analysis", "signup", "reflection", "error", "reply")])[F.col("event_type")]
    return table(s, d, "events").select("event_id", references.lookup(phase, references.PHASES, None).alias("label"))


@query("D2_days_before", f"SELECT event_id, TIMESTAMP '{AS_OF}' - to_days((event_id % 60)::INT) AS since FROM events")
def d2(s, d):
    return table(s, d, "events").select("event_id", (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("event_id") % 60).cast("int"))).alias("since"))


@query("D4_utc", "SELECT event_id, ts - INTERVAL 5 HOUR AS utc FROM events")
def d4(s, d):
    return table(s, d, "events").select("event_id", F.convert_timezone(F.lit("Asia/Karachi"), F.lit("UTC"), "ts").alias("utc"))


@query("D5_tolerant_timestamp", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) END AS ms FROM events")
def d5(s, d):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(F.col("event_id") % 3 == 1, "soon")
    return table(s, d, "events").select("event_id", F.unix_millis(F.try_to_timestamp(said)).alias("ms"))


@query("T27_fork_title", "WITH x AS (SELECT page_id, fork, '  ' || repeat('[Deep Research] ', fork) || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' AS t FROM pages, (SELECT unnest([0, 1, 2]) AS fork)) SELECT page_id, fork, CASE WHEN fork > 0 THEN trim(t) ELSE '[Deep Research] ' || trim(t) END AS title FROM x")
def t27(s, d):
    """Titles of pages as they are, and as they are after one fork and two."""
    forks = table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), F.explode(F.array(*map(F.lit, range(3)))).alias("fork"))
    raw = F.concat(F.lit("  "), F.repeat(F.lit("[Deep Research] "), F.col("fork")), "t", F.lit(" "))
    return forks.select("page_id", "fork", text.fork_title(raw).alias("title"))


@query("G25_without_citations", r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, ' ' || chr(10)) ELSE text || ' ' END AS value FROM documents")
def g25(s, d):
    raw = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n####  CITATIONS\n1. a\n#### Citations\n").otherwise(" "))
    return table(s, d, "documents").select("doc_id", references.stripped_citations(raw).alias("value"))


@query("T25_step", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s*[-*•]+\s*', ''), '^\s*\d+[\].:)\-]?\s*', ''), '\s+', ' ', 'g'), '[.;:,]+$', '')) AS step FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' -* ' WHEN 1 THEN '3 ' WHEN 2 THEN ' 12) ' ELSE '4] ' END || text || ' .;' AS t FROM conversations)")
def t25(s, d):
    mark = F.get(F.array(*map(F.lit, (" -* ", "3 ", " 12) ", "4] "))), (F.col("turn") % 4).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", text.step(F.concat(mark, "text", F.lit(" .;"))).alias("step"))


@query("N6_first_question", "SELECT conv_id, min(turn) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 20 AND role = 'user' AND trim(text) <> '' GROUP BY 1")
def n6(s, d):
    last = keyed.top_per_group(table(s, d, "conversations"), "conv_id", [F.desc("turn"), "role", "text"], 20)
    return last.filter((F.col("role") == "user") & F.col("text").rlike(r"\S")).groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("G23_repeated_answers", """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' and more' ELSE text END AS text FROM conversations WHERE role = 'assistant')
  SELECT b.conv_id, b.turn FROM a b WHERE EXISTS (SELECT 1 FROM a WHERE a.conv_id = b.conv_id AND a.turn < b.turn AND (trim(a.text) = '' OR (trim(b.text) <> '' AND starts_with(trim(a.text), trim(b.text))) OR starts_with(trim(b.text), trim(a.text))))""")
def g23(s, d):
    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    said = table(s, d, "conversations").filter("role = 'assistant'").withColumn("text", F.when(F.col("turn") % 6 == 5, F.concat(first, F.lit(" and more"))).otherwise(F.col("text")))
    return keyed.repeated_by_prefix(said.select("conv_id", "turn", text.trim(F.col("text")).alias("text")))


# --- spans in texts --------------------------------------------------------------------------------------------------
LINK = '<a [^>]*>[^<]*</a>'


@query("G10_spans_removed", f"SELECT page_id, regexp_replace(html, '{LINK}', '', 'g') AS value FROM pages")
def g10(s, d):
    """The page without its links; a span that ends after the page is passed over."""
    n = F.length("html")
    outside = F.struct((n - (F.col("page_id") % 7).cast("int")).alias("start"), (n + (F.col("page_id") % 5).cast("int")).alias("end"))
    return table(s, d, "pages").select("page_id", references.without_spans(F.col("html"), F.array_append(references.matches(F.col("html"), LINK), outside)).alias("value"))


@query("K7_spans_by_start", "WITH m AS (SELECT page_id, unnest(list_transform(range(1, len(string_split(html, '<a ')) + 0), lambda i: length(array_to_string(string_split(html, '<a ')[1:i], '<a ')))) AS start FROM pages) SELECT page_id, start, row_number() OVER (PARTITION BY page_id ORDER BY start DESC) AS place FROM m")
def k7(s, d):
    pieces = F.split("html", "<a ")
    before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.length(F.array_join(F.slice(pieces, F.lit(1), i), "<a ")))
    spans = table(s, d, "pages").filter(F.col("html").contains("<a ")).select("page_id", F.explode(before).alias("start"))
    return spans.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("start"))))


@query("G11_marks_put_in", """SELECT page_id, array_to_string(list_transform(string_split(html, '</a>'), lambda x, i: x || CASE WHEN i = len(string_split(html, '</a>')) THEN '' ELSE '</a>' || CASE WHEN i % 4 = 0 THEN '' WHEN i % 3 = 0 THEN '[' || i || '], [1]' ELSE '[' || i || ']' END END), '') AS value FROM pages""")
def g11(s, d):
    """After each link its number; every third cites the first link too, every fourth nothing."""
    indices = lambda i: F.when(i % 4 == 3, F.array().cast("array<int>")).when(i % 3 == 2, F.array(i, F.lit(0))).otherwise(F.array(i))
    marks = F.transform(references.matches(F.col("html"), "</a>"), lambda m, i: F.struct((m["end"] + 1).alias("end"), indices(i).alias("indices")))
    return table(s, d, "pages").select("page_id", references.with_marks(F.col("html"), marks).alias("value"))


ANCHOR = "'<span data-citation-anchor=\"{0}\"></span>'"


HREF = '<a href="([^"]*)">([^<]*)</a>'


@query("G5_anchors", f"""WITH p AS (SELECT page_id, string_split(regexp_replace(html, '{HREF}', '\\2' || chr(1), 'g'), chr(1)) AS x, replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '$$', '$') AS title FROM pages)
  SELECT page_id, array_to_string(list_transform(x, lambda y, i: y || CASE WHEN i = len(x) THEN '' ELSE {ANCHOR.format("' || i || '")} END), '') || title || {ANCHOR.format("' || len(x) || '")} || ' but none' AS value FROM p""")
def g5(s, d):
    """A page whose links are written as citations, then one of its own title, and one without an address."""
    cited = F.regexp_replace("html", HREF, r"[$2]{$1}")
    line = F.concat(cited, F.lit("["), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("]{"), "url", F.lit("} but [none]{ , }"))
    return table(s, d, "pages").select("page_id", references.anchored(line).alias("value"))


# --- events ----------------------------------------------------------------------------------------------------------
LEASES = """WITH e AS (SELECT user_id AS conv, ts AS tm, event_id AS n, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'finish' ELSE 'touch' END AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::INT % 3 END AS root FROM events),
  r AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY conv ORDER BY tm, n) AS run FROM e), o AS (SELECT *, first_value(root) OVER (PARTITION BY conv, run ORDER BY tm, n) AS own FROM r),
  f AS (SELECT *, run > 0 AND coalesce(root = own, root IS NULL, FALSE) AS fits FROM o), g AS (SELECT *, coalesce(bool_or(kind = 'finish' AND fits) OVER (PARTITION BY conv, run ORDER BY tm, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS over FROM f)"""


def lease_events(s, d, rows=None):
    """The events, or a stream of them, as starts, touches and finishes of runs."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "finish").otherwise("touch")
    root = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k").cast("int") % 3)
    rows = table(s, d, "events") if rows is None else rows
    return rows.select(F.col("user_id").alias("conv"), F.col("ts").alias("at"), F.col("event_id").alias("n"), kind.alias("kind"), root.alias("root"))


@query("E2_leases", LEASES + " SELECT conv, n, CASE kind WHEN 'start' THEN TRUE WHEN 'touch' THEN fits AND NOT over ELSE fits END AS done, run > 0 AND NOT over AND NOT (kind = 'finish' AND fits) AS running FROM g")
def e2(s, d):
    return records.lease_events(lease_events(s, d)).select("conv", "n", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("running", F.lit(False)).alias("running"))


@query("E6_routed_notices", """SELECT event_id, 'conversation:' || user_id AS channel, CASE event_type WHEN 'click' THEN 'job:started' WHEN 'view' THEN 'job:progress' WHEN 'purchase' THEN 'job:completed' WHEN 'error' THEN 'job:failed' END AS type, user_id AS conversation FROM events WHERE event_type <> 'signup'""")
def e6(s, d):
    e = table(s, d, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "job:started", "view", "job:progress", "purchase", "job:completed", "error", "job:failed")])
    notices = feeds.notices(e.select("event_id", kind[F.col("event_type")].alias("type"), F.col("user_id").alias("conversation")))
    return feeds.routed(notices).select("event_id", "channel", "type", F.col("conversation").cast("bigint").alias("conversation"))


@query("E8_changes_of_one", "SELECT event_id, CASE WHEN n = 1 THEN 'INSERT' ELSE 'UPDATE' END AS change FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE user_id = (SELECT min(user_id) FROM events)")
def e8(s, d):
    e = table(s, d, "events")
    one = e.agg(F.min("user_id").alias("user_id"))
    return feeds.changes(e.join(F.broadcast(one), "user_id"), "user_id", ["ts", "event_id"]).select("event_id", "change")


@query("Y2_payload", "SELECT conv_id, turn, (length(text) > 0) AS has_content, length(text)::BIGINT AS content_length, strlen('{\"conv_id\":' || conv_id || ',\"turn\":' || turn || ',\"has_content\":true,\"content_length\":' || length(text) || '}') < 8000 AS fits FROM conversations WHERE text <> ''")
def y2(s, d):
    payload = limits.notifications(table(s, d, "conversations").filter("text <> ''"))
    return payload.select("conv_id", "turn", F.get_json_object("payload", "$.has_content").cast("boolean").alias("has_content"), F.get_json_object("payload", "$.content_length").cast("bigint").alias("content_length"), (F.octet_length("payload") < 8000).alias("fits"))
