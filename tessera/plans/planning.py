"""Queries of plans, discoveries and answers: nested JSON, evidence, artifacts, context, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import references, state, text
from tessera.operators import keyed, planning
from tessera.sources import readers
from tessera.sources.bindings import table, view, with_views

from .catalog import query

# --- answers of a model ----------------------------------------------------------------------------------------------
#: Replies of each event: JSON as such, fenced, within a sentence, broken, another JSON, or none. Text that Spark and DuckDB build alike.
REPLY = """CASE event_id % 7 WHEN 0 THEN j WHEN 1 THEN 'So:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' WHEN 2 THEN 'It is ' || j || ', I think' WHEN 3 THEN 'It is ' || substr(j, 1, length(j) - 3)
 WHEN 4 THEN props WHEN 5 THEN '```' || chr(10) || j || chr(10) || '```' ELSE 'nothing of ' || user_id END"""
BODIES = {
    "plan": """'{"currentObjective": "Study ' || event_type || '", "plan": [{"type": "ANALYSIS", "objective": "look at ' || user_id || '", "level": 4}, {"type": "LITERATURE", "objective": "read ' || event_type || '"}, {"objective": ""}]}'""",
    "discoveries": """'{"discoveries": [{"title": "of ' || event_type || '"}, {"title": "of ' || user_id || '"}]}'""",
    "reflection": """'{"currentObjective": "Study ' || event_type || '", "keyInsights": ' || CASE WHEN event_id % 2 = 0 THEN '["a ' || user_id || '", "b"]' ELSE '"none"' END || '}'""",
    "questions": """'{"questions": [{"category": "' || CASE event_type WHEN 'click' THEN 'scope_constraints' WHEN 'view' THEN 'methodology' ELSE 'other' END || '", "question": "why ' || user_id || '?", "priority": "high"}, {"category": "output", "question": "", "priority": "low"}, {"category": "output", "question": "what?", "priority": "' || CASE WHEN event_id % 3 = 0 THEN 'urgent' ELSE 'low' END || '"}]}'""",
    "message": """'{"message": "It grew by ' || user_id || '"}'""",
}


def replies_sql(body: str) -> str:
    return f"WITH b AS (SELECT event_id, event_type, user_id, props, {BODIES[body]} AS j FROM events), a AS (SELECT *, {REPLY} AS x FROM b)"


def replies(s, d, body: str) -> DataFrame:
    e = table(s, d, "events").selectExpr("event_id", "event_type", "user_id", "props", f"{BODIES[body]} AS j")
    return e.selectExpr("*", f"{REPLY} AS x")


BLOCK = r"regexp_extract(x, '(?s)```(?:json)?\s*(.*?)\s*```', 1)"
BRACES = r"regexp_extract(x, '(?s)(\{.*\})', 1)"
VALID = "(json_valid({0}) AND {0} <> '')"
PLAN = replies_sql("plan") + rf""", m AS (SELECT *, CASE WHEN {VALID.format('x')} THEN 'direct' WHEN {VALID.format(BLOCK)} THEN 'code_block' WHEN {VALID.format(BRACES)} AND (json_exists({BRACES}, '$.plan') OR json_exists({BRACES}, '$.currentObjective')) THEN 'json_match'
  WHEN regexp_matches(x, '"currentObjective"\s*:\s*"[^"\\]') OR regexp_matches(x, '(?s)"type"\s*:\s*"(LITERATURE|ANALYSIS)".*?"objective"\s*:\s*"') THEN 'regex' ELSE 'default' END AS method FROM a),
n AS (SELECT *, CASE method WHEN 'direct' THEN x WHEN 'code_block' THEN {BLOCK} WHEN 'json_match' THEN {BRACES} END AS part FROM m),
t AS (SELECT event_id, i, CASE WHEN part IS NOT NULL THEN coalesce(nullif(json_extract_string(part, '$.plan[' || i || '].type'), ''), 'LITERATURE') WHEN method = 'regex' THEN regexp_extract_all(x, '(?s)"type"\s*:\s*"(LITERATURE|ANALYSIS)".*?"objective"\s*:\s*"([^"\\]*)"', 1)[i + 1] ELSE 'LITERATURE' END AS type,
  CASE WHEN part IS NOT NULL THEN coalesce(json_extract_string(part, '$.plan[' || i || '].objective'), '') WHEN method = 'regex' THEN regexp_extract_all(x, '(?s)"type"\s*:\s*"(LITERATURE|ANALYSIS)".*?"objective"\s*:\s*"([^"\\]*)"', 2)[i + 1] ELSE event_type END AS objective,
  coalesce(try_cast(json_extract_string(part, '$.plan[' || i || '].level') AS INT), i + 1)::INT AS level
  FROM (SELECT *, unnest(range(0, coalesce(CASE WHEN part IS NOT NULL THEN json_array_length(part, '$.plan') WHEN method = 'regex' THEN len(regexp_extract_all(x, '(?s)"type"\s*:\s*"(LITERATURE|ANALYSIS)".*?"objective"\s*:\s*"([^"\\]*)"', 1)) ELSE 1 END, 0)::BIGINT)) AS i FROM n))"""


@query("Y3_planning_json", PLAN + r""" SELECT event_id, method, CASE WHEN part IS NOT NULL THEN coalesce(json_extract_string(part, '$.currentObjective'), '') WHEN method = 'regex' THEN regexp_extract(x, '"currentObjective"\s*:\s*"([^"\\]*)"', 1) ELSE event_type END AS objective,
  (SELECT count(*) FROM t WHERE t.event_id = n.event_id) AS tasks FROM n""")
def y3(s, d):
    r = replies(s, d, "plan").select("event_id", state.planning(F.col("x"), F.col("event_type")).alias("p"))
    return r.select("event_id", "p.method", "p.objective", F.size("p.plan").alias("tasks"))


@query("Y4_whole_tasks", PLAN + " SELECT event_id, i + 1 AS place, type, objective, level FROM t")
def y4(s, d):
    r = replies(s, d, "plan").select("event_id", F.posexplode(state.planning(F.col("x"), F.col("event_type"))["plan"]).alias("i", "t"))
    return r.select("event_id", (F.col("i") + 1).alias("place"), "t.type", "t.objective", "t.level")


@query("K9_longest_json", replies_sql("plan") + f""" SELECT event_id, {BRACES} AS c FROM a WHERE {VALID.format(BRACES)} AND (json_exists({BRACES}, '$.plan') OR coalesce(json_extract_string({BRACES}, '$.currentObjective'), '') <> '')""")
def k9(s, d):
    return replies(s, d, "plan").select("event_id", state.largest_planning(F.col("x")).alias("c")).filter("c is not null")


# two replies in one, so that what stands from the first brace to the last is no JSON, with a brace in quotes
TWICE = """'first ' || x || ' or {not ' || chr(10) || '{"again": {"plan": "a } b ' || user_id || '"}}'"""


@query("K9_nested_objects", replies_sql("plan") + rf""", t AS (SELECT event_id, {TWICE} AS x FROM a), o AS (SELECT event_id, x, unnest(list_filter(range(1, length(x) + 1), lambda i: x[i] = '{{')) AS i FROM t),
  c AS (SELECT event_id, substr(x, i, j - i + 1) AS c FROM (SELECT *, unnest(list_filter(range(i, length(x) + 1), lambda j: x[j] = '}}')) AS j FROM o))
  SELECT DISTINCT event_id, c FROM c WHERE json_valid(c)""")
def k9_nested(s, d):
    """Every object in a reply that is JSON by itself; the SQL tries each brace with each later one."""
    rows = replies(s, d, "plan").selectExpr("event_id", f"{TWICE} AS x")
    return rows.select("event_id", F.explode(state.nested_objects(F.col("x"))).alias("c")).filter(references.is_json(F.col("c"))).distinct()


UNFENCED = r"trim(regexp_replace(regexp_replace(x, '```json\n?', ''), '\n?```$', ''), ' ' || chr(10))"
OBJECT = r"regexp_extract(x, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1)"
JSON_OF = f"CASE WHEN {VALID.format(UNFENCED)} THEN {UNFENCED} WHEN {VALID.format(OBJECT)} THEN {OBJECT} END"


@query("Y6_discoveries", replies_sql("discoveries") + f", p AS (SELECT *, {JSON_OF} AS part FROM a) SELECT event_id, CASE WHEN part IS NULL THEN 'stored ' || event_type ELSE coalesce(array_to_string(json_extract_string(part, '$.discoveries[*].title'), ';'), '') END AS titles FROM p")
def y6(s, d):
    kept = F.array(F.concat(F.lit("stored "), "event_type"))
    return replies(s, d, "discoveries").select("event_id", F.array_join(state.discovered(F.col("x"), kept), ";").alias("titles"))


@query("Y15_reflection", replies_sql("reflection") + f""", p AS (SELECT *, {JSON_OF} AS part FROM a) SELECT event_id, CASE WHEN part IS NULL THEN 'stored' ELSE json_extract_string(part, '$.currentObjective') END AS objective,
  CASE WHEN part IS NULL THEN 'old' WHEN json_type(part, '$.keyInsights') = 'ARRAY' THEN array_to_string(json_extract_string(part, '$.keyInsights[*]'), ';') ELSE '' END AS insights FROM p""")
def y15(s, d):
    stored = F.struct(F.lit("stored").alias("objective"), F.array(F.lit("old")).alias("insights"))
    r = replies(s, d, "reflection").select("event_id", state.reflection(F.col("x"), stored).alias("r"))
    return r.select("event_id", "r.objective", F.array_join("r.insights", ";").alias("insights"))


QUESTIONS = replies_sql("questions") + rf""", p AS (SELECT *, CASE WHEN regexp_matches(trim(x), '(?s)```(?:json)?\s*.*?```') THEN trim(regexp_extract(trim(x), '(?s)```(?:json)?\s*(.*?)```', 1), ' ' || chr(10)) ELSE trim(x) END AS part FROM a),
  q AS (SELECT event_id, i, json_extract_string(part, '$.questions[' || i || '].category') AS category, json_extract_string(part, '$.questions[' || i || '].question') AS question, json_extract_string(part, '$.questions[' || i || '].priority') AS priority
  FROM (SELECT *, unnest(range(0, CASE WHEN {VALID.format('part')} THEN coalesce(json_array_length(part, '$.questions'), 0)::BIGINT ELSE 0 END)) AS i FROM p))"""


@query("Y17_question_list", QUESTIONS + " SELECT event_id, i, category, question FROM q")
def y17(s, d):
    return replies(s, d, "questions").select("event_id", F.posexplode(state.question_list(F.col("x"))).alias("i", "q")).select("event_id", "i", "q.category", "q.question")


@query("P24_valid_questions", QUESTIONS + " SELECT event_id, question FROM q WHERE category IN ('ambiguity', 'data_requirements', 'scope_constraints', 'methodology', 'output') AND priority IN ('high', 'medium', 'low') AND question <> ''")
def p24(s, d):
    return replies(s, d, "questions").select("event_id", F.explode(state.valid_questions(state.question_list(F.col("x")))).alias("q")).select("event_id", "q.question")


@query("Y16_message_or_raw", replies_sql("message") + r""", p AS (SELECT *, regexp_replace(regexp_replace(x, '```json\n?', ''), '\n?```$', '') AS part FROM a) SELECT event_id, CASE WHEN json_valid(part) THEN json_extract_string(part, '$.message') ELSE x END AS message FROM p""")
def y16(s, d):
    return replies(s, d, "message").select("event_id", state.message_or_raw(F.col("x")).alias("message"))


XML = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Well <response><role>' || role || '</role><text> a &lt;b&gt; &amp;amp; ' || length(text) || ' </text><actions>x, y,' || role || '</actions></response>' WHEN 1 THEN '<answer><simple>TRUE</simple><text>' || length(text) || '</text><bad>1</worse></answer>'
 WHEN 2 THEN '<response><text>old</text><text>' || role || '</text><simple>no</simple></response>' ELSE 'no tags in ' || role END AS x FROM {0}"""


@query("Y8_xml_values", f"WITH a AS ({XML.format('conversations')})" + r""", b AS (SELECT conv_id, turn, CASE WHEN regexp_matches(x, '(?s)<response>') THEN regexp_extract(x, '(?s)<response>(.*?)</response>', 1) ELSE regexp_extract(x, '(?s)<answer>(.*?)</answer>', 1) END AS i FROM a),
  t AS (SELECT conv_id, turn, n, regexp_extract_all(i, '(?s)<([\w-]+)>(.*?)</([\w-]+)>', 1)[n] AS k, regexp_extract_all(i, '(?s)<([\w-]+)>(.*?)</([\w-]+)>', 2)[n] AS v, regexp_extract_all(i, '(?s)<([\w-]+)>(.*?)</([\w-]+)>', 3)[n] AS c
  FROM (SELECT *, unnest(range(1, len(regexp_extract_all(i, '(?s)<([\w-]+)>(.*?)</([\w-]+)>', 1)) + 1)) AS n FROM b)),
  u AS (SELECT conv_id, turn, k, trim(replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS v, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY n DESC) AS r FROM t WHERE k = c)
  SELECT conv_id, turn, k, CASE k WHEN 'actions' THEN array_to_string(list_transform(string_split(v, ','), lambda w: trim(w)), '|') WHEN 'simple' THEN (lower(v) = 'true')::VARCHAR ELSE v END AS v FROM u WHERE r = 1""")
def y8(s, d):
    x = s.sql(XML.format("{c}"), c=table(s, d, "conversations"))
    return x.select("conv_id", "turn", F.explode(state.xml_values(F.col("x"))).alias("k", "v")).withColumn("v", F.array_join("v", "|"))


# --- tasks and evidence ----------------------------------------------------------------------------------------------
TASKS, ARTIFACTS, EVIDENCE = with_views("tasks"), with_views("tasks", "artifacts"), with_views("evidence", "discoveries")
INDEX = """, ix AS (SELECT plan_id, k, max_by(pos, pos) AS pos FROM (SELECT plan_id, job_id AS k, pos FROM tasks WHERE job_id IS NOT NULL UNION ALL SELECT plan_id, id, pos FROM tasks) GROUP BY 1, 2)"""
ALLOWED = EVIDENCE + INDEX + """, e AS (SELECT plan_id, discovery, cited, trim(cited) IN ('N/A', 'undefined', 'null', '') AS bad FROM evidence), h AS (SELECT plan_id, discovery, bool_or(NOT bad) AS usable, bool_or(bad) AS bad FROM e GROUP BY 1, 2),
  o AS (SELECT plan_id, discovery, h.bad, CASE WHEN NOT coalesce(usable, FALSE) AND job_id <> '' THEN job_id END AS own FROM h FULL JOIN discoveries USING (plan_id, discovery)),
  v AS (SELECT * FROM e UNION ALL SELECT plan_id, discovery, own, trim(own) IN ('N/A', 'undefined', 'null', '') FROM o WHERE own IS NOT NULL), g AS (SELECT plan_id, discovery, coalesce(bad, FALSE) OR coalesce(trim(own) IN ('N/A', 'undefined', 'null', ''), FALSE) AS bad FROM o),
  f AS (SELECT v.plan_id, v.discovery, ix.pos FROM v JOIN ix ON ix.plan_id = v.plan_id AND ix.k = v.cited WHERE NOT v.bad), n AS (SELECT plan_id, discovery, count(*) AS n FROM f GROUP BY 1, 2),
  al AS (SELECT * FROM f UNION ALL SELECT g.plan_id, g.discovery, t.pos FROM g LEFT JOIN n USING (plan_id, discovery) JOIN tasks t ON t.plan_id = g.plan_id WHERE n.n IS NULL OR (g.bad AND NOT EXISTS (
  SELECT 1 FROM f JOIN tasks x ON x.plan_id = f.plan_id AND x.pos = f.pos WHERE f.plan_id = g.plan_id AND f.discovery = g.discovery AND (coalesce(x.job_id, x.id) = t.job_id OR coalesce(x.job_id, x.id) = t.id))))"""


def allowed(s, d) -> tuple[DataFrame, DataFrame]:
    """(tasks, what discoveries may draw on); the tasks are numbered once and written, as several steps read them."""
    tasks = readers.kept(view(s, d, "tasks"))
    return tasks, planning.allowed_tasks(view(s, d, "evidence", tasks=tasks), tasks, view(s, d, "discoveries", tasks=tasks))


@query("J10_evidence_tasks", ALLOWED + " SELECT plan_id, discovery, pos FROM al")
def j10(s, d):
    return allowed(s, d)[1].select("plan_id", "discovery", "pos")


@query("G18_evidence_expansion", ALLOWED + ", k AS (SELECT DISTINCT al.plan_id, unnest([t.job_id, t.id]) AS k FROM al JOIN tasks t ON t.plan_id = al.plan_id AND t.pos = al.pos) SELECT ix.plan_id, ix.k, ix.pos FROM k JOIN ix ON ix.plan_id = k.plan_id AND ix.k = k.k")
def g18(s, d):
    tasks, drawn = allowed(s, d)
    return planning.evidence_tasks(drawn, tasks).select("plan_id", "k", "pos")


@query("A14_output_chars", ALLOWED + " SELECT al.plan_id, al.discovery, sum(length(coalesce(output, '')))::BIGINT AS chars FROM al JOIN tasks t ON t.plan_id = al.plan_id AND t.pos = al.pos GROUP BY 1, 2")
def a14(s, d):
    tasks, drawn = allowed(s, d)
    taken = drawn.join(tasks.select("plan_id", "pos", "output"), ["plan_id", "pos"])
    return taken.groupBy("plan_id", "discovery").agg(F.sum(F.length(F.coalesce("output", F.lit("")))).alias("chars"))


@query("P15_completed_analyses", ARTIFACTS + " SELECT t.plan_id, t.id, a.art_id FROM tasks t JOIN artifacts a USING (task_key) WHERE t.type = 'ANALYSIS' AND t.ended")
def p15(s, d):
    done = planning.with_artifacts(view(s, d, "tasks"), view(s, d, "artifacts")).filter((F.col("type") == "ANALYSIS") & F.col("ended") & (F.size("artifacts") > 0))
    return done.select("plan_id", "id", F.explode("artifacts").alias("a")).select("plan_id", "id", "a.art_id")


@query("P16_figures", ARTIFACTS + r" SELECT a.art_id FROM tasks t JOIN artifacts a USING (task_key) WHERE t.type = 'ANALYSIS' AND a.type = 'FILE' AND lower(regexp_extract(coalesce(a.name, a.path, ''), '\.([^.]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'gif', 'webp')")
def p16(s, d):
    ending = F.lower(F.regexp_extract(F.coalesce("a.name", "a.path", F.lit("")), r"\.([^.]+)$", 1))
    rows = planning.with_artifacts(view(s, d, "tasks").filter("type = 'ANALYSIS'"), view(s, d, "artifacts")).select(F.explode("artifacts").alias("a"))
    return rows.filter((F.col("a.type") == "FILE") & ending.isin("png", "jpg", "jpeg", "gif", "webp")).select("a.art_id")


WANTED = "SELECT l_orderkey AS task_key, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN 'art-' || l_orderkey || '-' || (l_linenumber - 1) ELSE 'file-' || l_partkey END AS id, 'data ' || l_suppkey || '.csv' AS filename FROM {0}"


@query("J8_dataset_paths", ARTIFACTS + f""", w AS ({WANTED.format('lineitem')}), m AS (SELECT art_id, max_by(path, task_key * 10 + art_no) AS path FROM artifacts WHERE path IS NOT NULL GROUP BY 1)
  SELECT w.task_key, w.n, coalesce(m.path, 'uploads/' || filename) AS path FROM w LEFT JOIN m ON m.art_id = w.id""")
def j8(s, d):
    wanted = s.sql(WANTED.format("{l}"), l=table(s, d, "lineitem"))
    known = view(s, d, "artifacts").filter("path is not null").groupBy(F.col("art_id").alias("id")).agg(F.max_by("path", F.col("task_key") * 10 + F.col("art_no")).alias("known"))
    return wanted.join(known, "id", "left").select("task_key", "n", F.coalesce("known", F.concat(F.lit("uploads/"), "filename")).alias("path"))


@query("J11_repaired_paths", ARTIFACTS + r""", a AS (SELECT t.plan_id, t.pos, a.* FROM artifacts a JOIN tasks t USING (task_key)), last AS (SELECT *, list_extract(string_split(path, '/'), -1) AS base FROM a),
  k AS (SELECT plan_id, key, arg_max_null(path, (pos, art_no, b)) AS path FROM (SELECT plan_id, name AS key, path, pos, art_no, 0 AS b FROM last WHERE name <> '' UNION ALL SELECT plan_id, base, path, pos, art_no, 1 FROM last WHERE base <> '') GROUP BY 1, 2),
  w AS (SELECT plan_id, task_key, art_no, CASE WHEN art_no % 2 = 0 THEN name END AS name, '/home/user/' || coalesce(base, 'gone.png') AS path, coalesce(base, 'gone.png') AS base FROM last)
  SELECT w.task_key, w.art_no, coalesce(nullif(a.path, ''), nullif(b.path, ''), w.path) AS path FROM w LEFT JOIN k a ON a.plan_id = w.plan_id AND a.key = w.name LEFT JOIN k b ON b.plan_id = w.plan_id AND b.key = w.base""")
def j11(s, d):
    known = view(s, d, "artifacts").join(view(s, d, "tasks").select("task_key", "plan_id", "pos"), "task_key")
    said = known.select("plan_id", "task_key", "art_no", F.when(F.col("art_no") % 2 == 0, F.col("name")).alias("name"), F.concat(F.lit("/home/user/"), F.coalesce(text.basename(F.col("path")), F.lit("gone.png"))).alias("path"))
    return planning.repaired_paths(said, known).select("task_key", "art_no", "path")


@query("J12_datasets_by_name", f"WITH w AS ({WANTED.format('lineitem')}), u AS (SELECT 'data ' || s_suppkey || '.csv' AS filename, s_suppkey AS id FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'data ' || s_suppkey || '.csv', s_suppkey + 1000 FROM supplier) SELECT w.task_key, w.n, f.id FROM w JOIN (SELECT filename, min(id) AS id FROM u GROUP BY 1) f USING (filename)")
def j12(s, d):
    sup = table(s, d, "supplier")
    name = F.concat(F.lit("data "), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("filename")
    uploaded = sup.filter("s_acctbal > 0").select(name, F.col("s_suppkey").alias("id")).unionByName(sup.select(name, (F.col("s_suppkey") + 1000).alias("id")))
    first = keyed.keep_first(uploaded, ["filename"], ["id"]).withColumnRenamed("id", "found")
    return s.sql(WANTED.format("{l}"), l=table(s, d, "lineitem")).join(first, "filename").select("task_key", "n", F.col("found").alias("id"))


@query("P13_pending_at_level", TASKS + " SELECT plan_id, pos FROM tasks WHERE level = 1 AND NOT ended")
def p13(s, d):
    return view(s, d, "tasks").filter((F.col("level") == 1) & ~F.col("ended")).select("plan_id", "pos")


@query("G17_promoted_tasks", TASKS + """, top AS (SELECT plan_id, max(CASE WHEN ended THEN level END) AS top FROM tasks GROUP BY 1) SELECT plan_id, id, level, output FROM tasks WHERE ended
  UNION ALL SELECT t.plan_id, (CASE WHEN type = 'ANALYSIS' THEN 'ana-' ELSE 'lit-' END) || (coalesce(top, -1) + 1), coalesce(top, -1) + 1, NULL FROM tasks t JOIN top USING (plan_id) WHERE NOT ended""")
def g17(s, d):
    t = view(s, d, "tasks")
    return planning.promoted(t.filter("ended"), t.filter("not ended")).select("plan_id", "id", "level", "output")


GATE = TASKS + """, m AS (SELECT conv_id AS plan_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), top AS (SELECT plan_id, max(level) AS top FROM tasks GROUP BY 1),
  c AS (SELECT t.*, n FROM tasks t JOIN m USING (plan_id) JOIN top USING (plan_id) WHERE n >= 3 AND (n = 3 OR level = top) AND trim(coalesce(output, '')) <> '')"""


@query("G22_discovery_gate", GATE + " SELECT m.plan_id, count(c.pos) > 0 AS runs, count(c.pos) AS tasks FROM m LEFT JOIN c USING (plan_id) GROUP BY 1")
def g22(s, d):
    counts = table(s, d, "conversations").filter("role = 'user'").groupBy(F.col("conv_id").alias("plan_id")).agg(F.count(F.lit(1)).alias("n"))
    t = view(s, d, "tasks")
    return planning.discovery_gate(counts, t, t.join(t.groupBy("plan_id").agg(F.max("level").alias("level")), ["plan_id", "level"], "left_semi"))


@query("A20_flags", ARTIFACTS + """, n AS (SELECT task_key, count(*) AS n FROM artifacts GROUP BY 1), d AS (SELECT o_orderkey AS task_key, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE) AS took FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' GROUP BY 1, o_orderdate) SELECT plan_id, sum(coalesce(took, 0))::BIGINT AS took, bool_or(trim(coalesce(output, '')) <> '') AS any_output, bool_or(coalesce(job_id, '') = 'N/A') AS any_error, coalesce(sum(n.n), 0)::BIGINT AS artifacts
  FROM tasks LEFT JOIN n USING (task_key) LEFT JOIN d USING (task_key) GROUP BY 1""")
def a20(s, d):
    """A task took the days from its order to the last shipment of its lines; one that has not ended has no time yet."""
    last = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_key")).agg(F.max("l_shipdate").alias("last"))
    days = table(s, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("task_key"), "o_orderdate").join(last, "task_key").select("task_key", F.datediff("last", "o_orderdate").alias("took"))
    rows = planning.with_artifacts(view(s, d, "tasks"), view(s, d, "artifacts")).join(days, "task_key", "left")
    g = rows.groupBy("plan_id").agg(
        F.sum(F.coalesce("took", F.lit(0))).alias("took"), F.bool_or(F.coalesce(F.col("output").rlike(r"\S"), F.lit(False))).alias("any_output"),
        F.bool_or(F.coalesce(F.col("job_id") == "N/A", F.lit(False))).alias("any_error"), F.flatten(F.collect_list("artifacts")).alias("all"),
    )
    return g.select("plan_id", "took", "any_output", "any_error", F.size("all").alias("artifacts"))


@query("G16_planning_context", with_views("tasks", "artifacts", "messages") + """, top AS (SELECT plan_id, max(level) AS level, max_by(objective, pos) AS objective FROM tasks GROUP BY 1),
  i AS (SELECT plan_id, string_agg('  ' || n || '. ' || output, chr(10) ORDER BY n) AS x FROM (SELECT plan_id, output, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS n FROM tasks WHERE trim(coalesce(output, '')) <> '') GROUP BY 1),
  a AS (SELECT plan_id, string_agg('  - ' || coalesce(name, 'undefined') || ' (id: ' || art_id || ') [from ' || id || ']: ' || a.type, chr(10) ORDER BY pos, art_no, art_id, coalesce(name, ''), a.type) AS x FROM tasks t JOIN artifacts a USING (task_key) WHERE t.type = 'ANALYSIS' AND ended GROUP BY 1),
  h AS (SELECT conv_id AS plan_id, 'Recent Conversation History (last ' || count(*) || ' exchanges):' || chr(10) || string_agg('User: ' || question || chr(10) || 'Assistant: ' || CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END, chr(10) || chr(10) ORDER BY turn) AS x
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM messages) WHERE n BETWEEN 2 AND 4 GROUP BY 1),
  n AS (SELECT plan_id, string_agg('  ' || n || '. [' || type || '] ' || objective, chr(10) ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS n FROM tasks WHERE NOT ended) GROUP BY 1)
  SELECT top.plan_id, concat_ws(chr(10), 'Current Iteration: ' || (level + 1), h.x, 'Current Objective (the current goal of the research, updated after each research iteration): ' || objective, 'Key Insights:' || chr(10) || i.x,
  'Available Artifacts (from completed analysis tasks):' || chr(10) || a.x, 'Suggested Next Steps (from previous iteration):' || chr(10) || n.x) AS context
  FROM top LEFT JOIN i USING (plan_id) LEFT JOIN a USING (plan_id) LEFT JOIN h USING (plan_id) LEFT JOIN n USING (plan_id)""")
def g16(s, d):
    return planning.context(view(s, d, "tasks"), view(s, d, "artifacts"), view(s, d, "messages").withColumnRenamed("conv_id", "plan_id"))


# --- progress --------------------------------------------------------------------------------------------------------
@query("P23_valid_steps", r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '[.\n]', ',', 'g'), ',')) AS x, generate_subscripts(string_split(regexp_replace(text, '[.\n]', ',', 'g'), ','), 1) AS i FROM conversations),
  c AS (SELECT conv_id, turn, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s*[-*•]+\s*', ''), '^\s*\d+[\].:)\-]?\s*', ''), '\s+', ' ', 'g'), '[.;:,]+$', '')) AS x FROM l),
  v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(x) ORDER BY i) AS r FROM c WHERE len(string_split(x, ' ')) BETWEEN 3 AND 8 AND length(x) <= 80) WHERE r = 1)
  SELECT conv_id, turn, string_agg(x, '|' ORDER BY i) AS steps FROM v GROUP BY 1, 2 HAVING count(*) BETWEEN 5 AND 15""")
def p23(s, d):
    steps = state.kept_steps(F.split(F.regexp_replace("text", r"[.\n]", ","), ","))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(steps, "|").alias("steps")).filter("steps is not null")


@query("M9_visible_count", "WITH g AS (SELECT conv_id, list(turn) AS steps, max(turn) - 3 AS shown FROM conversations GROUP BY 1) SELECT conv_id, least(len(steps), greatest(coalesce(shown, 1), 1))::BIGINT AS visible FROM g")
def m9(s, d):
    g = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("steps"), (F.max("turn") - 3).alias("shown"))
    return g.select("conv_id", state.visible_count(F.col("steps"), F.col("shown")).alias("visible"))


STEPS = "WITH g AS (SELECT user_id, event_type AS step, min(ts) AS started, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE max(ts) END AS ended FROM events GROUP BY 1, 2)"


def steps(s, d) -> DataFrame:
    """A map of steps per user: when each began and, unless it runs on, ended."""
    e = table(s, d, "events").groupBy("user_id", F.col("event_type").alias("step")).agg(F.min("ts").alias("started"), F.when(F.count(F.lit(1)) % 3 != 0, F.max("ts")).alias("ended"))
    return e.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", F.struct("started", "ended"))))).alias("steps"))


@query("Y10_steps_done", STEPS + " SELECT user_id, coalesce(string_agg(step, ',' ORDER BY step) FILTER (WHERE ended IS NOT NULL), '') AS done, min(step) FILTER (WHERE ended IS NULL) AS running FROM g GROUP BY 1")
def y10(s, d):
    done = F.map_keys(F.map_filter("steps", lambda k, v: v["ended"].isNotNull()))
    running = F.map_keys(F.map_filter("steps", lambda k, v: v["started"].isNotNull() & v["ended"].isNull()))
    return steps(s, d).select("user_id", F.array_join(done, ",").alias("done"), F.try_element_at(running, F.lit(1)).alias("running"))


@query("Y11_job_status", STEPS + " SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'failed' WHEN user_id % 3 <> 0 AND bool_and(ended IS NOT NULL) THEN 'completed' ELSE 'processing' END AS status FROM g GROUP BY 1")
def y11(s, d):
    n = F.col("user_id")
    active = F.exists(F.map_values("steps"), lambda v: v["started"].isNotNull() & v["ended"].isNull())
    return steps(s, d).select("user_id", F.when(n % 10 == 0, "failed").when((n % 3 != 0) & ~active, "completed").otherwise("processing").alias("status"))


@query("Y13_array_tests", STEPS + " SELECT user_id, bool_or(step IN ('error', 'signup')) AS any_of, bool_and(ended IS NOT NULL) AS every_ended, bool_or(step = 'view') AS has_view FROM g GROUP BY 1")
def y13(s, d):
    keys = F.map_keys("steps")
    return steps(s, d).select("user_id", F.arrays_overlap(keys, F.array(F.lit("error"), F.lit("signup"))).alias("any_of"), F.forall(F.map_values("steps"), lambda v: v["ended"].isNotNull()).alias("every_ended"), F.array_contains(keys, "view").alias("has_view"))


RUNS = """WITH r AS (SELECT user_id, max(event_id) AS root, max(ts) AS beat, CASE WHEN user_id % 4 = 0 THEN NULL ELSE max(ts) + INTERVAL 6 HOUR END AS expires, user_id % 5 <> 0 AS running FROM events GROUP BY 1),
  b AS (SELECT user_id, root, running, CASE WHEN user_id % 3 = 0 THEN NULL ELSE beat END AS beat, expires FROM r),
  z AS (SELECT *, running AND (coalesce(TIMESTAMP '2024-01-31 00:00:00' >= expires, FALSE) OR coalesce(TIMESTAMP '2024-01-31 00:00:00' > beat + INTERVAL 4 HOUR, FALSE) OR (beat IS NULL AND expires IS NULL)) AS stale FROM b)"""


def runs(s, d) -> DataFrame:
    n = F.col("user_id")
    r = table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("root"), F.max("ts").alias("ts"))
    r = r.select("user_id", "root", (n % 5 != 0).alias("running"), F.when(n % 3 != 0, F.col("ts")).alias("beat"), F.when(n % 4 != 0, F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("expires"))
    return r.withColumn("stale", state.is_stale(F.col("running"), F.col("beat"), F.col("expires"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")))


@query("D8_stale_runs", RUNS + " SELECT user_id, stale FROM z")
def d8(s, d):
    return runs(s, d).select("user_id", "stale")


@query("P25_active_runs", RUNS + " SELECT user_id, root, CASE WHEN user_id % 2 = 0 THEN 'queue' ELSE 'in-process' END AS mode FROM z WHERE running AND NOT stale AND root % 6 <> 0")
def p25(s, d):
    whole = F.when(F.col("root") % 6 != 0, F.col("root"))
    active = runs(s, d).filter(F.col("running") & ~F.col("stale")).withColumn("root", whole).withColumn("mode", F.when(F.col("user_id") % 2 == 0, "queue").otherwise("in-process"))
    return active.filter(F.col("root").isNotNull() & F.col("mode").isNotNull()).select("user_id", "root", "mode")


@query("D7_reveal", """WITH x AS (SELECT event_id, ts, user_id % 12 + 1 AS total, event_id % 4 AS shown, floor((epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) // 1000) / 60000)::BIGINT AS n FROM events)
  SELECT event_id, CASE WHEN n > 0 THEN least(total, least(total, greatest(shown, 1)) + n) ELSE least(total, greatest(shown, 1)) END AS visible, CASE WHEN n > 0 THEN epoch_us(ts) // 1000 + n * 60000 ELSE epoch_us(ts) // 1000 END AS advanced FROM x""")
def d7(s, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    n = F.floor((F.unix_millis(F.lit("2024-01-31 00:00:00").cast("timestamp")) - ms) / 60000)
    total, shown = F.col("user_id") % 12 + 1, F.least(F.col("user_id") % 12 + 1, F.greatest(F.col("event_id") % 4, F.lit(1)))
    return table(s, d, "events").select("event_id", F.least(total, shown + F.greatest(n, F.lit(0))).alias("visible"), (ms + F.greatest(n, F.lit(0)) * 60000).alias("advanced"))


# --- prompts ---------------------------------------------------------------------------------------------------------
@query("T34_prompt", "SELECT conv_id, turn, 'Use ' || text || ' $ {c} and $$' || ', not {c}; as ' || role AS prompt FROM conversations".replace("{c}", "{context}"))
def t34(s, d):
    value = F.concat(F.col("text"), F.lit(" $ $& and $$$$"))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(text.replaced_first(F.lit("Use {context}, not {context}; as "), "{context}", value), F.col("role")).alias("prompt"))


@query("T36_prompt_entries", r"""SELECT source, string_agg('### ' || doc_id || ' of ' || lang || chr(10) || 'from ' || source || chr(10) || '```' || chr(10) || regexp_replace(substr(x, 1, 2000), '`{3,}', '` ` `', 'g') || CASE WHEN length(x) > 2000 THEN chr(10) || '...' ELSE '' END || chr(10) || '```', chr(10) || chr(10) ORDER BY doc_id) AS entries
  FROM (SELECT *, replace(text, '. ', '````') AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY 1""")
def t36(s, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit("\nof "), "lang")
    rows = table(s, d, "documents").withColumn("entry", state.prompt_entry(name, F.concat(F.lit("from\r"), "source"), F.replace(F.col("text"), F.lit(". "), F.lit("````"))))
    top = keyed.top_per_group(rows.select("source", "doc_id", "entry"), "source", ["doc_id"], 3)
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda x: x["entry"]), "\n\n").alias("entries"))


TEX = r"concat('\documentclass{article}', chr(10), '\usepackage[utf8]{inputenc}', chr(10), '\usepackage[T1]{fontenc}', chr(10), '\usepackage{lmodern}', chr(10), CASE WHEN doc_id % 2 = 0 THEN '\graphicspath{{x/}}' ELSE '' END, '\begin{document}', text)"


@query("T37_xelatex", r"""SELECT doc_id, replace(replace(replace(replace(""" + TEX + r""", '\usepackage[utf8]{inputenc}', '\usepackage{fontspec}'), '\usepackage[T1]{fontenc}' || chr(10), ''), '\usepackage{lmodern}' || chr(10), ''), '\begin{document}',
  '\IfFontExistsTF{Linux Libertine O}{\setmainfont{Linux Libertine O}\setsansfont{Linux Biolinum O}}{\setmainfont{Linux Libertine}}' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '\graphicspath{{figures/}}' || chr(10) END || chr(10) || '\begin{document}') AS tex FROM documents""")
def t37(s, d):
    head = F.lit("\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage[T1]{fontenc}\n\\usepackage{lmodern}\n")
    tex = F.concat(head, F.when(F.col("doc_id") % 2 == 0, r"\graphicspath{{x/}}").otherwise(""), F.lit(r"\begin{document}"), "text")
    return table(s, d, "documents").select("doc_id", state.xelatex_preamble(tex).alias("tex"))


@query("T30_history", with_views("messages") + "SELECT conv_id, string_agg('User: ' || question || chr(10) || 'Assistant: ' || content, chr(10) ORDER BY turn) AS history FROM messages GROUP BY 1")
def t30(s, d):
    lines = F.array_compact(F.array(F.when(F.col("question") != "", F.concat(F.lit("User: "), "question")), F.when(F.col("content") != "", F.concat(F.lit("Assistant: "), "content"))))
    g = view(s, d, "messages").select("conv_id", "turn", lines.alias("lines")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lines"))).alias("m"))
    return g.select("conv_id", F.array_join(F.flatten(F.transform("m", lambda x: x["lines"])), "\n").alias("history"))
