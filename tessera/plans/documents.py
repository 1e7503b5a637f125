"""Queries over texts, JSON and references: readers' dispatch, citations, sections, BibTeX, nested state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import references, text
from tessera.operators import keyed
from tessera.sources.bindings import table

from .catalog import HTML_TEXT, query, text_query


# --- readers ---------------------------------------------------------------------------------------------------------
@query("S22_pending_scan", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT < 5 AND event_type IN ('view', 'click')")
def s22(s, d):
    return table(s, d, "events").filter((F.get_json_object("props", "$.k").cast("int") < 5) & F.col("event_type").isin("view", "click")).select("event_id")


@query("S11_text_reader", "SELECT doc_id, strlen(text)::INT AS bytes, length(text)::INT AS chars FROM documents")
def s11(s, d):
    return table(s, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))


# --- JSON ------------------------------------------------------------------------------------------------------------
ANSWER = """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'So:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'It is ' || props || ', I think' WHEN 3 THEN '```JSON ' || props || chr(10) || '```'
  WHEN 4 THEN '``` ' || props || ' ```' ELSE 'nothing' END AS answer FROM events) """
UNFENCED = [rf"regexp_replace(regexp_replace(trim(answer), '(?i)^```{kind}\s*', ''), '\s*```$', '')" for kind in ("json", "")]
TRIES = [("direct", "trim(answer)"), ("json_fence", UNFENCED[0]), ("fence", UNFENCED[1]), ("braces", r"regexp_extract(answer, '(?s)(\{.*\})', 1)")]


def answers(s, d):
    """Model answers: the JSON as such, fenced (also behind other text), within a sentence, or none."""
    n, p = F.col("event_id") % 6, F.col("props")
    fenced = F.concat(F.lit("So:\n```json\n"), p, F.lit("\n```"))
    answer = F.when(n == 0, p).when(n == 1, fenced).when(n == 2, F.concat(F.lit("It is "), p, F.lit(", I think"))).when(n == 3, F.concat(F.lit("```JSON "), p, F.lit("\n```"))).when(n == 4, F.concat(F.lit("``` "), p, F.lit(" ```"))).otherwise("nothing")
    return table(s, d, "events").select("event_id", answer.alias("answer"))


@query("Y5_lenient_json", ANSWER + "SELECT event_id, CASE " + " ".join(f"WHEN json_valid({x}) AND {x} <> '' THEN '{n}'" for n, x in TRIES) + " ELSE 'none' END AS strategy, CASE " + " ".join(f"WHEN json_valid({x}) AND {x} <> '' THEN json_extract_string({x}, '$.k')" for _, x in TRIES) + " END AS k FROM a")
def y5(s, d):
    strategy, found = references.lenient_json(F.col("answer"))
    return answers(s, d).select("event_id", strategy.alias("strategy"), F.get_json_object(found, "$.k").alias("k"))


@query("Y7_state_values", ANSWER + "SELECT event_id, CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.k') END AS k FROM a")
def y7(s, d):
    state = F.coalesce(F.try_parse_json("answer"), F.parse_json(F.lit("{}")))
    return answers(s, d).select("event_id", F.try_variant_get(state, "$.k", "string").alias("k"))


@query("Y1_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def y1(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("Y9_shallow_merge", """SELECT event_id, CASE event_type WHEN 'error' THEN lag(event_type) OVER w ELSE event_type END AS kind, CASE event_type WHEN 'view' THEN lag(json_extract_string(props, '$.k')) OVER w ELSE json_extract_string(props, '$.k') END AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def y9(s, d):
    """Stored is the map of the user's event before; an error brings no kind, a view no k."""
    own = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    brings = lambda key, v: ~((F.col("event_type") == "error") & (key == "kind")) & ~((F.col("event_type") == "view") & (key == "k"))
    before = F.coalesce(F.lag(own).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.create_map().cast("map<string,string>"))
    e = table(s, d, "events").select("event_id", before.alias("stored"), F.map_filter(own, brings).alias("new"))
    return e.select("event_id", references.merged(F.col("stored"), F.col("new")).alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["k"].alias("k"))


@query("Y14_enumerated_answers", "SELECT conv_id, string_agg('Q' || n || ': ' || text, chr(10) ORDER BY n) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'user') GROUP BY 1")
def y14(s, d):
    asked = table(s, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    return asked.select("conv_id", F.array_join(F.transform("q", lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x["text"])), "\n").alias("listed"))


# --- citations and Markdown ------------------------------------------------------------------------------------------
# a page's line with citations of its own address, of one that repeats within it, and of none
MARKED = r"""WITH m AS (SELECT page_id, '[' || regexp_extract(html, '<title>([^<]*)</title>', 1) || ']{' || url || ', https://x.org/' || (page_id % 7) || '} and []{} ' || """ + HTML_TEXT + r""" || ' [none]{ , } then [beta]{https://x.org/' || (page_id % 7) || '}.' AS line FROM pages),
  a AS (SELECT page_id, unnest(regexp_extract_all(line, '\[([^\]]*)\]\{([^\}]*)\}', 1)) AS cited, unnest(regexp_extract_all(line, '\[([^\]]*)\]\{([^\}]*)\}', 2)) AS listed, generate_subscripts(regexp_extract_all(line, '\[([^\]]*)\]\{([^\}]*)\}', 1), 1) AS i FROM m),
  u AS (SELECT *, list_filter(list_transform(string_split(listed, ','), lambda x: trim(x)), lambda x: x <> '') AS urls FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS index FROM u WHERE len(urls) > 0) """


def marked_lines(s, d):
    x = F.concat(F.lit("https://x.org/"), (F.col("page_id") % 7).cast("string"))
    title, first = F.regexp_extract("html", "<title>([^<]*)</title>", 1), text.html_text(F.col("html"))
    line = F.concat(F.lit("["), title, F.lit("]{"), "url", F.lit(", "), x, F.lit("} and []{} "), first, F.lit(" [none]{ , } then [beta]{"), x, F.lit("}."))
    return table(s, d, "pages").select("page_id", line.alias("line"))


@query("G4_inline_citations", MARKED + "SELECT page_id, index, cited, len(urls) AS urls FROM c")
def g4(s, d):
    return marked_lines(s, d).select("page_id", F.inline(references.citations(F.col("line")))).select("page_id", "index", "cited", F.size("urls").alias("urls"))


@query("G4_cleaned_text", MARKED + r"SELECT page_id, regexp_replace(line, '\[([^\]]*)\]\{([^\}]*)\}', '\1', 'g') AS cleaned FROM m")
def g4_text(s, d):
    return marked_lines(s, d).select("page_id", references.without_citations(F.col("line")).alias("cleaned"))


@query("A12_citation_indices", MARKED + ", x AS (SELECT page_id, index, unnest(urls) AS url FROM c) SELECT page_id, url, string_agg(index::VARCHAR, ',' ORDER BY index) AS indices FROM x GROUP BY 1, 2")
def a12(s, d):
    c = marked_lines(s, d).select("page_id", F.inline(references.citations(F.col("line")))).select("page_id", "index", F.explode("urls").alias("url"))
    return c.groupBy("page_id", "url").agg(F.array_join(F.array_sort(F.collect_list("index")), ",").alias("indices"))


# words of a page's text as citation keys: the first one known, the second not
KEYED = r"""WITH h AS (SELECT page_id, """ + HTML_TEXT + r""" AS p FROM pages), w AS (SELECT page_id, regexp_extract_all(p, '[A-Za-z]+') AS w, p FROM h), k AS (SELECT page_id, coalesce(w[1], 'a') AS a, coalesce(w[2], 'b') AS b, p FROM w) """


@query("G7_unknown_citations", KEYED + "SELECT page_id, 'A [@' || a || '] b ' || CASE WHEN b = a THEN '[-@' || a || '; see p. 3; @' || a || ']' ELSE '[-@' || a || '; see p. 3]' END || ' c ' || CASE WHEN b = a THEN '[@' || a || ']' ELSE '' END || ' ' || replace(p, '@', '') AS kept FROM k")
def g7(s, d):
    words = F.regexp_extract_all("p", F.lit("[A-Za-z]+"), F.lit(0))
    rows = table(s, d, "pages").select("page_id", text.html_text(F.col("html")).alias("p")).select("page_id", F.coalesce(F.get(words, F.lit(0)), F.lit("a")).alias("a"), F.coalesce(F.get(words, F.lit(1)), F.lit("b")).alias("b"), F.replace("p", F.lit("@"), F.lit("")).alias("p"))
    line = F.concat(F.lit("A [@"), "a", F.lit("] b [-@"), "a", F.lit("; see p. 3; @"), "b", F.lit("] c [@"), "b", F.lit("] "), "p")
    return rows.select("page_id", references.known_citations(line, F.array("a")).alias("kept"))


SECTIONED = "SELECT doc_id, '# One' || chr(10) || text || chr(10) || '## ' || source || chr(10) || substr(text, 1, CAST(doc_id % 40 AS INT)) || chr(10) || '#### deep' || chr(10) || '### Last' AS md FROM {0}"


@query("G9_short_sections", f"WITH m AS ({SECTIONED.format('documents')})" + r""", p AS (SELECT doc_id, string_split_regex(md, '(?m)^#{1,3}[ \t]+[^\n]+') AS b, regexp_extract_all(md, '(?m)^#{1,3}[ \t]+([^\n]+)$', 1) AS h FROM m), x AS (SELECT doc_id, unnest(h) AS title, unnest(b[2:]) AS body FROM p)
  SELECT doc_id, title, length(trim(body, ' ' || chr(10) || chr(9)))::INT AS length FROM x WHERE length(trim(body, ' ' || chr(10) || chr(9))) < 20""")
def g9(s, d):
    md = table(s, d, "documents").selectExpr(*SECTIONED.removeprefix("SELECT ").removesuffix(" FROM {0}").split(", ", 1))
    return md.select("doc_id", F.inline(references.sections(F.col("md")))).filter(F.col("length") < 20)


@query("G13_cite_tags", r"""WITH t AS (SELECT conv_id, turn, 'So <cite index="' || (turn + 1) || '-1,' || length(text) || '-2,x,1">' || replace(text, '<', '') || '</cite> <cite index="2">' || role || '</cite>.' AS line FROM conversations)
  SELECT conv_id, turn, regexp_replace(line, '<cite index="([^"]+)">([^<]+)</cite>', '\2', 'g') AS cleaned, (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM (SELECT DISTINCT unnest(list_filter(list_transform(string_split(array_to_string(regexp_extract_all(line, '<cite index="([^"]+)">([^<]+)</cite>', 1), ','), ','), lambda p: try_cast(split_part(p, '-', 1) AS INT) - 1), lambda p: p IS NOT NULL)) AS i)) AS indices FROM t""")
def g13(s, d):
    line = F.concat(F.lit('So <cite index="'), (F.col("turn") + 1).cast("string"), F.lit("-1,"), F.length("text").cast("string"), F.lit('-2,x,1">'), F.replace("text", F.lit("<"), F.lit("")), F.lit('</cite> <cite index="2">'), "role", F.lit("</cite>."))
    rows = table(s, d, "conversations")
    return rows.select("conv_id", "turn", references.without_cite_tags(line).alias("cleaned"), F.array_join(references.cite_tag_indices(line), ",").alias("indices"))


@query("G12_annotation_offsets", "SELECT conv_id, turn, role, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(text))::BIGINT AS start FROM conversations")
def g12(s, d):
    before = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    return table(s, d, "conversations").select("conv_id", "turn", "role", (before - F.length("text")).alias("start"))


@query("G20_knowledge_format", "SELECT source, string_agg(doc_id || chr(10) || substr(text, 1, 300) || '...', chr(10) || chr(10) ORDER BY doc_id) AS formatted FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY 1")
def g20(s, d):
    top = keyed.top_per_group(table(s, d, "documents").select("source", "doc_id", F.substring("text", 1, 300).alias("head")), "source", ["doc_id"], 5)
    part = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "head"))), lambda x: F.concat(x["doc_id"].cast("string"), F.lit("\n"), x["head"], F.lit("...")))
    return top.groupBy("source").agg(F.array_join(part, "\n\n").alias("formatted"))


@query("G21_continuation", "SELECT event_id, CASE WHEN value < 10 THEN 'stop' WHEN event_type = 'error' THEN 'stop' WHEN event_type = 'purchase' THEN 'go' WHEN event_id % 5 = 0 THEN 'go' ELSE 'score' END AS policy FROM events")
def g21(s, d):
    kind = F.col("event_type")
    return table(s, d, "events").select("event_id", references.continuation(F.col("value") >= 10, kind == "error", kind == "purchase", F.col("event_id") % 5 + 1).alias("policy"))


# --- BibTeX ----------------------------------------------------------------------------------------------------------
def entries(s, d):
    n = F.col("p_partkey").cast("string")
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("@article{old"), n, F.lit(",\n  title = {A_"), "p_name", F.lit("},\n  doi = {10.1234/x_"), n, F.lit("}\n}")).alias("bib"))


@query("T23_rewrite_citekey", r"SELECT p_partkey, 'old' || p_partkey AS citekey, '10.1234/x_' || p_partkey AS doi, '@article{doi_10_1234_x_' || p_partkey || ',' AS head FROM part")
def t23(s, d):
    bib = F.col("bib")
    doi = references.bib_field(bib, "doi")
    head = F.split(references.with_citekey(bib, text.doi_citekey(doi)), "\n")[0]
    return entries(s, d).select("p_partkey", references.bib_citekey(bib).alias("citekey"), doi.alias("doi"), head.alias("head"))


@query("T22_escape_underscores", r"SELECT p_partkey, '@article{old' || p_partkey || ',' || chr(10) || '  title = {' || replace('A_' || p_name, '_', '\_') || '},' || chr(10) || '  doi = {10.1234/x_' || p_partkey || '}' || chr(10) || '}' AS bib FROM part")
def t22(s, d):
    return entries(s, d).select("p_partkey", references.escaped_fields(F.col("bib")).alias("bib"))


text_query("T33_last_lines", "documents", "doc_id", "text", lambda x: references.last_lines(x, 3), "array_to_string(list_slice(string_split(text, chr(10)), -3, -1), chr(10))")
text_query("T18_url_end", "pages", "page_id", "url", lambda x: F.regexp_replace(F.concat(x, F.lit(").")), r"[.,;:)>\]]+$", ""), r"regexp_replace(url || ').', '[.,;:)>\]]+$', '')")
text_query("M8_retry_wait", "part", "p_partkey", "p_size", lambda x: F.least(F.lit(40000), 4000 * F.pow(F.lit(2), x % 10)).cast("bigint"), "least(40000, 4000 * pow(2, p_size % 10))::BIGINT")
text_query("P19_job_id", "part", "p_partkey", "p_name", lambda x: ~text.trim(x).isin("N/A", "undefined", "null", ""), "trim(p_name) NOT IN ('N/A', 'undefined', 'null', '')")
text_query("T29_summary", "documents", "doc_id", "text", references.summary, "substr(text, 1, 300) || '...'")
