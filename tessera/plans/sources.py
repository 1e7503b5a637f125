"""Queries of files and readers: dispatch, previews, limits, front matter, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money, references, state, text
from tessera.sources import readers
from tessera.sources.bindings import table, view, with_views

from .catalog import HTML_TEXT, query

FILES = with_views("files")
LOW = "lower(trim(mime))"
IMAGE = r"regexp_matches(lower(name), '\.(png|jpg|jpeg|webp|gif)$')"
PARSER = f"""CASE WHEN found IS NOT NULL AND (contains(mime, 'image') OR {IMAGE}) THEN 'image' ELSE found END"""
FOUND = f"""(CASE WHEN {LOW} SIMILAR TO '.*(spreadsheet|excel|vnd.openxmlformats|vnd.ms-excel).*' THEN 'excel' WHEN contains({LOW}, 'csv') THEN 'csv' WHEN contains({LOW}, 'markdown') THEN 'markdown' WHEN contains({LOW}, 'json') THEN 'json' WHEN contains({LOW}, 'text/plain') THEN 'text'
  WHEN contains({LOW}, 'pdf') THEN 'pdf' WHEN regexp_matches({LOW}, 'image/(png|jpeg|jpg|webp)') THEN 'image' WHEN name ILIKE '%.xlsx' OR name ILIKE '%.xls' THEN 'excel' WHEN name ILIKE '%.csv' THEN 'csv' WHEN name ILIKE '%.md' THEN 'markdown' WHEN name ILIKE '%.json' THEN 'json'
  WHEN name ILIKE '%.txt' THEN 'text' WHEN name ILIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(name), '\\.(png|jpg|jpeg|webp)$') THEN 'image' END)"""
PARSED = FILES + f", p AS (SELECT *, {FOUND} AS found FROM files), q AS (SELECT *, {PARSER} AS parser FROM p)"


def files(s, d):
    """A file per page, with a name and a MIME type by page_id and a size by its html."""
    return view(s, d, "files").withColumn("parser", references.parser_of(F.col("name"), F.col("mime")))


@query("S15_parser_dispatch", PARSED + " SELECT page_id, parser FROM q")
def s15(s, d):
    return files(s, d).select("page_id", "parser")


@query("S16_preview_dispatch", FILES + r""", e AS (SELECT *, lower(list_extract(string_split(name, '.'), -1)) AS ext FROM files) SELECT page_id, CASE WHEN starts_with(mime, 'text/') OR ext IN ('csv', 'json', 'md', 'txt') THEN 'text' WHEN ext IN ('xlsx', 'xls') THEN 'excel' WHEN ext = 'pdf' OR mime = 'application/pdf' THEN 'pdf' WHEN starts_with(mime, 'image/') THEN 'image' ELSE 'text' END AS preview FROM e""")
def s16(s, d):
    return files(s, d).select("page_id", references.preview_of(F.col("name"), F.col("mime")).alias("preview"))


@query("S17_byte_range", PARSED + " SELECT page_id, least(size, CASE WHEN parser IN ('pdf', 'image', 'excel') THEN 52428800 WHEN parser IS NOT NULL THEN 10485760 ELSE 4096 END)::BIGINT AS bytes FROM q")
def s17(s, d):
    return files(s, d).select("page_id", F.least("size", references.range_limit(F.col("parser"))).alias("bytes"))


@query("S6_unsupported_dropped", FILES + " SELECT page_id FROM files WHERE name ILIKE '%.md' OR name ILIKE '%.docx' OR name ILIKE '%.pdf'")
def s6(s, d):
    return files(s, d).filter(references.matches_ending(F.col("name"), references.KNOWLEDGE_ENDINGS)).select("page_id")


@query("T14_mime_matches", FILES + r" SELECT page_id, contains(lower(mime), 'csv') OR contains(lower(mime), 'text/csv') AS by_mime, regexp_matches(lower(name), '\.(png|jpg|jpeg|webp)$') AS by_name FROM files")
def t14(s, d):
    return files(s, d).select("page_id", references.matches_mime(F.col("mime"), ["text/csv", "csv"]).alias("by_mime"), references.matches_ending(F.col("name"), [".png", ".jpg", ".jpeg", ".webp"]).alias("by_name"))


@query("T32_mime", FILES + """ SELECT page_id, CASE lower(list_extract(string_split(name, '.'), -1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'csv' THEN 'text/csv' WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 'xls' THEN 'application/vnd.ms-excel'
  WHEN 'txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' WHEN 'md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime FROM files""")
def t32(s, d):
    return files(s, d).select("page_id", references.mime_of(F.col("name")).alias("mime"))


@query("P20_size_limit", FILES + " SELECT page_id, size FROM files WHERE size <= 4 * 1048576")
def p20(s, d):
    return files(s, d).filter(F.col("size") <= money.mb_bytes(F.lit(4))).select("page_id", "size")


@query("A21_attached_size", FILES + ", g AS (SELECT page_id % 10 AS message, CASE WHEN page_id % 4 = 0 THEN NULL ELSE size END AS size FROM files) SELECT message, sum(coalesce(size, 0))::BIGINT AS size FROM g GROUP BY 1")
def a21(s, d):
    rows = files(s, d).select((F.col("page_id") % 10).alias("message"), F.when(F.col("page_id") % 4 != 0, F.col("size")).alias("size"))
    return rows.groupBy("message").agg(F.sum(F.coalesce("size", F.lit(0))).alias("size"))


# a document as a Markdown file whose front matter overrides its type, and names its source twice: the last one counts
MATTER = "'---' || chr(10) || 'title: ' || source || chr(10) || 'type: note' || chr(10) || 'source: \"old\"' || chr(10) || 'source: ' || lang || chr(10) || '---' || chr(10) || text"


@query("S3_front_matter", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'md' ELSE 'note' END AS type, CASE WHEN doc_id % 3 > 0 THEN lang END AS source, trim(text, ' ' || chr(10)) AS content FROM documents")
def s3(s, d):
    docs = table(s, d, "documents").selectExpr("doc_id", f"CASE WHEN doc_id % 3 = 0 THEN text ELSE {MATTER} END AS raw")
    return readers.with_front_matter(docs, F.create_map(F.lit("type"), F.lit("md"))).select("doc_id", F.col("metadata")["type"].alias("type"), F.col("metadata")["source"].alias("source"), "content")


@query("S7_csv_reader", "SELECT c_custkey::VARCHAR || ', ' || c_name || ', ' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS line FROM customer UNION ALL SELECT 'c_custkey, c_name, c_mktsegment'")
def s7(s, d):
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    folder = readers.scratch(s)
    rows.write.option("header", True).csv(folder)
    return readers.csv_lines(readers.strict_csv(s, folder))


@query("S10_json_reader", """WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || event_id || ', 2]' WHEN 2 THEN '"' || event_type || '"' ELSE event_id::VARCHAR END AS x FROM events)
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' ELSE 'number' END AS type, CASE event_id % 4 WHEN 0 THEN '{' || chr(10) || '  "k": ' || json_extract_string(x, '$.k') || chr(10) || '}' WHEN 1 THEN '[' || chr(10) || '  ' || event_id || ',' || chr(10) || '  2' || chr(10) || ']' ELSE x END AS text FROM j""")
def s10(s, d):
    raw = table(s, d, "events").selectExpr("event_id", """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || event_id || ', 2]' WHEN 2 THEN '"' || event_type || '"' ELSE CAST(event_id AS STRING) END AS x""")
    return raw.select("event_id", readers.json_kind(F.col("x")).alias("type"), readers.indented_json(F.col("x")).alias("text"))


@query("S2_recursive_scan")
def s2(s, d):
    """Files below a folder, its subfolders included: here the documents themselves, written as text by language and source."""
    folder = readers.scratch(s)
    table(s, d, "documents").filter("text is not null").select("lang", "source", F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.partitionBy("lang", "source").text(folder)
    return readers.scanned(s, folder, "*.txt").select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.octet_length("content").alias("bytes"))


@query("G24_link_parts", with_views("cited") + r""" SELECT page_id, i, type, content FROM (SELECT page_id, 1 AS i, 'text' AS type, regexp_extract(line, '^(.*?)\[[^\]]+\]\([^)]+\)', 1) AS content FROM cited WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 2, 'link', regexp_extract(line, '\[([^\]]+)\]\([^)]+\)', 1) FROM cited WHERE page_id % 4 = 1
  UNION ALL SELECT page_id, 3, 'text', regexp_extract(line, '\[[^\]]+\]\([^)]+\)(.*)$', 1) FROM cited WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 1, 'text', line FROM cited WHERE page_id % 4 <> 1)""")
def g24(s, d):
    return view(s, d, "cited").select("page_id", F.posexplode(references.link_parts(F.col("line"))).alias("i", "p")).select("page_id", (F.col("i") + 1).alias("i"), "p.type", "p.content")


@query("G15_enriched_messages", """WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1), p AS (SELECT page_id, url, 'Read ' || url || '! and https://gone.example/' || page_id || '.' AS asked, html FROM pages), c AS (SELECT l.conv_id, l.turn, p.* FROM l JOIN p ON p.page_id = l.conv_id)
  SELECT conv_id, turn, 'Here is the content of the page ' || url || ' that the user referenced. If it is related to the question, feel free to integrate it in the answer:' || chr(10) || chr(10) || substr(__HTML__, 1, 4000) || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  'Content of the page https://gone.example/' || page_id || ' wasn''t able to be read, but I can search the internet for other results.' AS added FROM c""".replace("__HTML__", HTML_TEXT))
def g15(s, d):
    last = table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    pages = table(s, d, "pages")
    asked = F.concat(F.lit("Read "), "url", F.lit("! and https://gone.example/"), F.col("page_id").cast("string"), F.lit("."))
    messages = last.join(pages.select(F.col("page_id").alias("conv_id"), asked.alias("text")), "conv_id")
    return readers.enriched(messages, pages.select(F.col("page_id").alias("conv_id"), "url", F.substring(text.html_text(F.col("html")), 1, 4000).alias("content"))).select("conv_id", "turn", "added")
