"""Entities of the domain as views over the given tables, and the same views as SQL common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per model call: events, with provider and model by event_id."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "chat").when(F.col("event_type") == "purchase", "paper-generation").otherwise("deep-research")
    paper = F.col("event_type") == "purchase"
    slot = F.col("event_id") % 5
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (slot + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), kind.alias("type"),
        F.when(~paper, F.col("event_id")).alias("message_id"), F.when(paper, F.col("event_id")).alias("paper_id"),
        pick("anthropic", "anthropic", "google", "openai", "misc").alias("provider"),
        pick("claude-OPUS-4", "claude-sonnet-4", "gemini-2.5-pro", "gpt-5", "other").alias("model"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("prompt_tokens"),
        (F.get_json_object("props", "$.k").cast("bigint") * 10).alias("completion_tokens"),
        F.col("ts").alias("created_at"),
    )


def owners(spark: SparkSession, sf_dir: str, paper: bool) -> DataFrame:
    """messages (message_id, user_id), or papers (paper_id, user_id); one message in eleven has lost its owner."""
    e = table(spark, sf_dir, "events").filter((F.col("event_type") == "purchase") if paper else (F.col("event_type") != "purchase"))
    return e.filter(F.col("event_id") % 11 != 0).select(F.col("event_id").alias("paper_id" if paper else "message_id"), "user_id")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment per order; cents keep amounts exact."""
    status = F.create_map(*[F.lit(x) for x in ("F", "failed", "O", "settled", "P", "verified")])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        status[F.col("o_orderstatus")].alias("payment_status"), F.col("o_orderdate").alias("created_at"),
    )


TOKEN_USAGE = """token_usage AS (
  SELECT event_id AS id, event_type,
         CASE WHEN event_type IN ('click', 'view') THEN 'chat' WHEN event_type = 'purchase' THEN 'paper-generation' ELSE 'deep-research' END AS type,
         CASE WHEN event_type <> 'purchase' THEN event_id END AS message_id, CASE WHEN event_type = 'purchase' THEN event_id END AS paper_id,
         CASE event_id % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' WHEN 3 THEN 'openai' ELSE 'misc' END AS provider,
         CASE event_id % 5 WHEN 0 THEN 'claude-OPUS-4' WHEN 1 THEN 'claude-sonnet-4' WHEN 2 THEN 'gemini-2.5-pro' WHEN 3 THEN 'gpt-5' ELSE 'other' END AS model,
         floor(value * 1000)::BIGINT AS prompt_tokens, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT * 10 AS completion_tokens, ts AS created_at
  FROM events),
messages AS (SELECT event_id AS message_id, user_id FROM events WHERE event_type <> 'purchase' AND event_id % 11 <> 0),
papers AS (SELECT event_id AS paper_id, user_id FROM events WHERE event_type = 'purchase' AND event_id % 11 <> 0),
priced AS (SELECT *,
  CASE WHEN model ILIKE '%opus%' THEN 500 WHEN model ILIKE '%sonnet%' THEN 300 WHEN model ILIKE '%gemini-2.5-pro%' AND prompt_tokens > 200000 THEN 250
       WHEN model ILIKE '%gemini-2.5-pro%' THEN 125 WHEN model ILIKE '%gpt-5%' THEN 175 ELSE 100 END AS in_cents,
  CASE WHEN model ILIKE '%opus%' THEN 2500 WHEN model ILIKE '%sonnet%' THEN 1500 WHEN model ILIKE '%gemini-2.5-pro%' AND prompt_tokens > 200000 THEN 1500
       WHEN model ILIKE '%gemini-2.5-pro%' THEN 1000 WHEN model ILIKE '%gpt-5%' THEN 1400 ELSE 300 END AS out_cents FROM token_usage),
cost AS (SELECT *, prompt_tokens * in_cents + completion_tokens * out_cents AS units FROM priced),
owned AS (SELECT cost.*, coalesce(m.user_id, p.user_id) AS user_id FROM cost LEFT JOIN messages m USING (message_id) LEFT JOIN papers p ON cost.paper_id = p.paper_id)
"""

PAYMENTS = """payments AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, round(o_totalprice * 100)::BIGINT AS cents,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'settled' WHEN 'P' THEN 'verified' END AS payment_status, o_orderdate AS created_at FROM orders)
"""


# Views in SQL that Spark and DuckDB read alike: {table} stands for a given table.
VIEWS = {
    # a page as a line that cites it: numbered, as a Markdown link, after its title, or bare; and what the title of the search result was
    "cited": """SELECT page_id, url, title, CASE page_id % 4 WHEN 0 THEN '[' || (page_id % 9 + 1) || '] ' || title || '. Journal. ' || url WHEN 1 THEN 'See [' || title || '](' || url || ').'
        WHEN 2 THEN '3. ' || title || ', ' || url ELSE url END AS line, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'www.' || regexp_extract(url, '//([^/]*)', 1) || '/x' ELSE title END AS shown
        FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}) t""",
    # a page's report: its title as a heading, its first paragraph, and references with all kinds of identifiers, some of them repeated
    "reports": """SELECT page_id, '# ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || chr(10) || regexp_extract(html, '<p>([^<]*)', 1) || chr(10) || '## References' || chr(10) || 'See ' || url || ', ' || url || '#top' || chr(10) ||
        CASE page_id % 10 WHEN 0 THEN 'https://doi.org/10.1234/ABC_' || (page_id % 50) || '. and 10.5555/xyz-' || (page_id % 30) || ';' WHEN 1 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/pmc' || (page_id % 40) || '/)'
        WHEN 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (page_id % 40) || '/' WHEN 3 THEN 'https://clinicaltrials.gov/study/nct' || (page_id % 40) WHEN 4 THEN 'https://arxiv.org/abs/2401.' || (page_id % 40) || 'v2'
        WHEN 5 THEN 'https://www.biorxiv.org/content/10.1101/2024.' || (page_id % 40) || 'v1' WHEN 6 THEN 'https://www.uniprot.org/uniprotkb/p' || (page_id % 40) || '/entry' WHEN 7 THEN 'https://pubchem.ncbi.nlm.nih.gov/compound/' || (page_id % 40)
        WHEN 8 THEN 'https://CDN.x.org/a.js https://x.org/f.EOT?v=1 https://fonts.googleapis.com/css2' ELSE '10.4321/q_' || (page_id % 20) || ', https://doi.org/10.4321/q_' || (page_id % 20) END AS body FROM {pages}""",
    "tasks": """SELECT plan_id, CAST(pos AS INT) AS pos, (CASE WHEN type = 'ANALYSIS' THEN 'ana-' ELSE 'lit-' END) || CAST(floor(pos / 2) AS INT) AS id, job_id, type, CAST(floor(pos / 2) AS INT) AS level, ended, output, objective, o_orderkey AS task_key
        FROM (SELECT o_custkey AS plan_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'job-' || o_orderkey END AS job_id,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ANALYSIS' ELSE 'LITERATURE' END AS type, o_orderstatus <> 'O' AS ended, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN '  ' ELSE 'Found ' || o_orderpriority || ' in ' || o_orderkey END AS output,
        'Look at ' || o_orderpriority || ' of ' || o_custkey AS objective FROM {orders}) t""",
    "artifacts": """SELECT task_key, art_no, art_id, name, CASE WHEN art_no % 6 = 0 THEN NULL ELSE 'runs/' || task_key || '/' || coalesce(name, 'raw_' || l_suppkey || '.PNG') END AS path, type FROM (
        SELECT l_orderkey AS task_key, art_no, l_suppkey, 'art-' || l_orderkey || '-' || art_no AS art_id, CASE l_returnflag WHEN 'R' THEN 'fig_' || l_suppkey || '.png' WHEN 'A' THEN 'table_' || l_suppkey || '.csv' END AS name,
        CASE WHEN l_linestatus = 'F' THEN 'FILE' ELSE 'FOLDER' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS art_no FROM {lineitem}) u) t""",
    # what a plan's discoveries cite: jobs, tasks, placeholders and jobs of no plan
    "evidence": """SELECT plan_id, CAST(pos % 3 AS INT) AS discovery, pos, CASE pos % 5 WHEN 1 THEN id WHEN 3 THEN 'job-of-nobody' ELSE coalesce(job_id, id) END AS cited FROM {tasks}""",
    # a discovery's own job: valid, a placeholder or none; the last of a plan has no evidence
    "discoveries": """SELECT plan_id, discovery, CASE pos % 4 WHEN 0 THEN own WHEN 1 THEN 'undefined' WHEN 2 THEN '' END AS job_id FROM (SELECT plan_id, CAST(pos % 3 AS INT) AS discovery, min(pos) AS pos, max(job_id) AS own FROM {tasks} GROUP BY 1, 2) d
        UNION ALL SELECT plan_id, 9, CASE plan_id % 3 WHEN 0 THEN max(job_id) WHEN 1 THEN 'N/A' END FROM {tasks} GROUP BY plan_id""",
    "messages": """SELECT q.conv_id, q.turn, q.text AS question, a.text AS content FROM {conversations} q JOIN {conversations} a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""",
    "files": """SELECT page_id, regexp_extract(url, '([^/?#]*)[^/]*$', 1) || CASE page_id % 12 WHEN 0 THEN '.csv' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.PNG' WHEN 4 THEN '.md' WHEN 5 THEN '.bin' WHEN 6 THEN '.docx' WHEN 7 THEN '.gif' WHEN 8 THEN '.json' WHEN 9 THEN '.txt'
        WHEN 10 THEN '.jpeg' ELSE '' END AS name, CASE page_id % 7 WHEN 0 THEN 'text/csv; charset=utf-8' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
        CAST(length(html) AS BIGINT) * 1000 AS size FROM {pages}""",
}


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view of VIEWS over the given tables. given: views that are there already, such as a written one that several others read."""
    used = set(re.findall(r"{(\w+)}", VIEWS[name]))
    frames = {t: given[t] if t in given else view(spark, sf_dir, t, **given) if t in VIEWS else table(spark, sf_dir, t) for t in used}
    return spark.sql(VIEWS[name], **frames)


def with_views(*names: str) -> str:
    """The same views as SQL common table expressions."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for t in re.findall(r"{(\w+)}", VIEWS[name]):
            if t in VIEWS:
                add(t)
        out.setdefault(name, f"{name} AS ({re.sub(r'{(\w+)}', lambda m: m[1], VIEWS[name])})")

    for n in names:
        add(n)
    return "WITH " + ", ".join(out.values()) + " "
