"""Queries of references and bibliographies: titles, citekeys, entries, joins of references to entries and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import references, text
from tessera.operators import keyed
from tessera.sources.bindings import table, view, with_views

from .catalog import query

CITED = with_views("cited")
HOST = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
LAST = "list_extract(list_filter(string_split(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> ''), -1)"
FALLBACK = f"(CASE WHEN {LAST.format('url')} IS NULL THEN {HOST.format('url')} ELSE {HOST.format('url')} || ' - ' || {LAST.format('url')} END)"


def cut_title(x: str) -> str:
    """SQL of a title of at most 120 characters."""
    head = f"substr({x}, 1, 120)"
    last = lambda mark: f"(CASE WHEN contains({head}, '{mark}') THEN 120 - strpos(reverse({head}), '{mark[::-1]}') - {len(mark)} + 1 ELSE -1 END)"
    cuts = " ".join(f"WHEN {last(m)} > 30 THEN substr({x}, 1, {last(m)})" for m in (". ", ", ", " "))
    return f"(CASE WHEN length({x}) <= 120 THEN {x} {cuts} ELSE {head} END)"


def of(name: str, source: str, key: str, run, sql: str):
    """A query that gives one value of each row of a view."""
    @query(name, with_views(source) + f"SELECT {key}, {sql} AS value FROM {source}")
    def go(s, d):
        return view(s, d, source).select(key, run().alias("value"))


@query("T7_truncate_title", f"SELECT doc_id, {cut_title('text')} AS value FROM documents")
def t7(s, d):
    return table(s, d, "documents").select("doc_id", text.truncated_title(F.col("text")).alias("value"))


@query("T8_fallback_title", f"SELECT page_id, {FALLBACK} AS value FROM pages")
def t8(s, d):
    return table(s, d, "pages").select("page_id", text.fallback_title(F.col("url")).alias("value"))


@query("T9_line_title", CITED + rf""", p AS (SELECT *, trim(regexp_replace(regexp_extract(line, '^\s*\[?\d+\]?\s+(.+?)(?:\.\s+\w+\.\s+https?://|https?://)', 1), '\.\s*$', '')) AS numbered,
  trim(regexp_extract(line, '\[([^\]]+)\]\(' || regexp_escape(url) || '\)', 1)) AS link,
  trim(regexp_replace(trim(regexp_replace(trim(substr(line, 1, strpos(line, url) - 1)), '[\s.,:;-]+$', '')), '^\s*\[?\d+\]?\s*\.?\s*', '')) AS before FROM cited)
  SELECT page_id, CASE WHEN length(numbered) > 5 THEN {cut_title('numbered')} WHEN link <> '' THEN {cut_title('link')} WHEN length(before) > 5 THEN {cut_title('before')} ELSE {FALLBACK} END AS value FROM p""")
def t9(s, d):
    return view(s, d, "cited").select("page_id", text.line_title(F.col("line"), F.col("url")).alias("value"))


@query("T15_normal_url", r"""WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages), q AS (SELECT page_id, regexp_extract(bare, '^([^?]*)', 1) AS path, regexp_extract(bare, '\?(.*)$', 1) AS query FROM u),
  r AS (SELECT page_id, query, CASE WHEN regexp_matches(path, '^https?://[^/]+$') THEN path || '/' WHEN regexp_matches(path, '^https?://[^/]+/$') THEN path ELSE regexp_replace(path, '/$', '') END AS path FROM q)
  SELECT page_id, path || CASE WHEN query = '' THEN '' ELSE '?' || (SELECT string_agg(x, '&' ORDER BY split_part(x, '=', 1), i) FROM (SELECT unnest(string_split(query, '&')) AS x, generate_subscripts(string_split(query, '&'), 1) AS i)) END AS value FROM r""")
def t15(s, d):
    return table(s, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("value"))


HASHED = "list_reduce(list_prepend({seed}::BIGINT, list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: {step})"
SIGNED = "(({0} + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
OLD_HASH = f"lpad(lower(to_hex(abs({HASHED.format(seed=0, x='url', step=SIGNED.format('h * 31 + c'))}))), 8, '0')"
of_hash = "substr('url_' || {0}, 1, 64)"


@query("T5_simple_hash", f"SELECT page_id, {OLD_HASH} AS value FROM pages")
def t5(s, d):
    return table(s, d, "pages").select("page_id", text.simple_hash(F.col("url")).alias("value"))


def lane(seed: int) -> str:
    return f"(({HASHED.format(seed=seed, x='lower(c_name)', step='xor(' + SIGNED.format('h * 33') + ', c)')}) & 4294967295)"


@query("T6_wallet_uuid", f"""WITH l AS (SELECT c_custkey, lpad(lower(to_hex({lane(5381)})), 8, '0') AS a, lpad(lower(to_hex({lane(52711)})), 8, '0') AS b, lpad(lower(to_hex({lane(31337)})), 8, '0') AS c, lpad(lower(to_hex({lane(7919)})), 8, '0') AS e FROM customer)
  SELECT c_custkey, a || '-' || substr(b, 1, 4) || '-5' || substr(b, 6, 3) || '-' || (CASE substr(c, 1, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
  WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END) || substr(c, 2, 3) || '-' || substr(c, 5, 4) || e AS value FROM l""")
def t6(s, d):
    return table(s, d, "customer").select("c_custkey", text.wallet_uuid(F.col("c_name")).alias("value"))


of("T16_shown_title", "cited", "page_id", lambda: text.shown_title(F.col("shown")), r"CASE WHEN regexp_matches(shown, '^(https?://|www\.)') THEN 'www.' || regexp_replace(lower(regexp_extract(shown, '^(?:https?://)?([^/?#:]+)', 1)), '^www\.', '') ELSE shown END")
of("T1_normal_doi", "reports", "page_id", lambda: text.normalize_doi(F.concat(F.regexp_extract(F.col("body"), r"(10\.\d{4,}/\S+)", 1), F.lit(r"\_A\&B\%.;"))), r"""regexp_replace(replace(replace(replace(lower(regexp_extract(body, '(10\.\d{4,}/\S+)', 1) || '\_A\&B\%.;'), '\_', '_'), '\&', '&'), '\%', '%'), '[.,;:]+$', '')""")
of("P18_valid_doi", "reports", "page_id", lambda: text.is_doi(F.regexp_extract(F.col("body"), r"(10\.\d+/\S+)", 1)), r"regexp_matches(regexp_extract(body, '(10\.\d+/\S+)', 1), '^10\.\d{4,}/\S+$')")
of("U5_undefined_citations", "reports", "page_id", lambda: F.array_join(references.undefined_citations(F.regexp_replace(F.col("body"), r"(?m)([A-Za-z]+)-?(\d+)", "LaTeX Warning: Citation `$1' undefined; Warning--I didn't find a database entry for \"$2\"")), ","),
   """(SELECT coalesce(string_agg(k, ',' ORDER BY i), '') FROM (SELECT k, min(i) AS i FROM (SELECT unnest(list_zip(regexp_extract_all(body, '([A-Za-z]+)-?(\\d+)', 1), regexp_extract_all(body, '([A-Za-z]+)-?(\\d+)', 2))) AS z, generate_subscripts(regexp_extract_all(body, '([A-Za-z]+)-?(\\d+)', 1), 1) AS j),
   LATERAL (SELECT z[1] AS k, 2 * j AS i UNION ALL SELECT z[2], 2 * j + 1) GROUP BY k))""")
of("T21_entities", "reports", "page_id", lambda: text.decoded_entities(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("body"), "e", "&#233;"), "a", "&ldquo;&amp;#38;"), "t", "&#38;")), r"""replace(replace(replace(body, 't', '&#38;'), 'a', '"\' || '&#38;'), '&#38;', '\&').replace('e', 'é')""")


# --- references of a report ------------------------------------------------------------------------------------------
# URLs of each line, then its DOIs outside of URLs; what is an asset is no reference
FOUND = with_views("reports") + r""", l AS (SELECT page_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM reports),
x AS (SELECT page_id, n, 0 AS bare, unnest(regexp_extract_all(line, 'https?://[^\s,;)>\]]+')) AS raw, generate_subscripts(regexp_extract_all(line, 'https?://[^\s,;)>\]]+'), 1) AS k, line FROM l
  UNION ALL SELECT page_id, n, 1, unnest(regexp_extract_all(regexp_replace(line, 'https?://\S*', '', 'g'), '\b10\.\d{4,}/[^\s,;)>\]]+')), generate_subscripts(regexp_extract_all(regexp_replace(line, 'https?://\S*', '', 'g'), '\b10\.\d{4,}/[^\s,;)>\]]+'), 1), line FROM l),
u AS (SELECT page_id, n, bare, k, CASE WHEN bare = 1 THEN 'https://doi.org/' || regexp_replace(lower(raw), '[.,;:]+$', '') ELSE regexp_replace(raw, '[.,;:)>\]]+$', '') END AS url FROM x),
c AS (SELECT *, CASE WHEN regexp_matches(url, 'doi\.org/10\.\d{4,}/') THEN 'doi' WHEN regexp_matches(url, '(?i)pmc\.ncbi\.nlm\.nih\.gov/articles/PMC\d+') THEN 'pmc' WHEN regexp_matches(url, 'pubmed\.ncbi\.nlm\.nih\.gov/\d+') THEN 'pmid'
  WHEN regexp_matches(url, '(?i)clinicaltrials\.gov/study/NCT\d+') THEN 'nct' WHEN regexp_matches(url, 'arxiv\.org/abs/[\d.]+') THEN 'arxiv' WHEN regexp_matches(url, 'biorxiv\.org/content/10\.1101/[\d.]+') THEN 'biorxiv'
  WHEN regexp_matches(url, '(?i)uniprot\.org/uniprotkb/[A-Z0-9]+') THEN 'uniprot' WHEN regexp_matches(url, 'pubchem\.ncbi\.nlm\.nih\.gov/compound/\d+') THEN 'pubchem'
  WHEN regexp_matches(lower(url), '\.(png|jpg|jpeg|gif|svg|css|js|ico|woff|woff2|ttf|eot)(\?|$)') OR contains(lower(url), 'fonts.googleapis.com') OR contains(lower(url), 'cdn.') OR contains(lower(url), 'static.') THEN NULL ELSE 'url' END AS kind FROM u),
i AS (SELECT *, CASE kind WHEN 'doi' THEN regexp_replace(lower(regexp_extract(url, 'doi\.org/(10\.\d{4,}/[^\s,;)>\]]+)', 1)), '[.,;:]+$', '') WHEN 'pmc' THEN upper(regexp_extract(url, '(?i)articles/(PMC\d+)', 1)) WHEN 'pmid' THEN regexp_extract(url, 'gov/(\d+)', 1)
  WHEN 'nct' THEN upper(regexp_extract(url, '(?i)study/(NCT\d+)', 1)) WHEN 'arxiv' THEN regexp_extract(url, 'abs/([\d.]+(?:v\d+)?)', 1) WHEN 'biorxiv' THEN regexp_extract(url, '(10\.1101/[\d.]+)', 1) WHEN 'uniprot' THEN upper(regexp_extract(url, '(?i)uniprotkb/([A-Z0-9]+)', 1))
  WHEN 'pubchem' THEN regexp_extract(url, 'compound/(\d+)', 1) WHEN 'url' THEN url END AS id FROM c WHERE kind IS NOT NULL),
refs AS (SELECT page_id, n, bare, k, kind, id, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY n, bare, k) AS r FROM i) WHERE r = 1)"""
REF_KEY = f"""CASE kind WHEN 'doi' THEN 'doi_' || regexp_replace(id, '[^a-z0-9]', '_', 'g') WHEN 'url' THEN 'url_' || {OLD_HASH} WHEN 'pmc' THEN 'pmc_' || id[4:] WHEN 'nct' THEN 'nct_' || id[4:]
  WHEN 'arxiv' THEN 'arxiv_' || replace(id, '.', '_') WHEN 'biorxiv' THEN 'biorxiv_' || regexp_replace(id, '[./]', '_', 'g') ELSE kind || '_' || id END"""
NOTE = "CASE kind WHEN 'pmc' THEN 'PubMed Central' WHEN 'pmid' THEN 'PubMed' WHEN 'nct' THEN 'ClinicalTrials.gov' WHEN 'arxiv' THEN 'arXiv preprint' WHEN 'biorxiv' THEN 'bioRxiv preprint' WHEN 'uniprot' THEN 'UniProt Database' WHEN 'pubchem' THEN 'PubChem Database' END"


def found_urls(s, d) -> DataFrame:
    """page_id, n, bare, k, url: addresses of each line, then bare DOIs outside of addresses, as addresses."""
    lines = view(s, d, "reports").select("page_id", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    address = r"https?://[^\s,;)>\]]+"
    urls = F.transform(F.regexp_extract_all("line", F.lit(address), F.lit(0)), lambda u, i: F.struct(F.lit(0).alias("bare"), i.alias("k"), F.regexp_replace(u, r"[.,;:)>\]]+$", "").alias("url")))
    dois = F.regexp_extract_all(F.regexp_replace("line", r"https?://\S*", ""), F.lit(r"(?<!\w)10\.\d{4,}/[^\s,;)>\]]+"), F.lit(0))
    bare = F.transform(dois, lambda x, i: F.struct(F.lit(1).alias("bare"), i.alias("k"), F.concat(F.lit("https://doi.org/"), text.normalize_doi(x)).alias("url")))
    return lines.select("page_id", "n", F.inline(F.concat(urls, bare)))


def refs(s, d) -> DataFrame:
    """page_id, n, bare, k, kind, id, url: the references of each report, the first of each id."""
    kind, ident = text.url_kind(F.col("url"))
    return keyed.keep_first(found_urls(s, d).withColumns({"kind": kind, "id": ident}).filter("kind is not null"), ["page_id", "id"], ["n", "bare", "k"])


@query("G2_references_first_id_wins", FOUND + " SELECT page_id, kind, id, url FROM refs")
def g2(s, d):
    return refs(s, d).select("page_id", "kind", "id", "url")


@query("G3_url_kinds", FOUND + " SELECT page_id, url, kind FROM c")
def g3(s, d):
    return found_urls(s, d).select("page_id", "url", text.url_kind(F.col("url"))[0].alias("kind"))


@query("P17_page_assets", FOUND + r" SELECT page_id, url FROM u WHERE regexp_matches(lower(url), '\.(png|jpg|jpeg|gif|svg|css|js|ico|woff|woff2|ttf|eot)(\?|$)') OR contains(lower(url), 'fonts.googleapis.com') OR contains(lower(url), 'cdn.') OR contains(lower(url), 'static.')")
def p17(s, d):
    return found_urls(s, d).filter(text.is_asset(F.col("url"))).select("page_id", "url")


@query("A15_reference_counts", FOUND + " SELECT page_id, count(*) FILTER (WHERE kind = 'doi') AS doi, count(*) FILTER (WHERE kind <> 'doi') AS other FROM refs GROUP BY 1")
def a15(s, d):
    return refs(s, d).groupBy("page_id").agg(F.count_if(F.col("kind") == "doi").alias("doi"), F.count_if(F.col("kind") != "doi").alias("other"))


@query("T4_ref_citekey", FOUND + f" SELECT page_id, id, {REF_KEY} AS citekey FROM refs")
def t4(s, d):
    return refs(s, d).select("page_id", "id", references.ref_citekey(F.col("kind"), F.col("id"), F.col("url")).alias("citekey"))


MISC = FOUND + f""", m AS (SELECT *, {REF_KEY} AS citekey, {NOTE} AS note, 'A {{study}} & ' || id AS title FROM refs), e AS (SELECT page_id, n, bare, k, kind, id, url, citekey, CASE WHEN kind = 'doi' THEN '@article{{' || citekey || ', doi = {{' || id || '}}}}' ELSE
  '@misc{{' || citekey || ',' || chr(10) || '  author = {{{{' || coalesce(note, 'Web Resource') || '}}}},' || chr(10) || '  title = {{' || replace(replace(replace(title, '{{', ''), '}}', ''), '&', '\\&') || '}},' || chr(10) || '  url = {{' || url || '}},' || chr(10) ||
  CASE WHEN note IS NULL THEN '  year = {{n.d.}}' ELSE '  year = {{n.d.}},' || chr(10) || '  note = {{' || note || '}}' END || chr(10) || '}}' END AS bibtex FROM m)"""


def entries(s, d) -> DataFrame:
    """References with citekey and entry; the title is made of the id, as no table holds one."""
    key = references.ref_citekey(F.col("kind"), F.col("id"), F.col("url"))
    misc = references.misc_entry(F.col("citekey"), F.concat(F.lit("A {study} & "), "id"), F.col("url"), references.ref_note(F.col("kind")))
    doi = F.concat(F.lit("@article{"), "citekey", F.lit(", doi = {"), "id", F.lit("}}"))
    return refs(s, d).withColumn("citekey", key).withColumn("bibtex", F.when(F.col("kind") == "doi", doi).otherwise(misc))


@query("T24_misc_entry", MISC + " SELECT page_id, id, bibtex FROM e WHERE kind <> 'doi'")
def t24(s, d):
    return entries(s, d).filter("kind <> 'doi'").select("page_id", "id", "bibtex")


# the DOI entries of all reports, then the others; one of each DOI or citekey; a citekey used again gets a number
BIB = MISC + """, w AS (SELECT *, CASE WHEN kind = 'doi' THEN 'doi:' || id ELSE 'key:' || citekey END AS same, (kind <> 'doi')::INT AS later FROM e),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY later, page_id, n, bare, k) AS r FROM w) WHERE r = 1),
  z AS (SELECT *, row_number() OVER (PARTITION BY citekey ORDER BY later, page_id, n, bare, k) AS use FROM f)"""
ORDER = ["later", "page_id", "n", "bare", "k"]


def bibliography(s, d) -> DataFrame:
    all_entries = entries(s, d).withColumn("later", (F.col("kind") != "doi").cast("int"))
    same = F.when(F.col("kind") == "doi", F.concat(F.lit("doi:"), "id")).otherwise(F.concat(F.lit("key:"), "citekey"))
    return keyed.collision_suffix(keyed.keep_first(all_entries.withColumn("same", same), ["same"], ORDER), "citekey", ORDER)


@query("U8_union_of_entries", BIB + " SELECT same, CASE WHEN use > 1 THEN citekey || '_' || use ELSE citekey END AS citekey FROM z")
def u8(s, d):
    return bibliography(s, d).select("same", "citekey")


@query("U4_distinct_dois", FOUND + r" SELECT DISTINCT regexp_replace(lower(upper(id) || CASE WHEN page_id % 2 = 0 THEN '.,' ELSE '' END), '[.,;:]+$', '') AS doi FROM i WHERE kind = 'doi'")
def u4(s, d):
    written = found_urls(s, d).withColumns(dict(zip(("kind", "id"), text.url_kind(F.col("url"))))).filter("kind = 'doi'")
    return written.select(text.normalize_doi(F.concat(F.upper("id"), F.when(F.col("page_id") % 2 == 0, ".,").otherwise(""))).alias("doi")).distinct()


@query("W18_bib_file", MISC + """ SELECT page_id, '% BibTeX references for Deep Research paper' || chr(10) || chr(10) || string_agg(CASE WHEN kind = 'doi' THEN '% DOI: ' || id ELSE '% URL: ' || url END || chr(10) || bibtex || chr(10), chr(10) ORDER BY n, bare, k) AS file FROM e GROUP BY 1""")
def w18(s, d):
    doi = F.when(F.col("kind") == "doi", F.col("id")).otherwise("")
    listed = entries(s, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "bare", "k", doi.alias("doi"), "url", "bibtex"))).alias("entries"))
    return listed.select("page_id", references.bib_file(F.col("entries")).alias("file"))


@query("J13_url_to_key", BIB + """ SELECT DISTINCT address, max(CASE WHEN use > 1 THEN citekey || '_' || use ELSE citekey END) AS citekey FROM (SELECT i.url AS address, z.citekey, z.use FROM refs i JOIN z ON i.kind = 'doi' AND z.kind = 'doi' AND i.id = z.id
  UNION ALL SELECT 'https://doi.org/' || i.id, z.citekey, z.use FROM refs i JOIN z ON i.kind = 'doi' AND z.kind = 'doi' AND i.id = z.id) GROUP BY 1""")
def j13(s, d):
    known = bibliography(s, d).filter("kind = 'doi'").select("id", "citekey")
    doi = refs(s, d).filter("kind = 'doi'").select("id", F.explode(F.array("url", F.concat(F.lit("https://doi.org/"), "id"))).alias("address"))
    return doi.join(known, "id").groupBy("address").agg(F.max("citekey").alias("citekey"))


@query("G6_keyed_urls", MISC + r""", keys AS (SELECT page_id, list(url ORDER BY length(url) DESC, url) AS urls, list(citekey ORDER BY length(url) DESC, url) AS cs FROM e WHERE kind <> 'doi' GROUP BY 1)
  SELECT r.page_id, CASE WHEN keys.urls IS NULL THEN body ELSE list_reduce(list_prepend(body, list_transform(list_zip(urls, cs), lambda z: z[1] || chr(1) || z[2])), lambda t, z: regexp_replace(t, '\[?' || regexp_escape(split_part(z, chr(1), 1)) || '([.,;:]*)([\s\])<>]|$)',
  '[@' || split_part(z, chr(1), 2) || ']\2', 'g')) END AS cited FROM reports r LEFT JOIN keys USING (page_id)""")
def g6(s, d):
    keys = entries(s, d).filter("kind <> 'doi'").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("url", "citekey"))).alias("keys"))
    cited = references.keyed_urls(F.col("body"), F.coalesce("keys", F.create_map().cast("map<string,string>")))
    return view(s, d, "reports").join(keys, "page_id", "left").select("page_id", cited.alias("cited"))


@query("J14_source_metadata", r"""WITH s AS (SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '#.*$', '') || '#again' END AS cited FROM pages),
  u AS (SELECT url, regexp_replace(url, '#.*$', '') AS bare FROM (SELECT url FROM s UNION SELECT cited FROM c)), q AS (SELECT url, regexp_extract(bare, '^([^?]*)', 1) AS path, regexp_extract(bare, '\?(.*)$', 1) AS query FROM u),
  r AS (SELECT url, query, CASE WHEN regexp_matches(path, '^https?://[^/]+$') THEN path || '/' WHEN regexp_matches(path, '^https?://[^/]+/$') THEN path ELSE regexp_replace(path, '/$', '') END AS path FROM q),
  n AS (SELECT url, path || CASE WHEN query = '' THEN '' ELSE '?' || (SELECT string_agg(x, '&' ORDER BY split_part(x, '=', 1), i) FROM (SELECT unnest(string_split(query, '&')) AS x, generate_subscripts(string_split(query, '&'), 1) AS i)) END AS normal FROM r),
  k AS (SELECT url AS key, FALSE AS other, url, title FROM s UNION ALL SELECT normal, normal <> url, url, title FROM s JOIN n USING (url)), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY other, url, title) = 1)
  SELECT page_id, coalesce(x.title, y.title, '') AS title, coalesce(x.url, y.url, cited) AS url FROM c LEFT JOIN b x ON x.key = cited LEFT JOIN n ON n.url = cited LEFT JOIN b y ON y.key = n.normal""")
def j14(s, d):
    p = table(s, d, "pages")
    cited = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")))
    known = p.select(F.explode(F.array(F.struct(F.col("url").alias("key")), F.struct(text.normal_url(F.col("url")).alias("key")))).alias("k"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).select("k.key", "url", "title")
    known = known.groupBy("key").agg(F.min(F.struct((F.col("key") != F.col("url")).alias("other"), "url", "title")).alias("source"))
    rows = p.select("page_id", cited.alias("cited"))
    raw, normal = known.select(F.col("key").alias("cited"), F.col("source").alias("raw")), known.select(F.col("key").alias("normal"), F.col("source").alias("by_normal"))
    found = rows.join(raw, "cited", "left").withColumn("normal", text.normal_url(F.col("cited"))).join(normal, "normal", "left").withColumn("source", F.coalesce("raw", "by_normal"))
    return found.select("page_id", F.coalesce("source.title", F.lit("")).alias("title"), F.coalesce("source.url", "cited").alias("url"))


# --- results of searches ---------------------------------------------------------------------------------------------
RESULTS = "WITH r AS (SELECT page_id % 20 AS response, page_id AS place, page_id % 3 = 0 AS plugin, regexp_replace(url, '[0-9]+.*$', '') AS url FROM pages)"


def results(s, d) -> DataFrame:
    """Search results of a response in their place, from a plugin or an annotation; addresses without their numbers, so that some repeat."""
    n = F.col("page_id")
    return table(s, d, "pages").select((n % 20).alias("response"), n.alias("place"), (n % 3 == 0).alias("plugin"), F.regexp_replace("url", "[0-9]+.*$", "").alias("url"))


def renumbered(rows: DataFrame, order: list) -> DataFrame:
    """The first result of each address of a response, numbered from 0 over the response."""
    once = keyed.keep_first(rows, ["response", "url"], order)
    return once.withColumn("index", F.row_number().over(Window.partitionBy("response").orderBy(*order)) - 1)


def numbered_sql(order: str, where: str = "") -> str:
    return RESULTS + f", o AS (SELECT *, row_number() OVER (PARTITION BY response, url ORDER BY {order}) AS n FROM r {where}) SELECT response, url, row_number() OVER (PARTITION BY response ORDER BY {order}) - 1 AS index FROM o WHERE n = 1"


@query("N3_renumbered_results", numbered_sql("place"))
def n3(s, d):
    return renumbered(results(s, d), ["place"]).select("response", "url", "index")


@query("N11_flattened_results", numbered_sql("place", "WHERE plugin"))
def n11(s, d):
    nested = results(s, d).filter("plugin").groupBy("response").agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("results"))
    return renumbered(nested.select("response", F.inline("results")), ["place"]).select("response", "url", "index")


@query("U9_ordered_union", numbered_sql("NOT plugin, place"))
def u9(s, d):
    r = results(s, d)
    both = r.filter("plugin").withColumn("rank", F.lit(0)).unionByName(r.filter("not plugin").withColumn("rank", F.lit(1)))
    return renumbered(both, ["rank", "place"]).select("response", "url", "index")


@query("G14_cited_results", RESULTS + r""", c AS (SELECT DISTINCT response, i FROM (SELECT page_id % 20 AS response, unnest(list_transform(regexp_extract_all(html, '[0-9]+'), lambda x: try_cast(x AS INT) - 1)) AS i FROM pages WHERE page_id % 20 % 4 <> 0)),
  p AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY response) AS total FROM r), has AS (SELECT DISTINCT response FROM c),
  t AS (SELECT p.response, p.url, p.i, row_number() OVER (PARTITION BY p.response ORDER BY p.i) - 1 AS index FROM p LEFT JOIN has USING (response) LEFT JOIN c ON c.response = p.response AND c.i = p.i WHERE has.response IS NULL OR c.i IS NOT NULL)
  SELECT response, url, index FROM (SELECT *, row_number() OVER (PARTITION BY response, regexp_replace(url, '/$', '') ORDER BY i) AS n FROM t) WHERE n = 1""")
def g14(s, d):
    """A response's answers cite results by the numbers in its pages; every fourth response cites none, and so all its results count."""
    numbers = F.explode(F.transform(F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int") - 1)).alias("i")
    cited = table(s, d, "pages").select((F.col("page_id") % 20).alias("response"), "html").filter("response % 4 <> 0").select("response", numbers).distinct()
    placed = results(s, d).withColumn("i", F.row_number().over(Window.partitionBy("response").orderBy("place")) - 1)
    some = cited.select("response").distinct()
    taken = placed.join(some, "response", "left_anti").unionByName(placed.join(cited, ["response", "i"], "left_semi"), allowMissingColumns=True)
    ordered = taken.withColumn("index", F.row_number().over(Window.partitionBy("response").orderBy("i")) - 1).withColumn("normal", text.normal_url(F.col("url")))
    return keyed.keep_first(ordered, ["response", "normal"], ["i"]).select("response", "url", "index")
