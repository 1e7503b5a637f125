"""Files, lenient JSON, citations, Markdown and BibTeX as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Parser, parts of a MIME type, file name endings.
PARSERS = [
    ("excel", ["spreadsheet", "excel", "vnd.openxmlformats", "vnd.ms-excel"], [".xlsx", ".xls"]),
    ("csv", ["text/csv", "csv"], [".csv"]),
    ("markdown", ["text/markdown", "markdown"], [".md"]),
    ("json", ["application/json", "json"], [".json"]),
    ("text", ["text/plain"], [".txt"]),
    ("pdf", ["application/pdf", "pdf"], [".pdf"]),
    ("image", ["image/png", "image/jpeg", "image/jpg", "image/webp"], [".png", ".jpg", ".jpeg", ".webp"]),
]
# Endings that make a file with a parser an image whatever its MIME type, and those that a knowledge base keeps.
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".webp", ".gif"]
KNOWLEDGE_ENDINGS = [".md", ".docx", ".pdf"]
# Bytes read at most.
LARGE, TEXTUAL, OTHER = 50 * 1024 * 1024, 10 * 1024 * 1024, 4096
# Ending and MIME type.
MIME = [
    ("pdf", "application/pdf"),
    ("csv", "text/csv"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("xls", "application/vnd.ms-excel"),
    ("txt", "text/plain"),
    ("json", "application/json"),
    ("md", "text/markdown"),
]
# Stage and percent shown.
STAGES = [
    ("validating", 5), ("metadata", 20), ("figures", 30), ("discoveries", 60), ("bibliography", 75), ("latex_assembly", 80), ("compilation", 90),
    ("upload", 95), ("cleanup", 100),
]
# Phase and label shown.
PHASES = [
    ("planning", "Planning research"), ("literature", "Researching literature"), ("analysis", "Analyzing data"), ("reflection", "Synthesizing findings"),
    ("next_steps", "Planning next step"), ("reply", "Drafting response"),
]


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def matches_mime(mime: Column, parts: list[str]) -> Column:
    """Whether a MIME type, in lower case, holds any of the parts."""
    kind = F.lower(F.trim(F.coalesce(mime, F.lit(""))))
    return any_of([kind.contains(p.lower()) for p in parts])


def matches_ending(name: Column, ends: list[str]) -> Column:
    return any_of([F.lower(name).endswith(e) for e in ends])


def parser_of(name: Column, mime: Column) -> Column:
    """The parser whose MIME parts fit, over all parsers; else the one whose endings fit; else null. Images among them go to the image parser."""
    by_mime = F.coalesce(*[F.when(matches_mime(mime, parts), parser) for parser, parts, _ in PARSERS])
    by_name = F.coalesce(*[F.when(matches_ending(name, ends), parser) for parser, _, ends in PARSERS])
    found = F.coalesce(by_mime, by_name)
    image = F.coalesce(mime, F.lit("")).contains("image") | matches_ending(name, IMAGE_ENDINGS)
    return F.when(found.isNotNull() & image, "image").otherwise(found)


def preview_of(name: Column, mime: Column) -> Column:
    """How a file is previewed: text, excel, pdf, image; text for any other."""
    ext, kind = F.lower(F.element_at(F.split(name, r"\."), -1)), F.coalesce(mime, F.lit(""))
    return (
        F.when(kind.startswith("text/") | ext.isin("csv", "json", "md", "txt"), "text")
        .when(ext.isin("xlsx", "xls"), "excel")
        .when((ext == "pdf") | (kind == "application/pdf"), "pdf")
        .when(kind.startswith("image/"), "image")
        .otherwise("text")
    )


def range_limit(parser: Column) -> Column:
    return F.when(parser.isin("pdf", "image", "excel"), LARGE).when(parser.isin("csv", "markdown", "json", "text"), TEXTUAL).otherwise(OTHER)


def lookup(x: Column, table: list[tuple], default) -> Column:
    return F.coalesce(*[F.when(x == k, v) for k, v in table], F.lit(default))


def mime_of(name: Column) -> Column:
    return lookup(F.lower(F.element_at(F.split(name, r"\."), -1)), MIME, "application/octet-stream")


def stage_percent(stage: Column) -> Column:
    return lookup(stage, STAGES, 0)


def is_json(x: Column) -> Column:
    # what doesn't begin like JSON is told without a parse that fails
    begins = x.rlike(r"\A[ \t\r\n]*(?:[\[{\"\-\d]|true|false|null)")
    return F.coalesce(F.when(begins, F.try_parse_json(x).isNotNull()), F.lit(False))


def lenient_json(x: Column) -> tuple[Column, Column]:
    """(strategy, JSON) of an answer: the whole, without fences, or from the first brace to the last; ('none', null) if none parses."""
    def tries(whole: Column) -> Column:
        bare = [F.regexp_replace(F.regexp_replace(whole, rf"(?i)^```{kind}\s*", ""), r"\s*```\z", "") for kind in ("json", "")]
        ways = [("direct", whole), ("json_fence", bare[0]), ("fence", bare[1]), ("braces", F.regexp_extract(whole, r"(?s)(\{.*\})", 1))]
        parsed = lambda name: lambda t: F.when(is_json(t), F.struct(F.lit(name).alias("way"), t.alias("json")))
        found = [text.let(part, parsed(name)) for name, part in ways]
        return F.coalesce(*found, F.struct(F.lit("none").alias("way"), F.lit(None).cast("string").alias("json")))

    found = text.let(text.trim(x), tries)
    return found["way"], found["json"]


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; the new value of a key wins."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


CITATION = r"\[([^\]]*)\]\{([^\}]*)\}"


def citations(x: Column) -> Column:
    """Inline citations `[text]{url, url}` as (index from 1, cited, urls, written); those without a URL take no index."""
    cited, listed, written = (F.regexp_extract_all(x, F.lit(f"({CITATION})"), F.lit(i)) for i in (2, 3, 1))
    urls = lambda y: F.filter(F.transform(F.split(y, ","), lambda w: text.trim(w)), lambda u: u != "")
    found = F.transform(F.arrays_zip(cited.alias("c"), listed.alias("u"), written.alias("w")), lambda p: F.struct(p["c"].alias("cited"), urls(p["u"]).alias("urls"), p["w"].alias("written")))
    return F.transform(
        F.filter(found, lambda p: F.size(p["urls"]) > 0),
        lambda p, i: F.struct((i + 1).alias("index"), p["cited"].alias("cited"), p["urls"].alias("urls"), p["written"].alias("written")),
    )


def without_citations(x: Column) -> Column:
    return F.regexp_replace(x, CITATION, "$1")


def anchored(x: Column) -> Column:
    """Citations with a URL as their text and an anchor of their index, each at the first place where it is written; others as their text."""
    anchor = lambda c: F.concat(c["cited"], F.lit('<span data-citation-anchor="'), c["index"].cast("string"), F.lit('"></span>'))
    return without_citations(F.aggregate(citations(x), x, lambda out, c: text.replaced_first(out, c["written"], anchor(c))))


def spliced(x: Column, pattern: str, group: int, put) -> Column:
    """x with put(match, group) for each match of a pattern."""
    whole = F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    parts = F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(group + 1))
    new = F.zip_with(whole, parts, put)
    return F.array_join(F.zip_with(F.split(x, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def keyed_urls(x: Column, keys: Column) -> Column:
    """Addresses (in brackets or not) whose clean form is in the map `keys` as `[@key]`."""
    def put(match, url):
        key = F.try_element_at(keys, F.regexp_replace(url, r"[.,;:)>\]]+$", ""))
        return F.when(key.isNull(), match).otherwise(F.concat(F.lit("[@"), key, F.lit("]")))

    return spliced(x, r"\[?(https?://[^\s\])<>]+)\]?", 1, put)


def known_citations(x: Column, known: Column) -> Column:
    """`[@a; -@b]` without keys that are not known; other parts stay; a bracket of unknown keys alone goes."""
    key = lambda p: F.regexp_extract(p, r"-?@([^\s,;\]]+)", 1)
    stays = lambda p: (key(p) == "") | F.array_contains(known, key(p))
    parts = lambda inner: F.filter(F.transform(F.split(inner, ";"), lambda w: text.trim(w)), stays)
    bracket = lambda match, inner: F.when(F.size(parts(inner)) > 0, F.concat(F.lit("["), F.array_join(parts(inner), "; "), F.lit("]"))).otherwise("")
    return spliced(x, r"\[([^\]]*@[^\]]+)\]", 1, bracket)


def link_parts(x: Column) -> Column:
    """Text and Markdown links in order: array of (type, content or link text, url); no empty text."""
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    names, urls = (F.regexp_extract_all(x, F.lit(pattern), F.lit(i)) for i in (1, 2))
    plain = lambda t: F.struct(F.lit("text").alias("type"), t.alias("content"), F.lit(None).cast("string").alias("url"))
    link = lambda t, u: F.struct(F.lit("link").alias("type"), t.alias("content"), u.alias("url"))
    pairs = F.zip_with(F.split(x, pattern, -1), F.zip_with(names, urls, link), lambda t, l: F.array(plain(t), l))
    return F.filter(F.flatten(pairs), lambda p: p.isNotNull() & ((p["type"] == "link") | (p["content"] != "")))


def sections(x: Column) -> Column:
    """Markdown sections of levels 1 to 3 as (title, length of the trimmed body)."""
    heading = r"(?m)^#{1,3}\s+(.+)$"
    titles, bodies = F.regexp_extract_all(x, F.lit(heading), F.lit(1)), F.split(x, heading, -1)
    return F.transform(titles, lambda t, i: F.struct(t.alias("title"), F.length(text.trim(F.get(bodies, i + 1))).alias("length")))


CITE = r'<cite index="([^"]+)">([^<]+)</cite>'


def without_cite_tags(x: Column) -> Column:
    return F.regexp_replace(x, CITE, "$2")


def cite_tag_indices(x: Column) -> Column:
    """Indices (from 0, ascending) of the results that cite tags name: the leading number of each part less one."""
    parts = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(CITE), F.lit(1)), lambda y: F.split(y, ",")))
    numbers = F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int") - 1)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def matches(x: Column, pattern: str) -> Column:
    """Spans (start, end inclusive, from 0) of a pattern's matches, none of them empty; null for null."""
    sizes = F.transform(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.length(m))
    gaps = F.slice(F.transform(F.split(x, pattern, -1), lambda g: F.length(g)), F.lit(1), F.size(sizes))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def further(done, p):
        start = done["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["size"] - 1).alias("end"))
        return F.struct((start + p["size"]).alias("at"), F.array_append(done["spans"], span).alias("spans"))

    pairs = F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), further, lambda done: done["spans"])


def without_spans(x: Column, spans: Column) -> Column:
    """x without spans (start, end inclusive, from 0), from right to left; a span outside of what is left is passed over."""
    ordered = F.array_sort(spans, lambda a, b: b["start"].cast("int") - a["start"].cast("int"))

    def cut(left, s):
        fits = (s["start"] >= 0) & (s["end"] < F.length(left)) & (s["end"] >= s["start"])
        return F.when(fits, F.concat(F.substring(left, F.lit(1), s["start"]), F.substring(left, s["end"] + 2, F.length(left)))).otherwise(left)

    return F.aggregate(ordered, x, cut)


def with_marks(x: Column, marks: Column) -> Column:
    """x with `[i + 1]`, joined by commas, put in at the end of each mark (end, indices), from right to left."""
    ordered = F.array_sort(F.filter(marks, lambda m: F.size(m["indices"]) > 0), lambda a, b: b["end"].cast("int") - a["end"].cast("int"))

    def put(left, m):
        sign = F.array_join(F.transform(m["indices"], lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))), ", ")
        return F.concat(F.substring(left, F.lit(1), m["end"]), sign, F.substring(left, m["end"] + 1, F.length(left)))

    return F.aggregate(ordered, x, put)


def continuation(has_steps: Column, steering: Column, autonomous: Column, iteration: Column) -> Column:
    """stop, go, or score (a scorer decides), the first rule that holds."""
    return F.when(~has_steps, "stop").when(steering, "stop").when(autonomous, "go").when(iteration == 1, "go").otherwise("score")


def bib_citekey(bib: Column) -> Column:
    return F.nullif(F.regexp_extract(bib, r"@\w+\s*\{\s*([^,\s}]+)", 1), F.lit(""))


def bib_field(bib: Column, field: str) -> Column:
    return F.regexp_extract(bib, rf"(?i)\b{field}\s*=\s*[{{\"]([^}}\"]*)[}}\"]", 1)


def with_citekey(bib: Column, key: Column) -> Column:
    """The entry under another key; an entry that doesn't begin a line stays as it is."""
    head = F.regexp_extract(bib, r"(?m)^(@\w+\{)[^,]+,", 1)
    return F.when(head == "", bib).otherwise(F.regexp_replace(bib, r"(?ms)\A(.*?)^@\w+\{[^,]+,", F.concat(F.lit("$1"), head, key, F.lit(","))))


def escaped_fields(bib: Column) -> Column:
    r"""`_` as `\_` in field values, but for those of identifiers and links; an escaped one stays as it is."""
    # Fields where an underscore is as meant.
    plain = ["url", "doi", "eprint", "file", "archiveprefix", "primaryclass"]
    field = lambda m: F.lower(F.regexp_extract(m, r"^(\w+)", 1))
    put = lambda match, _: F.when(field(match).isin(plain), match).otherwise(F.concat(F.regexp_extract(match, r"(?s)^(\w+\s*=\s*\{)", 1), F.regexp_replace(F.regexp_extract(match, r"(?s)^\w+\s*=\s*\{(.*)$", 1), r"(?<!\\)_", r"\\_")))
    return spliced(bib, r"\b(\w+)\s*=\s*\{(?:[^{}]|\{[^{}]*\})*\}", 1, put)


# Kind of a reference and the note of its entry.
NOTES = [
    ("pmc", "PubMed Central"), ("pmid", "PubMed"), ("nct", "ClinicalTrials.gov"), ("arxiv", "arXiv preprint"), ("biorxiv", "bioRxiv preprint"),
    ("uniprot", "UniProt Database"), ("pubchem", "PubChem Database"),
]


def ref_note(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, note) for k, note in NOTES])


def ref_citekey(kind: Column, ident: Column, url: Column) -> Column:
    """Citekey of a reference by its kind; identifiers lose PMC and NCT, points and slashes turn to underscores."""
    number = F.when(kind.isin("pmc", "nct"), F.regexp_replace(ident, "(?i)^(PMC|NCT)", "")).otherwise(ident)
    known = text.citekey(F.concat(kind, F.lit("_"), F.when(kind.isin("arxiv", "biorxiv"), F.regexp_replace(number, "[./]", "_")).otherwise(number)))
    return F.when(kind == "doi", text.doi_citekey(text.normalize_doi(ident))).when(kind == "url", F.concat(F.lit("url_"), text.simple_hash(url))).otherwise(known)


def misc_entry(key: Column, title: Column, url: Column, note: Column) -> Column:
    """A @misc entry whose author is the note, or `Web Resource`; the note itself only where there is one."""
    safe = F.replace(F.regexp_replace(title, "[{}]", ""), F.lit("&"), F.lit("\\&"))
    lines = [
        F.concat(F.lit("@misc{"), key, F.lit(",")), F.concat(F.lit("  author = {{"), F.coalesce(note, F.lit("Web Resource")), F.lit("}},")),
        F.concat(F.lit("  title = {"), safe, F.lit("},")), F.concat(F.lit("  url = {"), url, F.lit("},")),
        F.concat(F.lit("  year = {n.d.}"), F.when(note.isNotNull(), F.concat(F.lit(",\n  note = {"), note, F.lit("}"))).otherwise("")), F.lit("}"),
    ]
    return F.concat_ws("\n", *lines)


def bib_file(entries: Column) -> Column:
    """A file of entries (doi, url, bibtex), each under a comment with its DOI or address."""
    comment = lambda e: F.when(e["doi"] != "", F.concat(F.lit("% DOI: "), e["doi"])).otherwise(F.concat(F.lit("% URL: "), F.coalesce(F.nullif(e["url"], F.lit("")), F.lit("unknown"))))
    return F.concat(F.lit("% BibTeX references for Deep Research paper\n\n"), F.array_join(F.transform(entries, lambda e: F.concat(comment(e), F.lit("\n"), e["bibtex"], F.lit("\n"))), "\n"))


def paper(title: Column, authors: Column, abstract: Column, snapshot: Column, background: Column, insights: Column, summary_text: Column, discoveries: Column, bib: str) -> Column:
    """A Markdown document: front matter, then its sections; insights, a summary and discoveries only where there are any."""
    # The front matter's lines behind the abstract.
    rest = [f"bibliography: {bib}", "biblio-style: unsrtnat", "natbiboptions: numbers", "header-includes: |", r"  \usepackage{amsmath}", r"  \usepackage{amssymb}", r"  \usepackage{graphicx}", r"  \usepackage{booktabs}", "---"]
    head = F.concat_ws(
        "\n", F.lit("---"), F.lit("title: |"), F.concat(F.lit("  "), title), F.concat(F.lit('author: "'), F.replace(authors, F.lit('"'), F.lit('\\"')), F.lit('"')),
        F.lit("abstract: |"), F.concat(F.lit("  "), F.replace(abstract, F.lit("\n"), F.lit("\n  "))), *map(F.lit, rest),
    )
    items = F.array_join(F.transform(insights, lambda x: F.concat(F.lit("- "), x)), "\n")
    some = lambda name, x, there: F.when(there, F.concat(F.lit(f"\n# {name}\n\n"), x))
    body = F.concat_ws(
        "\n", F.concat(F.lit("# Research Snapshot\n\n"), snapshot), F.concat(F.lit("\n# Background\n\n"), background), some("Key Insights", items, F.size(insights) > 0),
        some("Summary of Discoveries", summary_text, F.coalesce(summary_text, F.lit("")) != ""), F.when(F.size(discoveries) > 0, F.array_join(F.transform(discoveries, lambda x: F.concat(F.lit("\n"), x)), "\n")),
    )
    return F.concat(head, F.lit("\n\n"), body, F.lit("\n"))


def undefined_citations(log: Column) -> Column:
    """Keys that a log of LaTeX or BibTeX calls undefined, each once, in order."""
    pattern = "(?:LaTeX Warning: Citation [`']([^'`]+)['`] undefined|Warning--I didn't find a database entry for \"([^\"]+)\")"
    both = F.zip_with(*[F.regexp_extract_all(log, F.lit(pattern), F.lit(i)) for i in (1, 2)], lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    return F.array_distinct(F.filter(both, lambda k: F.coalesce(k, F.lit("")) != ""))


def stripped_citations(x: Column) -> Column:
    """What stands before a heading `#### Citations`, trimmed; a text without one stays as it is."""
    found = r"(?is)####\s+citations.*\z"
    return F.when(x.rlike(found), text.trim(F.regexp_replace(x, found, ""))).otherwise(x)


def last_lines(x: Column, n: int) -> Column:
    lines = F.split(x, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def summary(x: Column) -> Column:
    """The section `## Summary`, or else the first 300 characters and `...`."""
    part = text.trim(F.regexp_extract(x, r"(?s)## Summary\s*\n(.*?)(?=\n## |\z)", 1))
    return F.when(part != "", part).otherwise(F.concat(F.substring(x, 1, 300), F.lit("...")))
