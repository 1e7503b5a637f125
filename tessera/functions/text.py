"""String functions as column expressions. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a trim takes off: ASCII and Unicode white space, and the byte order mark.
SPACE = r"[\s   -     　﻿]"
#: The same one by one.
SPACES = " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def normalize_doi(x: Column) -> Column:
    """Lower case, trimmed, unescaped, without punctuation at the end."""
    return F.regexp_replace(F.regexp_replace(trim(F.lower(x)), r"\\([_&%])", "$1"), r"[.,;:]+$", "")


def is_doi(x: Column) -> Column:
    return x.rlike(r"^10\.\d{4,}/\S+$")


def doi_citekey(doi: Column) -> Column:
    return F.concat(F.lit("doi_"), F.regexp_replace(doi, "[^a-z0-9]", "_"))


def citekey(x: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_-]", "_"), "^[^A-Za-z]", "X")
    return F.substring(clean, 1, 64)


def truncated(x: Column, n: int) -> Column:
    """x, or its first n - 3 characters and `...` if longer than n."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def last_index(x: Column, part: str, before: int) -> Column:
    """Place from 0 of the last `part` in the first `before` characters; -1 if none."""
    head = F.substring(x, 1, before)
    at = F.locate(part[::-1], F.reverse(head))
    return F.when(at == 0, -1).otherwise(F.length(head) - at - len(part) + 1)


def truncated_title(x: Column, most: int = 120, least: int = 30) -> Column:
    """Cut at the last sentence, clause or word end beyond `least`; hard cut if there is none."""
    cut = F.coalesce(*[F.when(last_index(x, p, most) > least, last_index(x, p, most)) for p in (". ", ", ", " ")], F.lit(most))
    return F.when(F.length(x) <= most, x).otherwise(F.substring(x, F.lit(1), cut))


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9._-]", "_"), "__+", "_")


def upload_filename(x: Column) -> Column:
    """Keeps letters, digits and the characters from . to _ of ASCII; a hyphen is replaced."""
    return F.regexp_replace(x, r"[^a-zA-Z0-9.-_]", "_")


def extension(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"(\.[^.]*)$", 1))


def basename(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def html_text(x: Column) -> Column:
    """Without scripts and styles, tags as spaces, six entities decoded (&amp; first), white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")
    out = F.regexp_replace(bare, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)


def domain_name(url: Column) -> Column:
    """The label before the registry part of a host name."""
    labels = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    deep = (F.size(labels) > 2) & second.isin("co", "com", "gov", "edu", "ac", "org", "net")
    return F.when(F.size(labels) < 2, labels[0]).when(deep, F.try_element_at(labels, F.lit(-3))).otherwise(second)


def normal_url(url: Column) -> Column:
    """Without fragment and a slash at the end (but for the root), query parameters in order of their names; what is no URL is trimmed."""
    bare = F.regexp_replace(trim(url), "#.*$", "")
    path, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    path = F.when(path.rlike("(?i)^https?://[^/]+$"), F.concat(path, F.lit("/"))).when(path.rlike("(?i)^https?://[^/]+/$"), path).otherwise(F.regexp_replace(path, "/$", ""))
    ordered = F.array_sort(F.transform(F.split(query, "&"), lambda x, i: F.struct(F.split(x, "=")[0].alias("name"), i.alias("i"), x.alias("pair"))))
    whole = F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), F.array_join(F.transform(ordered, lambda x: x["pair"]), "&")))
    return F.when(bare.rlike("(?i)^https?://[^/]"), whole).otherwise(trim(url))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def fallback_title(url_or_doi: Column) -> Column:
    """`host - last part of the path`, or the host alone; a DOI stands for its address."""
    url = F.when(url_or_doi.startswith("http"), url_or_doi).otherwise(F.concat(F.lit("https://doi.org/"), url_or_doi))
    name = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    last = F.try_element_at(F.filter(F.split(url_path(url), "/"), lambda x: x != ""), F.lit(-1))
    return F.when(name == "", F.substring(url_or_doi, 1, 60)).when(last.isNull(), name).otherwise(F.concat(name, F.lit(" - "), last))


def line_title(line: Column, cited: Column) -> Column:
    """Title of what a line cites: of a numbered entry, of a Markdown link, else the text before it; fallback_title if none is over five characters."""
    numbered = trim(F.regexp_replace(F.regexp_extract(line, r"^\s*\[?\d+\]?\s+(.+?)(?:\.\s+\w+\.\s+https?://|https?://)", 1), r"\.\s*$", ""))
    link = F.call_function("regexp_extract", line, F.concat(F.lit(r"\[([^\]]+)\]\(\Q"), cited, F.lit(r"\E\)")), F.lit(1))
    before = trim(F.regexp_replace(trim(F.substring(line, F.lit(1), F.greatest(F.call_function("locate", cited, line), F.lit(1)) - 1)), r"[\s.,:;-]+$", ""))
    before = trim(F.regexp_replace(before, r"^\s*\[?\d+\]?\s*\.?\s*", ""))
    return (
        F.when(F.length(numbered) > 5, truncated_title(numbered))
        .when(link != "", truncated_title(trim(link)))
        .when(F.length(before) > 5, truncated_title(before))
        .otherwise(fallback_title(cited))
    )


def wrapped(x: Column) -> Column:
    """A long as the signed 32-bit number of its low bits."""
    return F.shiftright(F.shiftleft(x, 32), 32)


def codes(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))


def simple_hash(x: Column) -> Column:
    """Eight hex digits of |h|, h = 31 h + code in signed 32 bits."""
    h = F.aggregate(codes(x), F.lit(0).cast("bigint"), lambda s, c: wrapped(s * 31 + c))
    return F.lower(F.lpad(F.hex(F.abs(h)), 8, "0"))


def wallet_uuid(x: Column) -> Column:
    """A name-based UUID of a wallet address in lower case: four lanes h = 33 h XOR code, with version 5 and variant bits set."""
    # The lanes' seeds.
    seeds = [5381, 52711, 31337, 7919]
    lanes = [F.aggregate(codes(F.lower(x)), F.lit(seed).cast("bigint"), lambda s, c: wrapped(s * 33).bitwiseXOR(c)) for seed in seeds]
    low = [x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in lanes]
    low[1] = low[1].bitwiseAND(F.lit(0xFFFF0FFF)).bitwiseOR(F.lit(0x5000))
    low[2] = low[2].bitwiseAND(F.lit(0x3FFFFFFF)).bitwiseOR(F.lit(0x80000000))
    return F.regexp_replace(F.concat(*[F.lower(F.lpad(F.hex(x), 8, "0")) for x in low]), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def shown_title(title: Column) -> Column:
    """A title that is an address becomes `www.` and its host."""
    url = F.when(title.startswith("www."), F.concat(F.lit("https://"), title)).when(title.rlike("^https?://"), title)
    name = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    return F.when(F.coalesce(name, F.lit("")) == "", title).when(name.startswith("www."), name).otherwise(F.concat(F.lit("www."), name))


def fork_title(x: Column) -> Column:
    """A title, trimmed, with the prefix of a fork; one that has it gets no second."""
    bare = trim(x)
    return F.when(bare.startswith("[Deep Research]"), bare).otherwise(F.concat(F.lit("[Deep Research] "), bare))


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def step(x: Column) -> Column:
    """A plan step without bullets, number, doubled spaces and punctuation at the end."""
    bare = F.regexp_replace(F.regexp_replace(x, f"^{SPACE}*[-*•]+{SPACE}*", ""), rf"^{SPACE}*\d+[\].:)\-]?{SPACE}*", "")
    return trim(F.regexp_replace(F.regexp_replace(bare, f"{SPACE}+", " "), "[.;:,]+$", ""))


def replaced_first(template: Column, part: Column | str, value: Column) -> Column:
    """The first `part` of a template replaced by value, in which $$ is a dollar sign, $& the part, and $` and $' the text before and after it."""
    part = F.lit(part) if isinstance(part, str) else part
    at = F.call_function("locate", part, template)
    before, after = F.substring(template, F.lit(1), at - 1), F.substring(template, at + F.length(part), F.length(template))
    sign = r"\$[$&`']"
    between, signs = F.split(value, sign), F.regexp_extract_all(value, F.lit(f"({sign})"), F.lit(1))
    meant = lambda x: F.when(x == "$$", "$").when(x == "$&", part).when(x == "$`", before).otherwise(after)
    filled = F.array_join(F.zip_with(between, F.transform(signs, meant), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(at == 0, template).otherwise(F.concat(before, filled, after))


# Named entities and what stands for them.
ENTITIES = [
    ("&amp;", "\\&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "'"), ("&rsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'),
]


def decoded_entities(x: Column) -> Column:
    """HTML entities as characters, the ampersand as LaTeX writes it; numbers are UTF-16 units."""
    for name, character in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(character))
    between, numbers = F.split(x, r"&#\d+;"), F.regexp_extract_all(x, F.lit(r"&#(\d+);"), F.lit(1))
    unit = lambda n: F.when(n == "38", "\\&").otherwise(F.decode(F.unhex(F.right(F.lpad(F.hex(n.cast("bigint")), 16, "0"), F.lit(4))), "UTF-16BE"))
    return F.array_join(F.zip_with(between, F.transform(numbers, unit), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


# Endings, and parts of addresses, of what belongs to a page and is no reference.
ASSET_ENDINGS = ["png", "jpg", "jpeg", "gif", "svg", "css", "js", "ico", "woff", "woff2", "ttf", "eot"]
ASSET_PARTS = ["fonts.googleapis.com", "cdn.", "static."]


def is_asset(url: Column) -> Column:
    low = F.lower(url)
    out = low.rlike(rf"\.({'|'.join(ASSET_ENDINGS)})(\?|$)")
    for part in ASSET_PARTS:
        out = out | low.contains(part)
    return out


def url_kind(url: Column) -> tuple[Column, Column]:
    """(kind, id) of a reference URL, the first rule that matches; null kind for page assets."""
    # Kind, pattern with the id as its group, whether the id is put in upper case.
    rules = [
        ("doi", r"doi\.org/(10\.\d{4,}/[^\s,;)>\]]+)", False),
        ("pmc", r"(?i)pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+)", True),
        ("pmid", r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", False),
        ("nct", r"(?i)clinicaltrials\.gov/study/(NCT\d+)", True),
        ("arxiv", r"arxiv\.org/abs/([\d.]+(?:v\d+)?)", False),
        ("biorxiv", r"biorxiv\.org/content/(10\.1101/[\d.]+)", False),
        ("uniprot", r"(?i)uniprot\.org/uniprotkb/([A-Z0-9]+)", True),
        ("pubchem", r"pubchem\.ncbi\.nlm\.nih\.gov/compound/(\d+)", False),
    ]
    asset = is_asset(url)
    kind, ident = F.when(~asset, "url"), F.when(~asset, url)
    for name, pattern, upper in reversed(rules):
        found = F.regexp_extract(url, pattern, 1)
        value = normalize_doi(found) if name == "doi" else F.upper(found) if upper else found
        kind, ident = F.when(found != "", name).otherwise(kind), F.when(found != "", value).otherwise(ident)
    return kind, ident
