"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: a node is a path of elements (tag, classes and id, digits as one), and it gathers what its
elements show on each page: the sequence of children (its presentation) and its own texts (its content; text within links says nothing). A
node's importance follows from entropies over the m pages that have it. Presentation that is alike everywhere has importance 0, and
so have texts that stand on all pages; each of them grows to 1 where every page has its own:

    presentation = - sum over styles of share * log_m share        content = 1 - mean over texts of log_m(pages that have the text)
    importance = (1 - DECAY ^ l) * presentation + DECAY ^ l * content,  l: texts of the node on a page, in the mean

Nodes on at least LEAST_PAGES pages and on SITE_SHARE of the site's whose importance is below LOW are noise. They are the site's menus, notices and
frames; a page loses the branches made of them. What HTML declares by itself (tags, roles, classes) to be no content has no importance on any page, and
what it declares to be the article is the main text: within it only nodes with a class or an id of their own can be noise of the site. On a page where nothing would
be left, the tree can't tell (a host of one page, or of equal pages), and only what is declared goes.

One pass over the pages sends about a record of three hashes for each block of text; counts of equal ones are combined before and after the
shuffle. The noise of a site (at most the nodes of a page, in the mean, over SITE_SHARE) meets its pages in a second pass: Spark broadcasts
these lists while they are small, and splits hot hosts where it joins by shuffle.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, prepare, saved

LOW, DECAY, LEAST_PAGES, SITE_SHARE = 0.3, 0.9, 5, 0.1

# HTML's own elements, and words of classes, ids and roles.
RAW = "script style textarea title xmp iframe noembed noframes"
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea input dialog menu iframe object embed audio video canvas svg map title noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip status".split())
COMMENTS = frozenset("comment comments commentlist commentlists respond reply replies disqus discussion".split())
NOISE_WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising advertisements adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar search form masthead skip".split()
)
CONTENT_WORDS = frozenset("article content main body text entry post story".split())
#: An opening tag ends open elements of these kinds, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z].*\Z|<[!?/][^>]*(?:>|\Z)", re.S | re.I
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
DIGITS = re.compile(r"\d+")

ARTICLE, MAIN = 2, 1


def hashed(*parts: object) -> int:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(str(p).encode("utf-8", "surrogatepass") + b"\0")
    return int.from_bytes(h.digest(), "big", signed=True)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def declared(tag: str, a: dict[str, str], within: int) -> tuple[bool, int]:
    """(no content by its tag, role, class or id; ARTICLE, MAIN or 0) for an element in an article or main of the given kind."""
    roles = set(a.get("role", "").lower().split())
    kind = ARTICLE if tag == "article" or "article" in roles or a.get("itemprop", "") == "articleBody" else MAIN if tag == "main" or "main" in roles else 0
    if tag in NEVER or roles & NOISE_ROLES or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True, 0
    # each name of a class or an id says what its last known word says: main-menu is a menu, sidebar-content is content
    names = [[w.lower() for w in WORD.findall(name)] for name in f"{a.get('class', '')} {a.get('id', '')}".split()]
    known = [[w for w in words if w in NOISE_WORDS or w in CONTENT_WORDS] for words in names if words and words[0] not in ("has", "with", "no", "is")]
    says = {words[-1] for words in known if words}
    if says & COMMENTS and tag not in ("html", "body"):
        return True, 0
    if tag in ("html", "body") or tag in HEADINGS or kind or says & CONTENT_WORDS:
        return False, kind
    return bool(says & NOISE_WORDS) or not within and (tag == "header" or any("header" in words for words in names)), kind


class Open:
    """An open element."""

    __slots__ = ("tag", "node", "noise", "kind", "link", "own", "style", "last")

    def __init__(self, tag: str, node: int, noise: bool, kind: int, link: bool, own: bool):
        self.tag, self.node, self.noise, self.kind, self.link, self.own = tag, node, noise, kind, link, own
        self.style, self.last = 0, ""


class Page:
    """A parsed page. blocks: (node, kind, plain, text, text outside links) of what isn't declared to be noise, in order; styles: node -> its children's digests."""

    def __init__(self, html: str, host: int, nodes: dict):
        self.blocks: list[tuple[int, int, bool, str, str]] = []
        self.styles: dict[int, set[int]] = {}
        self.nodes = nodes
        self.open = [Open("", host, False, 0, False, False)]
        self.count: dict[str, int] = {}
        self.text: list[tuple[str, bool]] = []
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.add(html[at : m.start()])
            at = m.end()
            if m[3]:
                (self.close if m[2] else self.begin)(m[3].lower(), m[4])
        self.add(html[at:])
        while self.open:
            self.end()

    def add(self, text: str) -> None:
        top = self.open[-1]
        if not top.noise:
            self.text.append((text, top.link))

    def flush(self) -> None:
        """Ends a block of text, which belongs to the innermost block element."""
        if not self.text:
            return
        text = " ".join(unescape("".join(t for t, _ in self.text)).split())
        if text:
            own = text if not any(link for _, link in self.text) else " ".join(unescape("".join(t for t, link in self.text if not link)).split())
            top = self.open[-1]
            self.blocks.append((top.node, top.kind, not top.own, text, own))
        self.text = []

    def begin(self, tag: str, source: str) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            elif tag == "br":
                self.add(" ")
            return
        if tag in INLINE:
            top = self.open[-1]
            noise = top.noise or bool(source.strip()) and declared(tag, attributes(source), top.kind)[0]
            self.push(Open(tag, top.node, noise, top.kind, top.link or tag == "a", top.own))
            return
        self.flush()
        if self.count.get("p"):
            self.close("p", "")
        ends, bounds = CLOSES.get(tag, ((), ()))
        if any(self.count.get(t) for t in ends):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in bounds:
                    break
                if self.open[i].tag in ends and not (tag in ("td", "th") and self.open[i].tag == "tr"):
                    while len(self.open) > i:
                        self.end()
        top = self.open[-1]
        a = attributes(source) if source.strip(" /\n\t") else {}
        noise, kind = declared(tag, a, top.kind)
        look = DIGITS.sub("0", f"{tag}.{'.'.join(sorted(a.get('class', '').split()))}#{a.get('id', '')}") if a else tag
        node = self.nodes.get((top.node, look))
        if node is None:
            if len(self.nodes) > 100_000:
                self.nodes.clear()
            node = self.nodes[top.node, look] = hashed(top.node, look)
        if top.last != look:  # repeats of a child count as one
            top.style, top.last = hash((top.style, node)), look
        kind = max(kind, top.kind)
        own = kind > 0 and (top.own or kind == top.kind and bool(a.get("class") or a.get("id")))
        self.push(Open(tag, node, top.noise or noise, kind, top.link, own))

    def push(self, element: Open) -> None:
        self.open.append(element)
        self.count[element.tag] = self.count.get(element.tag, 0) + 1

    def end(self) -> None:
        if self.open[-1].tag not in INLINE:
            self.flush()
        top = self.open.pop()
        self.count[top.tag] = self.count.get(top.tag, 0) - 1
        if top.tag not in INLINE and not top.noise:
            self.styles.setdefault(top.node, set()).add(top.style)

    def close(self, tag: str, _: str) -> None:
        if self.count.get(tag, 0) <= 0:
            return
        if tag in INLINE:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i]  # what is open within it goes on
                    self.count[tag] -= 1
                    return
                if self.open[i].tag not in INLINE:
                    return
            return
        self.flush()
        while self.open[-1].tag != tag:
            self.end()
        self.end()

    def main_text(self, noise: frozenset[int]) -> str:
        kind = max((k for _, k, *_ in self.blocks), default=0)
        main = [b for b in self.blocks if b[1] == kind]
        left = [text for node, k, plain, text, _ in main if node not in noise or k and plain]
        return "\n".join(left or [b[3] for b in main])


def host_of(url: Column) -> Column:
    """Lower-case host of an address, '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]*)", 1), F.lit("")))


def features(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> node, host, kind (0: presentation, 1: content), feature: once for each page."""

    def run(batches):
        nodes: dict = {}
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(html or "", host, nodes)
                out += [(node, host, 0, hashed(*sorted(styles))) for node, styles in page.styles.items()]
                out += {(node, host, 1, hashed(own)) for node, _, _, _, own in page.blocks if own}
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["node", "host", "kind", "feature"])

    return pages.mapInArrow(run, "node bigint, host bigint, kind int, feature bigint")


def style_tree(found: DataFrame) -> DataFrame:
    """features -> a row for each node of each site: host, node, pages, importance (presentation, content and both)."""
    counts = found.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    shown, told = F.col("kind") == 0, F.col("kind") == 1
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(shown, F.col("n"))).alias("pages"), F.sum(F.when(shown, F.col("n") * F.ln("n"))).alias("styles"),
        F.count_if(told).alias("texts"), F.coalesce(F.sum(F.when(told, F.ln("n"))), F.lit(0.0)).alias("repeats"), F.sum(F.when(told, F.col("n"))).alias("told"),
    )
    log = F.ln("pages")
    presentation = F.when(F.col("pages") > 1, 1 - F.col("styles") / F.col("pages") / log).otherwise(1.0)
    content = F.when(F.col("texts") == 0, 0.0).when(F.col("pages") > 1, 1 - F.col("repeats") / F.col("texts") / log).otherwise(1.0)
    weight = F.pow(F.lit(DECAY), F.when(F.col("texts") > 0, F.col("told") / F.col("pages")).otherwise(0.0))
    importance = (1 - weight) * presentation + weight * content
    return nodes.select("host", "node", "pages", presentation.alias("presentation"), content.alias("content"), importance.alias("importance"))


def site_noise(tree: DataFrame) -> DataFrame:
    """style_tree -> host, noise: array of the nodes that are noise there."""
    size = tree.filter(F.col("host") == F.col("node")).select("host", F.col("pages").alias("site_pages"))
    low = (F.col("importance") < LOW) & (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), SITE_SHARE * F.col("site_pages")))
    return tree.join(size, "host").filter(low & (F.col("host") != F.col("node"))).groupBy("host").agg(F.collect_list("node").alias("noise"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) -> the same columns, text, n_chars (its code points).

    text: the blocks of the article (or, where the page has none, of all that is no noise), white space as one space, references decoded, joined by
    line breaks. Null or empty html gives ''. Pages without a host (null url) share no site; what is declared to be noise goes there too. Equal pages each give their text; ids play
    no part. Columns of pages called text or n_chars give way. An empty table gives none.
    """
    prepare(pages.sparkSession)
    host, noise = (free_name(x, pages.columns) for x in ("host", "noise"))
    named = host_of(F.col("url"))
    # pages without a host: each its own site
    sited = pages.withColumn(host, F.when(named == "", F.xxhash64(F.col("html"), F.lit(""))).otherwise(F.xxhash64(named)))
    tree = saved(style_tree(features(sited.select(F.col(host).alias("host"), F.col("html").cast("string")))))
    lists = saved(site_noise(tree).select(F.col("host").alias(host), F.col("noise").alias(noise)))
    joined = sited.join(lists, host, "left")
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    schema = joined.select(*kept).withColumn("text", F.lit("")).schema

    def run(batches):
        nodes: dict = {}
        known: dict[int, frozenset[int]] = {}
        for b in batches:
            n = b.num_columns
            hosts, lists, htmls = (b.column(n - i) for i in (3, 2, 1))
            texts = []
            for i, (h, html) in enumerate(zip(hosts.to_pylist(), htmls.to_pylist())):
                if h not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[h] = frozenset(lists[i].as_py() or ())
                texts.append(Page(html or "", h, nodes).main_text(known[h]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n - 3)), pa.array(texts, pa.string())], [*kept, "text"])

    result = joined.select(*kept, host, noise, F.col("html").cast("string").alias(free_name("page", pages.columns))).mapInArrow(run, schema)
    discard(pages.sparkSession, tree)
    return result.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The pages of the tables have one article of headings and paragraphs each, with few kinds of references; SQL can take these apart.
ORACLE = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS h FROM pages),
b AS (SELECT *, list_transform(string_split(regexp_replace(h, '(?i)</?(h1|p)>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '(?i)<br>', ' ', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '</?[a-zA-Z][^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g'), chr(160), ' ')) AS parts FROM b),
d AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x85]+', ' ', 'g'))) AS parts FROM c),
e AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM e
"""
