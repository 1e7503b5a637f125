"""op11, op12 and op13 against plain versions on small tables with nulls, empties, ties, repeats and extra columns."""

import html as stdlib_html
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, divergence, hard_negatives, html_extraction, substring_dedup, suffix_dedup, topk
from tessera.llm.html_extraction import Page

ROOT_HOST = 7


def text_of(page, noise=frozenset()):
    return Page(page, ROOT_HOST, {}).main_text(noise)


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("just words &amp; more", "just words & more"),
        ("<article><h1>A &lt;b&gt;</h1><p>one\n two<p>three<br>four</article><footer>no</footer>", "A <b>\none two\nthree four"),
        ("<body><nav><a href=x>menu</a></nav><div class=ad>buy</div><p>text <b>bold <i>both</b> on</i></p></body>", "text bold both on"),
        ("<article><p>in<aside>no</aside><div class='cookie-bar'>no</div>on</article><p>out", "in\non"),
        ("<main><p>m</p><article><p>a</p></article></main>", "a"),
        ("<article><p>a</p><section id=comments><p>first!</p></section><ol class='commentlist'><li>x</ol></article>", "a"),
        ("<article><header><h1>head</h1></header><p>a</p></article><header>site</header>", "head\na"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x</p><!-- <p>no</p> --><textarea>t</textarea>", "x"),
        ("<p title='a > b'>x</p><p class=\"unclosed>y</p>", "x"),
        ("1 < 2 <3 &notanentity; &copy &#8364;", "1 < 2 <3 ¬anentity; © €"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a\nb\nc\nd\ne\nf\ng"),
        ("<div class='main-menu'>no</div><div class='sidebar-content'>yes</div><body class='has-sidebar'>yes", "yes\nyes"),
        ("</div></p><p>x</p></article>", "x"),
        ("<p>a&nbsp; \t b</p><p>&nbsp;</p>", "a b"),
        ("<form>q</form><p hidden>h</p><p style='display: none'>h</p><div role=banner>h</div><p>x", "x"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p>" + "long " * 200_000, ("long " * 200_000).strip()),
    ],
)
def test_page(page, expected):
    assert text_of(page) == expected


def site_page(rnd, i):
    words = lambda n: " ".join(f"w{rnd.randint(0, 10_000)}" for _ in range(n))
    return (
        f"<html><body><div class=x1><a href=/{i}>{words(2)}</a> <a href=/>{words(1)}</a></div><div class=x2>Read us daily</div>"
        f"<div class=x3><p>{words(20)}</p><p>{words(9)}</p><p>Read us daily</p></div><div class=x4><span>All rights</span></div></body></html>"
    )


def test_site_style_tree_finds_what_pages_share(spark):
    """Without an article or a telling class, only the tree knows: x1 (links), x2 and x4 (the same everywhere) go, a repeated paragraph among others stays."""
    rnd = random.Random(3)
    rows = [(i, f"https://User@Big.Example:80/{i}", site_page(rnd, i), "extra") for i in range(40)]
    rows += [(50, "http://lone.example/", site_page(rnd, 50), "extra"), (51, None, site_page(rnd, 51), "extra"), (52, "http://big.example/", None, None), (None, "http://big.example/", "", None)]
    same = site_page(rnd, 60)
    rows += [(60 + i, "http://same.example/", same, "extra") for i in range(8)]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, noise string")).collect()}
    for i in range(40):
        whole = re.findall(r"<p>(.*?)</p>", rows[i][2])
        assert got[i]["text"] == "\n".join(whole) and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["noise"] == "extra"
    # a site of one page, none, or equal pages: the tree can't tell
    assert "All rights" in got[50]["text"] and "All rights" in got[51]["text"] and len({got[60 + i]["text"] for i in range(8)}) == 1
    assert all(re.search(r"<p>(.*?)</p>", same)[1] in got[60 + i]["text"] for i in range(8))
    assert got[52]["text"] == "" and got[None]["text"] == "" and got[None]["n_chars"] == 0
    none = html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0


def test_importance_against_plain_entropies(spark):
    import math

    rnd = random.Random(4)
    pages = [site_page(rnd, i) for i in range(12)]
    table = spark.createDataFrame([(5, p) for p in pages], "host long, html string")
    got = {r["node"]: r for r in html_extraction.style_tree(html_extraction.features(table)).collect()}
    styles, texts = defaultdict(list), defaultdict(Counter)
    for p in pages:
        page = Page(p, 5, {})
        for node, s in page.styles.items():
            styles[node].append(tuple(sorted(s)))
        for node, own in {(b[0], b[4]) for b in page.blocks if b[4]}:
            texts[node][own] += 1
    assert set(got) == set(styles)
    for node, seen in styles.items():
        m = len(seen)
        pres = -sum(n / m * math.log(n / m, m) for n in Counter(seen).values()) if m > 1 else 1.0
        cont = 1 - sum(math.log(n, m) for n in texts[node].values()) / len(texts[node]) if texts[node] and m > 1 else float(bool(texts[node]))
        weight = 0.9 ** (sum(texts[node].values()) / m)
        assert got[node]["pages"] == m and got[node]["importance"] == pytest.approx((1 - weight) * pres + weight * cont, abs=1e-9)


def negatives_by_brute_force(rows, anchor):
    import math

    ok = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(ok):
        if not anchor(i):
            continue
        scored = [(min(max(sum(x * y for x, y in zip(v, w)), -(1 << 63)), (1 << 63) - 1), j, m, k) for m, (j, k, w) in enumerate(ok) if m != n and len(w) == len(v)]
        order = sorted(scored, key=lambda x: (-x[0], x[1], x[2]))
        for s, j, _, k in [x for x in order if x[3] == label][:5]:
            fit = [x for x in order if x[3] != label and 30 * s <= 100 * x[0] <= 90 * s][:10]
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("seed, blocks", [(1, 4 << 20), (2, 2000)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed, blocks):
    rnd = random.Random(seed)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", blocks)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", blocks * 4)
    monkeypatch.setattr(hard_negatives, "columnar", (lambda f: lambda rows, size=blocks, *a: f(rows, size, *a))(hard_negatives.columnar))
    vector = lambda d: [rnd.choice([-1, 1]) * round(rnd.random(), 2) for _ in range(d)]
    rows = [(i, vector(11), rnd.randint(0, 3)) for i in range(300)]
    rows += [(300 + i, [0.5] * 11, 1) for i in range(60)]  # many ties
    rows += [rows[10], rows[10], (10, vector(11), 2), (20, rows[30][1], rows[30][2])]  # repeated rows and ids
    rows += [(400, None, 1), (401, [], 1), (410, [], 1), (402, [None] * 11, 1), (403, [float("nan")] * 11, 2), (404, [float("inf")] * 11, 2), (None, vector(11), 1), (406, vector(11), None)]
    rows += [(500 + i, vector(3), i % 2) for i in range(20)] + [(600, [1e30] * 11, 1), (601, [1e30] * 11, 1), (602, [3e15] * 11, 2), (603, [7e14] * 11, 2), (604, [2e20] * 11, 1)]
    table = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "vec_id long, embedding array<double>, label int, row string, dim string").repartition(3)
    clamp = lambda x: x if x is None or x != x or abs(x) == float("inf") else min(max(x, -(2.0**63) / 256), (2.0**63 - 1024) / 256)
    held = [(i, v and [clamp(x) for x in v], l) for i, v, l in rows]
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).select(cols).collect())
    assert got == negatives_by_brute_force(held, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, F.lit(False)).count() == 0


def audit_by_brute_force(rows):
    low = str.maketrans(divergence.UPPER, divergence.UPPER.lower())
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, groups = Counter(), defaultdict(Counter)
        for g, source, terms in docs:
            if g == lang:
                df.update(set(terms))
                groups[source].update(terms)
        vocabulary = [t for t, n in df.items() if n >= 3]
        total = Counter()
        for c in groups.values():
            total.update(c)

        def shares(c):
            n = sum(c[t] for t in vocabulary)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(vocabulary)) for t in vocabulary}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in vocabulary), o.encode()) for o in groups if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in vocabulary if groups[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(terms[:200])}
    return out


@pytest.mark.parametrize("spill, tile, piece", [(400_000, 256, 1 << 20), (30, 2, 16)])
def test_divergence_against_brute_force(spark, monkeypatch, spill, tile, piece):
    for name, value in (("SPILL", spill), ("TILE", tile), ("TILES", 2), ("PIECE", piece)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "Straße", "日本", "Zz", "zz"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", "d", "é", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 40))).replace(" ", rnd.choice([" ", ",", "\n1"]))) for _ in range(150)]
    rows += [("en", "hot", "Hot hot words. " * 500)] * 40 + [("en", "quiet", "123 ..."), ("en", "quiet", None), ("xx", "s", "once"), ("xx", "t", ""), ("yy", "s", None)]
    table = spark.createDataFrame([(i % 7, text, lang, source, "extra", 1) for i, (lang, source, text) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long").repartition(3)
    got = divergence.divergences(table).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == audit_by_brute_force(rows)
    assert divergence.divergences(table.limit(0)).count() == 0


def test_pages_of_the_tables_give_their_article(spark):
    """Against a plain version for their one template: blocks of the article, references decoded by the standard library."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_extraction.op11(spark, "/root/testdata/sf0.001").join(pages.select("page_id", "html"), "page_id").collect():
        blocks = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        plain = (" ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)
        assert r["text"] == "\n".join(x for x in plain if x)


# --- op1, op9: rows that share an id, or have none -------------------------------------------------------------------
def passages_of(doc_id_and_text):
    """Plain versions for rows in any order: op1 as documents (id, text) by id, those of one id in the order found; op9 by rows."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    docs = spark.createDataFrame(doc_id_and_text, "doc_id long, text string").repartition(3)
    words = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring_dedup.substring_dedup(docs).collect()]
    cut = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs).collect()]
    return words, cut


def test_equal_rows_beside_a_similar_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    more = text + " zz yy xx"
    words, cut = passages_of([(7, text), (7, text), (9, more)])
    # both rows 7 are one document, which keeps its words; row 9 keeps what stands nowhere else
    assert sorted(words) == [(7, 60, 0, text), (7, 60, 0, text), (9, 63, 60, "zz yy xx")]
    assert sorted(cut) == [(7, len(text), len(text)), (7, len(text), len(text)), (9, len(more), len(text))]
    # many equal rows without an id, and one alone
    words, cut = passages_of([(None, more)] * 300 + [(None, "a b"), (1, text)])
    assert Counter(w[2] for w in words) == {0: 301, 60: 1} and Counter(c[2] for c in cut) == {len(more): 300, 0: 1, len(text): 1}


def test_null_ids_with_equal_short_hashes(spark):
    """Two texts of one 32-bit hash, without ids: each keeps what stands nowhere else."""
    probe = " ".join(f"v{i}" for i in range(31))
    table = spark.range(0, 400_000).select(F.concat(F.lit(probe + " n"), F.col("id").cast("string")).alias("a")).withColumn("h", F.hash("a"))
    other = spark.range(0, 400_000).select(F.concat(F.lit(" ".join(f"u{i}" for i in range(60)) + " m"), F.col("id").cast("string")).alias("b")).withColumn("h", F.hash("b"))
    pair = table.join(other, "h").orderBy("a", "b").first()
    assert pair is not None
    third = " ".join(pair["a"].split()[5:]) + " tail"
    words, cut = passages_of([(None, pair["a"]), (None, pair["b"]), (5, third)])
    assert sorted(w[2] for w in words) == [0, 0, 27]
    assert dict((c[1], c[2]) for c in cut)[len(pair["b"])] == 0


def test_repeated_ids_by_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"q{i}" for i in range(400)]
    passages = [" ".join(rnd.choices(vocabulary, k=50)) for _ in range(3)]
    rows = [(rnd.choice([None, 1, 2, 3]), f"{' '.join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))} {rnd.choice(passages)} {' '.join(rnd.choices(vocabulary, k=3))}") for _ in range(40)]
    rows += [rows[i] for i in (0, 0, 5, 9)]
    words, _ = passages_of(rows)
    order = {(i, t): tuple(k) for i, t, *k in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")).collect()}
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r])):
        w, gone = t.split(), set()
        for s in range(len(w) - 19):
            gram = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if gram in seen else set()
            seen.add(gram)
        want[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert Counter(words) == Counter((i, *want[i, t]) for i, t in rows)


# --- op6, components -------------------------------------------------------------------------------------------------
def test_top_k_by_groups_of_queries(spark, monkeypatch):
    """Several groups and blocks; one vector that fills more than a block; empty vectors, which have the product 0 with each other."""
    for name, value in (("QUERY_BLOCK", 4), ("VECTOR_BLOCK", 16), ("GROUP_BYTES", 300), ("TILE", 5)):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(90)] + [(200 + i, [0.5] * 6) for i in range(70)] + [(400 + i, []) for i in range(15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.top_k(topk.whole_vectors(table), F.col("vec_id") % 5 == 0, 7).select("query_id", "rank", "vec_id", "score").collect()]
    whole = {i: [int(1024 * x // 1) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 5 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)


def test_components_of_a_hub(spark):
    rnd = random.Random(4)
    edges = [(1000, i) for i in range(300)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(60)] + [(i, i + 1) for i in range(3000, 3040)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    """SimHash links the near copies within 3 bits, the exact check drops what is not at 4/5, and near_dedup takes these links."""
    from tessera.llm import simhash

    words = [f"word{i}" for i in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["end"])), (3, " ".join(words)), (4, " ".join(f"other{i}" for i in range(600))), (5, "a b c d e f"), (6, "A b  c d e f")]
    docs = spark.createDataFrame(rows, "node long, text string")
    found = simhash.fingerprint_links(docs, simhash.saved(simhash.shingle_sets(docs, simhash.NEAR_WORDS))).collect()
    roots = {n: n for n, _ in rows}
    for u, v in found:
        roots = {n: min(roots[u], roots[v]) if r in (roots[u], roots[v]) else r for n, r in roots.items()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    unlike = simhash.shingle_sets(docs.withColumn("text", F.concat("text", F.col("node").cast("string"))).withColumn("text", F.sha2("text", 256)), simhash.NEAR_WORDS)
    assert simhash.fingerprint_links(docs, simhash.saved(unlike)).count() == 0  # alike by fingerprint, not by their sets
    asked = []
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda texts, sets: asked.append(1) or links(texts, sets))
    kept = simhash.near_dedup(docs.withColumnRenamed("node", "doc_id"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5] and asked == [1]
