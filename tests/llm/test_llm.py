"""Operators of tessera.llm against brute force on small tables with nulls, empties, ties, repeats and extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, components, exact_dedup, langid, mixing, pii, simhash, substring_dedup, suffix_dedup, topk, toxicity
from tessera.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string"


def corpus():
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(60)] + ["ä€", "x.y", "Zz"]
    passage = " ".join(rnd.choices(words, k=60))
    out = [None, "", " \n", "a" * 450, "ab " * 150]
    for _ in range(50):
        body = " ".join(rnd.choices(words, k=rnd.randint(1, 120)))
        out.append(body if rnd.random() < 0.6 else f"{body} {passage} {rnd.choice(words)}")
    out += [out[7], out[7], out[12], out[12].replace("w1", "w2")]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "src%d" % (i % 3), 1, "extra", "extra") for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def brute_substring(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def brute_suffix(rows, window=200):
    texts = {i: (t or "").encode() for i, t in rows}
    count = Counter(t[s : s + window] for t in texts.values() for s in range(len(t) - window + 1))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - window + 1):
            if count[t[s : s + window]] > 1:
                gone[s : s + window] = True
        out[i] = (len(t), int(gone.sum()), bytes(b for b, g in zip(t, gone) if not g))
    return out


def test_substring(docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_substring(corpus())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_hot(docs, monkeypatch):
    from tessera.llm import repeats

    monkeypatch.setattr(repeats, "HOT", {"words": 1, "bytes": 1})
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_substring(corpus())


def test_reference_automata(spark, docs):
    ref = spark.createDataFrame([(corpus()[7][1],), (None,)], "text string")
    found = {r["doc_id"]: r["removed"] for r in substring_dedup.matching_spans(docs, ref, 5).collect()}
    n = len(corpus()[7][1].split())
    assert [(r["start"], r["end"]) for r in found[7]] == ([(0, n)] if n >= 5 else []) and found[0] == []


def test_suffix(docs, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_suffix(corpus())
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_exact(docs, empty, spark):
    rows = corpus()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha((t or "").encode())) for i, t in rows}
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(twice).collect()) == [(-1, 3, False), (1, 3, True), (1, 3, True), (2, 1, True)]
    assert sorted(r["text"] for r in exact_dedup.keep_one(twice).collect()) == ["a", "b"]


def test_mixing(docs, empty):
    rates = mixing.target_rates(docs)
    assert mixing.mix(empty).count() == 0
    got = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    rate = {r["source"]: r["rate"] for r in rates.collect()}
    for i, _ in corpus():
        u = (int(hashlib.md5(f"{mixing.SEED}:n:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, c = 0, np.exp(-rate[f"src{i % 3}"]), 0.0
        while c + p < u:
            c, k = c + p, k + 1
            p *= rate[f"src{i % 3}"] / k
        assert got[i] == k
    order = [r["shuffle_key"] for r in mixing.mix(docs).collect()]
    assert order == sorted(order)


def test_mixing_small_source(spark):
    """Two rows beside 1,998 of another source give half of the copies, by the exact inverse at rate 500."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "small").otherwise("hot").alias("source"))
    assert {r["source"]: r["rate"] for r in mixing.target_rates(docs).collect()} == {"small": 500.0, "hot": 2000 / 2 / 1998}
    got = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    for i in range(2):
        u = (int(hashlib.md5(f"{mixing.SEED}:n:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, c = 0, np.exp(-500.0), 0.0
        while c + p < u:
            c, k = c + p, k + 1
            p *= 500 / k
        assert got[i] == k > 400


def test_pii(spark):
    rnd = random.Random(3)
    parts = ["a@b.co", "x@y", "a@b.c_x@d.e", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4467920212765298", "4111 1111 1111 1111", "+1 (663) 555-6869", "+44", "é", " ", "call ", "12-34", "GB82 WEST 1234 5698 7654 32", "..", "@"]
    texts = [None, "", "q" * 50_000] + ["".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(300)]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        t = texts[r["doc_id"]] or ""
        want = sorted((m.start(), list(plain).index(k), m.end()) for k, p in plain.items() for m in re.finditer(p, t) if ok(k, m.group()))
        assert [(s["start"], s["kind_no"], s["end"]) for s in r["spans"] if s["kind_no"] < 4] == want, t
    assert pii.find_pii(docs.limit(0)).count() == 0
    iban = spark.createDataFrame([(1, "account GB82 WEST 1234 5698 7654 32 ok"), (2, "GB83 WEST 1234 5698 7654 32")], "doc_id long, text string")
    assert [[s["kind"] for s in r["spans"] if s["kind_no"] > 3] for r in pii.find_pii(iban).orderBy("doc_id").collect()] == [["iban"], []]


def test_bpe(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.BytePairs(ranks, P.PATTERN)
    rnd = random.Random(1)
    alphabet = "abcdefgh ABC éüß€日本🙂\n\t\x1c\x85 '0123456789.,!?sdtm"
    for n in [0, 1, 2, 5, 20, 100] * 60 + [4000]:
        t = "".join(rnd.choices(alphabet, k=n))
        assert ours.encode(t) == enc.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()
    for r in bpe.encode_documents(docs).collect():
        t = dict(corpus())[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()


def test_simhash(docs, empty):
    def fp(t):
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fp(t or "") for i, t in corpus()}
    root = components.Forest()
    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                root.union(i, j)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (prints[i], root.find(i)) for i in prints}
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_chunked_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 3)
    rnd = random.Random(2)
    base = rnd.getrandbits(63)
    fps = [base ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) for _ in range(30)] + [rnd.getrandbits(63) for _ in range(30)]
    points = spark.createDataFrame([(f, f, bytearray()) for f in sorted(set(fps))], "node long, fp long, wide binary")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(points)).collect()}
    root = components.Forest()
    for a in set(fps):
        for b in set(fps):
            if a < b and (a ^ b).bit_count() <= 3:
                root.union(a, b)
    assert {f: got.get(f, f) for f in fps} == {f: root.find(f) for f in fps}


def test_near_dedup(spark):
    rnd = random.Random(9)
    words = ["t%d" % i for i in range(3000)]
    texts = [" ".join(rnd.choices(words, k=200)) for _ in range(30)]
    near = []
    for t in texts[:10]:
        w = t.split()
        w[50] = "changed"
        near.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts + near + [None, ""])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == [*range(30), 40, 41]


def test_near_dedup_decides_by_similarity(spark):
    """Edited copies on both sides of similarity 0.8: nothing below it goes, and over nine in ten of those that should go do."""
    rnd = random.Random(11)
    words = ["t%d" % i for i in range(3000)]
    texts = {}
    for base in range(60):
        w = rnd.choices(words, k=rnd.randint(120, 400))
        texts[2 * base] = " ".join(w)
        for at in rnd.sample(range(len(w)), max(1, len(w) * (base % 6 + 1) // 150)):
            w[at] = "changed%d" % at
        texts[2 * base + 1] = " ".join(w)

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: grams(t) for i, t in texts.items()}
    close = {i + 1 for i in range(0, 120, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])}
    assert 20 < len(close) < 55
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    gone = set(texts) - kept
    assert gone <= close and len(gone) >= 0.9 * len(close)


def test_near_dedup_appended_and_cut(spark):
    """Copies with a paragraph added or cut at similarity 0.8 and more, beside a line that many rows share: all are candidates."""
    rnd = random.Random(13)
    words = ["z%d" % int(rnd.paretovariate(0.7)) for _ in range(20_000)]
    line = " ".join(rnd.choices(words, k=12))
    texts = {}
    for base in range(150):
        w = rnd.choices(words, k=(20, 60, 150, 400, 1500)[base % 5]) + (line.split() if base % 3 == 0 else [])
        more = rnd.choices(words, k=int(len(w) * rnd.uniform(0.02, 0.28)))
        short, long = " ".join(w), " ".join(w + more if base % 4 < 2 else more + w)
        texts[2 * base], texts[2 * base + 1] = (short, long) if base % 2 else (long, short)

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: grams(t) for i, t in texts.items()}
    close = {i + 1 for i in range(0, 300, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])}
    assert 90 < len(close) < 145
    rows = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "node long, text string, part long")
    likely = rows.join(simhash.head_nodes(rows, 5), "node", "left_semi")
    root = {r["node"]: r["root"] for r in components.components(simhash.prefix_links(simhash.saved(simhash.shingle_sets(likely, 5, "part")))).collect()}
    assert all(i in root and root[i] == root.get(i - 1) for i in close)
    kept = {r["doc_id"] for r in simhash.near_dedup(rows.select(F.col("node").alias("doc_id"), "text")).collect()}
    gone = set(texts) - kept
    assert gone <= close and len(gone) > 0.98 * len(close)


def test_near_dedup_repeated_line(spark):
    """A copy that repeats a line of its text many times has nearly the same set of shingles and goes."""
    rnd = random.Random(17)
    texts = []
    for base in range(40):
        w, line = ([f"r{rnd.randrange(3000)}" for _ in range(n)] for n in ((150, 400)[base % 2], 12))
        texts += [" ".join(w + line), " ".join(w + line * (2 + base % 20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == [*range(0, 80, 2)]


def test_similar_is_exact(spark):
    texts = [(1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l"), (3, "a b c d e f g h i"), (4, "a b"), (5, "A  b"), (6, "a c")]
    pairs = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6)]
    got = simhash.similar(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(texts, "node long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (4, 5)]


def test_families_by_brute_force(spark, monkeypatch):
    """One large family: pivots, a tree of several chunks and the rest in several chunks give the components of all pairs."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(200):
        w = list(base)
        for at in rng.choice(80, size=int(rng.integers(0, 5)), replace=False):
            w[at] = f"x{i}_{at}"
        texts.append((i, " ".join(w), 0))
    grams = [{tuple(t.split()[j : j + 5]) for j in range(76)} for _, t, _ in texts]
    forest = components.Forest()
    for i in range(200):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                forest.union(i, j)
    want = {i: forest.find(i) for i in range(200)}
    assert 1 < len(set(want.values())) < 200
    sets = simhash.saved(simhash.shingle_sets(spark.createDataFrame(texts, "node long, text string, root long"), 5, "root"))
    for chunk, family, pivots in ((1 << 18, 1000, 8), (2000, 1000, 8), (2000, 64, 1), (1 << 18, 64, 8)):
        for name, value in (("CHUNK", chunk), ("FAMILY", family), ("PIVOTS", pivots)):
            monkeypatch.setattr(simhash, name, value)
        first = simhash.saved(simhash.pivot_links(sets))
        links = first.unionByName(simhash.family_links(sets, components.components(first).withColumnRenamed("root", "tree")))
        got = {r["node"]: r["root"] for r in components.components(links).collect()}
        assert {i: got.get(i, i) for i in range(200)} == want, (chunk, family, pivots)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    rows += [(900, None), (1000, [float("nan")] * 8), (1100, [None] * 8), (1200, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(topk.whole_vectors(frame), F.col("vec_id") % 100 == 0).collect())
    ints = {i: np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, v in rows[:420]}
    want = []
    for q in range(0, 420, 100):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(topk.whole_vectors(frame.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_language_held_out(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(d).filter("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[0] == got[1] == got[2] == "und" and set(got.values()) == {"und", "en"}
    assert langid.identify(empty).count() == 0


def test_language_rare(spark):
    """A language of 3 in 40,003 rows is learned beside a hot one."""
    hot = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the quick brown fox number "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(50_000 + i, "žluťoučký kůň pěl ďábelské ódy", "cs") for i in range(3)], "doc_id long, text string, lang string")
    filters = langid.fit(hot.unionByName(rare), 100)
    assert filters.languages == ["en", "cs"]
    assert filters.decide("kůň pěl ódy")[0] == "cs" and filters.decide("the brown fox")[0] == "en"


def test_toxicity_held_out(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(d, labels.filter(~held_out()))
    rows = toxicity.score(d.filter(held_out()), model).join(labels, "doc_id").collect()
    assert np.mean([r["score"] >= 0.3 for r in rows if r["toxic"]]) > 0.85
    assert np.mean([r["score"] >= 0.3 for r in rows if not r["toxic"]]) < 0.03
    nothing = toxicity.fit(empty.select("doc_id", "text"), labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(d.limit(3), nothing).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r["doc_id"] for r in source.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, d).collect()
    assert out and {r["doc_id"] for r in out} <= ids
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    assert all(r["decoded_sha256"] == sha((texts[r["doc_id"]] or "").encode()) for r in out)
