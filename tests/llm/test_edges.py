"""Edges, digest columns and methods of tessera.llm against plain versions: nulls, repeats, ties, clashing names, several shards, blocks and micro-batches."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, common, components, exact_dedup, langid, mixing, pii, repeats, simhash, substring_dedup, suffix_dedup, topk, toxicity
from tests.llm.test_llm import brute_suffix

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def real(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]


# --- op1, op9 --------------------------------------------------------------------------------------------------------
def brute_words(rows, window=20):
    """Rows in order: a window counts as a repeat if an earlier row, or the same one before, has it."""
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shared_passages():
    rnd = random.Random(21)
    words = [f"p{i}" for i in range(500)]
    passages = [" ".join(rnd.choices(words, k=70)) for _ in range(3)]
    out = []
    for i in range(120):
        parts = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(2)]
        out.append((i, f"{parts[0]} {passages[i % 3]} {parts[1]}" if i % 4 else parts[0]))
    return out


@pytest.mark.parametrize(("hot", "units", "block"), [(2000, 400, 1 << 17), (3, 10**9, 1 << 17), (1, 400, 16), (2000, 10**9, 64)])
def test_passages_by_every_path(spark, monkeypatch, hot, units, block):
    """Several shards, hot anchors decided passage by passage, and texts longer than a block."""
    monkeypatch.setattr(repeats, "HOT", {"words": hot, "bytes": hot})
    monkeypatch.setattr(repeats, "SHARD_UNITS", {"words": units, "bytes": units})
    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = shared_passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == brute_words(rows)
    want = brute_suffix(rows)
    found = suffix_dedup.suffix_dedup(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found} == want
    for r in found:
        gone = [False] * r["n_bytes"]
        for x in r["removed"]:
            gone[x["start"] : x["end"]] = [True] * (x["end"] - x["start"])
        assert r["n_spans"] == len(r["removed"]) == len(re.findall("1+", "".join("1" if g else "0" for g in gone))) and sum(gone) == r["n_removed"]


def test_passages_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, "x " + text), (3, text), (3, "y " + text), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert [x[1] for x in got] == [60, 61, 60, 61, 0] and sum(x[2] for x in got) == 180 and all(x[2] == 60 for x in got if x[0] == 3)
    assert sorted(r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect()) == [0, len(text), len(text), len(text) + 1, len(text) + 1]  # the space before it too


def test_reference_shards(spark, monkeypatch):
    """Automata of several shards are built by tasks and broadcast; too many words of references raise."""
    rows = shared_passages()
    monkeypatch.setattr(substring_dedup, "REFERENCE_SHARD", 100)
    ref = spark.createDataFrame([(t,) for _, t in rows[:12]], "text string")
    assert substring_dedup.reference_automata(ref).count() > 2
    grams = {tuple(t.split()[s : s + 20]) for _, t in rows[:12] for s in range(len(t.split()) - 19)}
    got = {r["doc_id"]: sum(x["end"] - x["start"] for x in r["removed"]) for r in substring_dedup.matching_spans(spark.createDataFrame(rows, "doc_id long, text string"), ref).collect()}
    for i, t in rows:
        w = t.split()
        gone = {j for s in range(len(w) - 19) if tuple(w[s : s + 20]) in grams for j in range(s, s + 20)}
        assert got[i] == len(gone)
    monkeypatch.setattr(substring_dedup, "MAX_REFERENCE_WORDS", 5)
    with pytest.raises(ValueError, match="too many"):
        substring_dedup.matching_spans(ref.withColumn("doc_id", F.lit(1)), ref)


# --- op2 -------------------------------------------------------------------------------------------------------------
def test_language_filters_by_plain_counts(spark):
    """Filters, false-positive rates and corrected counts computed anew with sets and loops."""
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat", "en"), ("the dog sat there", "en"), ("der hund sass da", "de"), ("die katze sass dort, der hund", "de"), (None, "de"), ("12 34", "fr")] * 2)]
    filters = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == ["de", "en"]  # as many rows with a text; no letter teaches nothing

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower()).ljust(langid.N)
        out = []
        for s in range(len(t) - langid.N + 1):
            h = 0
            for c in t[s : s + langid.N]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
            h ^= h >> 32
            h = h * 0xD6E8FEB86659FD93 % (1 << 64)
            out.append(h ^ h >> 29)
        return out

    slots = lambda h: [h >> s & langid.SLOTS - 1 for s in (0, 20, 40)]
    bits = {}
    for lang in filters.languages:
        count = Counter(g for _, t, l in rows if l == lang and t for g in set(grams(t)))
        bits[lang] = {s for g, n in count.items() if n >= 2 for s in slots(g)}
    text = "the hund and katze sat"
    plain = []
    for lang in filters.languages:
        rate = (len(bits[lang]) / langid.SLOTS) ** 3
        hits = sum(all(s in bits[lang] for s in slots(g)) for g in grams(text))
        plain.append(max(hits - len(grams(text)) * rate, 0) / (1 - rate))
    assert np.allclose(filters.counts(text), plain) and max(plain) > 0
    assert filters.decide(text) == (filters.languages[int(np.argmax(plain))], pytest.approx(max(plain) / sum(plain)))
    assert filters.decide("") == filters.decide(None) == filters.decide("1 2") == ("und", 0.0) and filters.decide("zzzzzz") == ("de", 0.0)


def test_language_blocks_names_and_repeats(spark, monkeypatch):
    text = "the cat sat on the mat " * 40
    whole = np.concatenate(list(langid.gram_blocks(text)))
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert (np.concatenate(list(langid.gram_blocks(text))) == whole).all()
    docs = spark.createDataFrame([(1, text, "en", "own", "a"), (1, text, "en", "own", "a"), (None, None, None, "x", "b")], "doc_id long, text string, lang string, lang_pred string, Score string")
    out = langid.identify(docs)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "Score", "lang_pred_", "score_", "held_out"]
    assert sorted((r["lang_pred"], r["Score"], r["lang_pred_"]) for r in out.collect()) == [("own", "a", "en"), ("own", "a", "en"), ("x", "b", "und")]


# --- op3 -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [100_000, 0])
def test_exact_over_micro_batches_and_clashes(spark, monkeypatch, tmp_path, limit):
    """State is carried over many micro-batches; texts that share a digest are told apart; both joins give the same."""
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST", limit)
    rows = [(i, f"text {i % 7}" if i % 3 else f"own {i}") for i in range(60)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    best = {}
    for i, t in rows:
        best.setdefault(t, []).append(i)
    want = sorted((i, max(best[t]), len(best[t]), i == max(best[t]), sha(t.encode())) for i, t in rows)
    for docs in (spark.read.parquet(path), spark.createDataFrame(rows, "doc_id long, text string")):
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs, bytes_per_batch=1).collect())) == want
    weak = F.encode(F.length("text").cast("string"), "utf-8")
    clashed = exact_dedup.exact_dedup(spark.read.parquet(path), digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, clashed)) == [x[:4] for x in want]
    kept = exact_dedup.keep_one(spark.read.parquet(path).withColumns({"sha": F.lit("own"), "keep": F.lit(1)}))
    assert sorted((r["doc_id"], r["sha"], r["keep"]) for r in kept.collect()) == sorted((max(v), "own", 1) for v in best.values())


def test_shared_folder_is_asked_for(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_folder(Session())


# --- op4 -------------------------------------------------------------------------------------------------------------
def test_mixing_edges(spark):
    rows = [(1, "a", "mine"), (1, "a", "mine"), (None, "a", "mine"), (2, None, "mine"), (3, "b", "mine"), (4, "c", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, copy string").withColumn("shuffle_key", F.lit("k"))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "copy", "shuffle_key", "copy_", "shuffle_key_"]
    got = out.collect()
    assert all(r["copy"] == "mine" and r["shuffle_key"] == "k" for r in got) and [r["shuffle_key_"] for r in got] == sorted(r["shuffle_key_"] for r in got)
    rates = {r["source"]: r["rate"] for r in mixing.target_rates(docs).collect()}
    assert rates == {"a": 0.5, "": 1.5, "b": 1.5, "c": 1.5}
    n = Counter((r["doc_id"], r["source"]) for r in got)
    for i, s in {(i, s) for i, s, _ in rows}:
        u = (int(hashlib.md5(f"{mixing.SEED}:n:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate, k = rates[s or ""], 0
        while sum(math.exp(-rate) * rate**j / math.factorial(j) for j in range(k + 1)) < u:
            k += 1
        assert n[i, s] == k * sum(1 for x in rows if x[:2] == (i, s))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -1.0)], "source string, weight double")
    assert {r["source"]: r["rate"] for r in mixing.target_rates(docs, weights, 8).collect()} == {"a": 2.0, "b": 2.0, "c": 0.0, "": 0.0}


# --- op5 -------------------------------------------------------------------------------------------------------------
def test_noisy_or_and_step_by_plain_loops():
    z = np.array([-3.0, 0.5, -1.0])
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod([1 - 1 / (1 + math.exp(-x)) for x in z]))
    rnd = random.Random(4)
    bad = [b"vile", b"awful"]
    rows = []
    for i in range(80):
        text = b". ".join(b" ".join([b"w%d" % rnd.randrange(30) for _ in range(5)] + ([bad[i % 2]] if i % 4 == 0 and s == 1 else [])) for s in range(3))
        flat, starts = toxicity.bags(text, toxicity.Features())
        rows.append((int(i % 4 == 0), 1.0, flat, starts))
    model = toxicity.train(rows)

    def loss(m):
        """Weighted log loss of the noisy-or, by loops over documents and sentences."""
        total = 0.0
        for y, _, flat, starts in rows:
            clean = 1.0
            for a, b in zip(starts, [*starts[1:], len(flat)]):
                clean *= 1 - 1 / (1 + math.exp(-(m.bias + sum(m.weights[f] for f in flat[a:b]))))
            p = min(max(1 - clean, 1e-9), 1 - 1e-9)
            total -= math.log(p) if y else math.log(1 - p)
        return total / len(rows)

    assert loss(model) < 0.1 < loss(toxicity.Model(np.zeros(toxicity.DIM), -6.0))
    flat, starts = rows[0][2], rows[0][3]
    assert np.argmax(model.logits(flat, starts)) == 1  # the sentence with the bad word
    weights = toxicity.Weights(model)
    spans, logits = toxicity.sentence_logits(b"W1 w2. Vile w3! w4", weights)
    assert len(spans) == 3 and np.argmax(logits) == 1


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"plain words {i % 5}. " + ("vile thing" if i % 3 == 0 else "kind thing")) for i in range(60)] + [(60, None), (61, ""), (62, "vile " * 30_000)] + [(5, "kind again")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[60] == got[61] < 0.3 < got[62]
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(60))


# --- op6 -------------------------------------------------------------------------------------------------------------
def brute_top(rows, k=10):
    """rows (vec_id, ints) -> the lists of every query, without one row of its own."""
    out, hold = [], lambda x: max(topk.LEAST, min(topk.MOST, x))
    for q, v in {(i, v) for i, v in rows if i % 100 == 0}:
        others = list(rows)
        others.remove((q, v))
        best = sorted((-hold(sum(a * b for a, b in zip(v, w))), i) for i, w in others if len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [(1024, 16_384, 1024), (2, 16, 5)])
def test_top_k_edges(spark, monkeypatch, block):
    """Repeated ids, equal rows, huge and tiny components, vectors of several lengths, and many blocks."""
    for name, value in zip(("QUERY_BLOCK", "VECTOR_BLOCK", "TILE"), block):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in rng.integers(0, 260, 200)]
    rows += [(100, [1e15, 1.0]), (101, [1e15, -1.0]), (102, [-1e15, 1.0]), (200, [1.0, 1e-9]), (103, [1e300, -1e300]), (300, [1e300, 1e300]), (300, [1e300, 1e300])]
    rows += [(100, []), (104, []), (0, [0.25] * 4), (0, [0.25] * 4), (0, [0.5] * 4), (7, [0.25] * 4), (7, [0.25] * 4)]
    ints = [(i, tuple(max(topk.LEAST, min(topk.MOST, math.floor(1024 * x))) for x in v)) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(ints)


# --- op7, op8, op10: digest columns ----------------------------------------------------------------------------------
def test_bpe_digests(spark, real):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in real:
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op7(spark, D).collect()} == want
    ours = bpe.BytePairs(ranks, P.PATTERN)
    rnd = random.Random(6)
    known = [t for t in ours.tokens if ours.reached(t)]
    for _ in range(3000):  # the border check against the merges themselves
        a, b = rnd.choice(known), rnd.choice(known[:2000])
        assert ours.compatible(a, b) == (ours.merged(ours.tokens[a] + ours.tokens[b]) == [a, b])


def test_bpe_new_pieces_are_encoded_together(monkeypatch):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    alone = []
    plain = bpe.BytePairs.encode_piece
    monkeypatch.setattr(bpe.BytePairs, "encode_piece", lambda self, data: (alone.append(data), plain(self, data))[1])
    rnd = random.Random(9)
    words = ["".join(rnd.choices(["tion", "th", "er", "in", "é", "日本", "ß", "0", "q", "zx", "🙂"], k=rnd.randint(1, 9))) for _ in range(3000)] + ["ab" * 200]
    text = " ".join(words)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.BytePairs(ranks, P.PATTERN).encode(text) == enc.encode_ordinary(text)
    assert {len(x.decode()) > bpe.MEMO_PIECE for x in alone} == {True}  # only the long piece goes by itself


def test_bpe_steps_of_many_pieces(monkeypatch):
    ours = bpe.BytePairs({b"a": 0, b"b": 1, b"c": 2}, ".+")
    with pytest.raises(ValueError):
        ours.encode_pieces([b"ab", b"xa"])
    rnd = random.Random(10)
    undone = 0
    for _ in range(60):  # small vocabularies of merges, with tokens that merges never give, dead ends and full memos
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 25:
            ranks.setdefault(rnd.choice(list(ranks)) + rnd.choice(list(ranks)), len(ranks))
        for n in (3, 4):
            ranks.setdefault(bytes(rnd.choices(b"abc", k=n)), len(ranks))
        ours = bpe.BytePairs(ranks, ".+")
        monkeypatch.setattr(bpe, "MEMO_PAIRS", rnd.choice([1, 20, 150_000]))
        pieces = [bytes(rnd.choices(b"abc", k=rnd.randint(1, 40))) for _ in range(50)]
        ids, sizes = ours.encode_pieces(pieces)
        want = [[ranks[p]] if p in ranks else ours.merged(p) for p in pieces]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
        assert want == [ours.encode_piece(p) for p in pieces]
        undone += sum(len(ours.tokens[x[0]]) < len(ours.tokens[ours.longest(p.decode(), 0, ours.most)]) for p, x in zip(pieces, want))
    assert undone > 100
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    monkeypatch.setattr(bpe, "STEPPED", 3)
    ours = bpe.BytePairs({**ranks, b"x": len(ranks)}, "[abc]+|x")
    texts = ["", "abc", "x".join(p.decode() for p in pieces), "a"]
    assert [x.tolist() for x in ours.arrays(texts)] == [[i for p in ours.pattern.findall(t) for i in ours.encode_piece(p.encode())] for t in texts]
    assert ours.arrays([]) == []


def test_bpe_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 4000)
    made = []
    memo = bpe.Memo(lambda data: (made.append(data), [len(data)])[1])
    for i in range(100):
        assert memo[f"piece{i % 30}"] == np.array([len(f"piece{i % 30}")], dtype=np.int32).tobytes()
        assert len(memo) + len(memo.older) < 25
    assert memo["x" * 100] and "x" * 100 not in memo


def test_pii_columns(spark, real):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    for r in pii.op8(spark, D).collect():
        t = dict(real)[r["doc_id"]]
        want = sorted((m.start(), list(plain).index(k), f"{k}:{m.start()}:{m.end()}", k) for k, p in plain.items() for m in re.finditer(p, t) if ok(k, m.group()))
        assert [r[f"n_{k}"] for k in plain] == [sum(x[3] == k for x in want) for k in plain]
        assert r["base_sha256"] == sha(",".join(x[2] for x in want).encode()) and {x[2] for x in want} <= set(r["spans"].split(","))


def test_pii_many_matches_and_context(spark):
    many = "é 1.2.3.4 x" * 20_000
    texts = [many, "ssn 123-45-6789", "no 123-45-6789 here", "account GB82 WEST 1234 5698 7654 32 OK NOW", "GB82 WEST 1234 5698 7654 33 OK"]
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in out[0]] == [(m.start(), m.end()) for m in re.finditer(r"1\.2\.3\.4", many)]
    assert [[(s["kind"], s["match"]) for s in out[i] if s["kind_no"] > 3] for i in range(1, 5)] == [[("ssn", "123-45-6789")], [], [("iban", "GB82 WEST 1234 5698 7654 32")], []]
    clash = pii.find_pii(spark.createDataFrame([(1, "a@b.co", "own")], "doc_id long, text string, spans string"))
    assert clash.columns[-2:] == ["spans", "spans_"] and clash.first()["spans"] == "own"


def test_fingerprint_text(spark, real):
    def fp(t):
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return "%016x" % sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert {r["doc_id"]: r["fingerprint"] for r in simhash.op10(spark, D).collect()} == {i: fp(t) for i, t in real}
    none = simhash.simhash_components(spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, None)], "doc_id long, text string")).collect()
    assert len(none) == 3 and {r["component_id"] for r in none if r["doc_id"] is None} == {None}


# --- pipeline --------------------------------------------------------------------------------------------------------
def test_near_dedup_is_complete(spark):
    """Groups of all pairs at similarity 0.8 over five words, on the given documents."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] and r["text"].split()]
    sets, where = {}, {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    forest, pairs = components.Forest(), Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[:n])
    for (a, b), n in pairs.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            forest.union(a, b)
    want = {i for i, _ in rows if forest.find(i) == i}
    assert len(want) < len(rows)
    got = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_head_nodes_over_batches(spark):
    """Rows with enough head shingles that another row's head has, wherever the batches end; a shingle of all rows, copies, empty texts."""
    dice = random.Random(5)
    texts = ["", "one", "one"]
    for i in range(40):
        words = [f"w{dice.randrange(5000)}" for _ in range(dice.choice([6, 30, 90, 200]))]
        texts.append(" ".join(["a very common line here", *words]))
        if i % 4 == 0:
            texts.append(" ".join(["a very common line here", *words, "and", "one", "more"]))
    heads, need = [], []
    for t in texts:
        w = t.split()
        g = sorted({xxhash.xxh64_intdigest(" ".join(w[j : j + 5]), 42) for j in range(max(1, len(w) - 4))}) if w else []
        least = -(-4 * len(g) // 5)
        heads.append(g[: len(g) - least + 1 + len(g) // 20])
        need.append(1 + least // 20)
    often = Counter(x for h in heads for x in h)
    want = {i for i, h in enumerate(heads) if sum(often[x] > 1 for x in h) >= need[i]}
    assert 10 < len(want) < len(texts)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in (1, 7, 500):
            spark.conf.set(key, str(size))
            docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
            assert {r["node"] for r in simhash.head_nodes(docs, 5).collect()} == want
    finally:
        spark.conf.set(key, before)
    assert simhash.head_nodes(spark.createDataFrame([], "node long, text string"), 5).count() == 0


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows against a plain version on what the stage before it kept."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before = texts(docs)
    first = common.saved(stages["language_id"](spark, docs, D))
    assert texts(first) == {i: t for i, t in before.items() if t and any(map(str.isalpha, t))}
    second = common.saved(stages["exact_dedup"](spark, first, D))
    best = {}
    for i, t in texts(first).items():
        best[t] = max(best.get(t, -1), i)
    assert texts(second) == {i: t for t, i in best.items()}
    third = common.saved(stages["simhash_near_dedup"](spark, second, D))
    left = texts(second)
    sets = {i: {tuple(t.encode().lower().split()[j : j + 5]) for j in range(max(1, len(t.encode().split()) - 4))} for i, t in left.items()}
    forest = components.Forest()
    for a in left:
        for b in left:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                forest.union(a, b)
    assert texts(third) == {i: t for i, t in left.items() if forest.find(i) == i}
    fourth = common.saved(stages["mix_sources"](spark, third, D))
    sources = {r["doc_id"]: r["source"] for r in third.collect()}
    size = Counter(sources.values())
    drawn = Counter(r["doc_id"] for r in fourth.collect())
    for i, s in sources.items():
        rate, k = len(sources) / len(size) / size[s], 0
        u = (int(hashlib.md5(f"{mixing.SEED}:n:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        while sum(math.exp(-rate) * rate**j / math.factorial(j) for j in range(k + 1)) < u:
            k += 1
        assert drawn[i] == k
    last = stages["byte_bpe"](spark, fourth, D).collect()
    assert Counter(r["doc_id"] for r in last) == drawn and all(r["decoded_sha256"] == sha(left[r["doc_id"]].encode()) for r in last)
    assert all(df.columns == corpus_pipeline.COLUMNS for df in (first, second, third, fourth))


def test_pipeline_stages_on_empty_and_null_rows(spark):
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D).collect()
            assert len(out) <= 10 * len(rows), name
            if name == "language_id":
                assert out == []
            if name == "exact_dedup":
                assert len(out) == min(1, len(rows))  # null counts as the empty text
            if name == "simhash_near_dedup":
                assert len(out) == len(rows)


def test_labels_are_bounded(spark):
    texts = ("the cat sat", "der hund lief", "le chien court")
    rows = [(i, text, f"l{i % 3}") for i in range(9) for text in [texts[i % 3]]] + [(9, None, "l3"), (10, "no label", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(labelled, most_languages=3)  # rows without a text or a label are no labels
    assert filters.languages == ["l0", "l1", "l2"] and [filters.decide(t)[0] for t in texts] == filters.languages
    with pytest.raises(ValueError, match="over 2 labels"):
        langid.fit(labelled, most_languages=2)
    assert langid.fit(labelled.limit(0)).decide("the cat") == ("und", 0.0)
