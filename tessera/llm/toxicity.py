"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; the document's is their noisy-or,
1 - prod(1 - p). The sentence model is trained from document labels alone, through the noisy-or, and then
locates the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, prepare, text_bytes

#: Hashed word features; labelled rows of each class to fit on at most (chosen by hash of doc_id); a word counts if in so many rows.
DIM, FIT_ROWS, LEAST_ROWS = 1 << 18, 1_500, 3
#: From which score of the document it is predicted toxic, and of a sentence it is reported.
THRESHOLD, OFFENDING = 0.3, 0.5
STEPS, RATE, L1 = 160, 0.15, 3e-4
SENTENCE_END = regex.compile(rb"[.!?\n]+")
EDGES = b".,;:!?\"'()[]{}<>*%$&#_-"


#: Lengths in characters of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7)


class Features(dict):
    """Word (bytes, lower case) -> feature numbers of the word and of its beginnings."""

    def __missing__(self, word: bytes) -> list[int]:
        plain = word.strip(EDGES).decode(errors="replace")
        names = ["=" + plain, *[f"{n}{plain[:n]}" for n in BEGINNINGS if len(plain) >= n]]
        value = [xxhash.xxh3_64_intdigest(x) % DIM for x in names]
        if len(self) > 300_000:
            self.clear()
        self[word] = value
        return value


class Weights(dict):
    """Word -> sum of the weights of its features under a model."""

    def __init__(self, model: "Model"):
        super().__init__()
        self.model, self.features = model, Features()

    def __missing__(self, word: bytes) -> float:
        value = float(self.model.weights[self.features[word]].sum())
        self.features.clear()
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


def sentences(text: bytes):
    """(start, end) in bytes of a text's sentences that hold a word."""
    at = 0
    for m in SENTENCE_END.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.end()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def bags(text: bytes, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the distinct words of each sentence, all sentences in a row, and where each begins in them."""
    flat, starts = [], []
    low = text.lower()
    for a, b in sentences(low):
        starts.append(len(flat))
        for word in set(low[a:b].split()):
            flat += features[word]
    return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)), as 1 - exp(-sum log(1 + e^z))."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


class Model:
    """bias and a weight for each feature; `base` is the score of a text without sentences."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logit of each sentence of a bag; of one sentence without words if there is none."""
        return np.add.reduceat(self.weights[flat], starts) + self.bias if len(starts) else np.array([self.bias])


def sentence_logits(text: bytes, weights: Weights) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans in bytes and logits of a text's sentences."""
    low = text.lower()
    spans = list(sentences(low))
    get, bias = weights.__getitem__, weights.model.bias
    return spans, np.array([sum(map(get, set(low[a:b].split()))) for a, b in spans] or [0.0]) + bias


def train(rows: list[tuple[int, float, np.ndarray, np.ndarray]]) -> Model:
    """rows: (label, weight, features, starts). Proximal Adam on the weighted log loss of the noisy-or."""
    weights = np.zeros(DIM)
    rows = [r for r in rows if len(r[3])]
    if not rows or len({r[0] for r in rows}) < 2:
        share = sum(r[0] for r in rows) / len(rows) if rows else 0.0
        return Model(weights, 20.0 if share == 1 else -20.0)
    y, w = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows])
    w /= w.sum()
    flat = np.concatenate([r[2] for r in rows])
    n_sent, n_feat = np.array([len(r[3]) for r in rows]), np.array([len(r[2]) for r in rows])
    sent_at = np.concatenate([[0], np.cumsum(n_sent)[:-1]])
    starts = np.concatenate([r[3] + at for r, at in zip(rows, np.concatenate([[0], np.cumsum(n_feat)[:-1]]))])
    lengths = np.diff(np.append(starts, len(flat)))
    sent_of_feat, doc_of_sent = np.repeat(np.arange(len(starts), dtype=np.int32), lengths), np.repeat(np.arange(len(rows)), n_sent)
    in_rows = np.bincount(np.unique(doc_of_sent[sent_of_feat] * DIM + flat) % DIM, minlength=DIM)
    common = in_rows[flat] >= LEAST_ROWS
    sent_of_feat = sent_of_feat[common]
    used, small = np.unique(flat[common].astype(np.int32), return_inverse=True)
    theta, bias = np.zeros(len(used)), -6.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(sent_of_feat, theta[small], minlength=len(starts)) + bias
        total = np.maximum(np.add.reduceat(np.logaddexp(0, z), sent_at), 1e-9)
        # loss: -y log(1 - e^-s) + (1 - y) s, so d loss / d s = 1 - y - y / (e^s - 1) ... for y = 1: -1 / (e^s - 1)
        ds = w * np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        dz = ds[doc_of_sent] / (1 + np.exp(-z))
        g, gb = np.bincount(small, dz[sent_of_feat], minlength=len(used)), dz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        theta -= scale * m / (1 - 0.9**t)
        theta = np.sign(theta) * np.maximum(np.abs(theta) - scale * L1, 0)
        bias -= RATE / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4) * mb / (1 - 0.9**t)
    weights[used] = theta
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); null labels teach nothing. Sampled classes are weighted back to their share.

    A doc_id labelled twice counts once, as toxic if any label says so; of documents that share a doc_id one is learned from. The labels are
    sampled before they meet the texts: about 2 x fit_rows of them, a bounded table that is broadcast, so no text but theirs is shuffled. The
    driver gets the hashed features of those rows.
    """
    prepare(docs.sparkSession)
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    steps = 1 << 40
    share = {c: min(1.0, fit_rows / n) for c, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, max(1, int(steps * share.get(1, 0)))).otherwise(max(1, int(steps * share.get(0, 0))))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(steps)) < limit)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")

    def run(batches):
        features = Features()
        for b in batches:
            found = [bags(t, features) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([x[0].astype(np.int32).tobytes() for x in found], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in found], pa.binary())],
                ["toxic", "flat", "starts"],
            )

    table = rows.mapInArrow(run, "toxic int, flat binary, starts binary").toArrow()
    as_ints = lambda x: np.frombuffer(x, dtype=np.int32).astype(np.int64)
    got = zip(table["toxic"].to_pylist(), table["flat"].to_pylist(), table["starts"].to_pylist())
    return train([(c, 1 / share[c], as_ints(f), as_ints(s)) for c, f, s in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> doc_id, score, offending: array of struct(start, end, score) of sentences (byte offsets) from OFFENDING on.

    A null or empty text has the score of one sentence without words. Rows are independent. The broadcast is DIM doubles.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        weights = Weights(shared.value)
        for b in batches:
            scores, offending = [], []
            for t in text_bytes(b.column("text")):
                spans, z = sentence_logits(t, weights)
                scores.append(noisy_or(z))
                offending.append([{"start": spans[i][0], "end": spans[i][1], "score": float(1 / (1 + np.exp(-z[i])))} for i in np.flatnonzero(z >= 0)] if spans else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(offending, kind)], ["doc_id", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, offending array<struct<start:int,end:int,score:double>>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending")
    )
