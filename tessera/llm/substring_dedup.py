"""Substring dedup by suffix automata of reference shards.

Fragments that may repeat are dealt to shards (repeats.py). A shard's reference is its fragments in order of place: each is streamed
through the suffix automaton of those before it for matching statistics (the longest suffix of what was read that occurs
in the reference), and then added to it. A passage whose last word has a matching statistic of at least the threshold goes.

The automaton of a shard is built in the task that holds the shard and sees only what is routed to it, so no automaton of the corpus is
broadcast; `matching_spans` broadcasts automata of a reference set of bounded size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_bytes
from .repeats import covered, repeated_spans, with_spans

WINDOW, GRAM = 20, 5
#: Words of all references together that may be broadcast as automata (about 0.5 KB a word), and of a shard's automaton.
MAX_REFERENCE_WORDS, REFERENCE_SHARD = 200_000, 25_000


class SuffixAutomaton:
    """Generalised suffix automaton over hashable units. State 0 is the root."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of q that holds its suffixes up to p's length + 1; p and its suffix states move to it."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, units) -> None:
        last = 0
        for c in units:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def matching(self, units) -> list[int]:
        """For each unit the length of the longest string ending there that occurs in what was added."""
        out, state, n = [], 0, 0
        nexts, links, lengths = self.next, self.link, self.length
        for c in units:
            while state and c not in nexts[state]:
                state = links[state]
                n = lengths[state]
            to = nexts[state].get(c)
            if to is not None:
                state, n = to, n + 1
            else:
                n = 0
            out.append(n)
        return out


def repeated_before(contents: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each content, per passage: whether it occurs in a content before it."""
    automaton, out = SuffixAutomaton(), []
    for content in contents:
        words = content.split()
        marks = np.array(automaton.matching(words)[window - 1 :], dtype=np.int64) >= window
        if not marks.all():
            automaton.add(words)
        out.append(marks)
    return out


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


def word_hashes():
    known = WordHashes()

    def run(text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per row: doc_id, n_words, n_removed, kept (text of the kept words), removed (array of word ranges).

    A word goes if a passage of `window` words covers it whose words also start earlier: in a smaller doc_id, or in the same
    document before. Null text: no words. A null doc_id is smaller than any other; of rows that repeat a doc_id, or have none, with different
    texts those with the smaller text hash come first, and rows alike in doc_id and text are one document, each giving the same result: a document's
    words are lost only where they stand earlier in another one or in itself. An empty table gives none.
    """
    rows, spans = repeated_spans(docs, word_hashes, "words", window, GRAM, bytes.split, b" ".join, lambda c: repeated_before(c, window), True)

    def finish(batches):
        for b in batches:
            n, gone, kept, ranges = [], [], [], []
            for text, found in zip(text_bytes(b.column("text")), b.column("spans").to_pylist()):
                words = text.split()
                n.append(len(words))
                mask = covered(found, len(words), window) if found else None
                gone.append(0 if mask is None else int(mask.sum()))
                kept.append(b" ".join(words if mask is None else [w for w, m in zip(words, mask.tolist()) if not m]))
                edge = [] if mask is None else np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                ranges.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )

    return with_spans(rows, spans).mapInArrow(finish, "doc_id bigint, n_words bigint, n_removed bigint, kept binary, removed array<struct<start:int,end:int>>")


def reference_automata(references: DataFrame) -> DataFrame:
    """references (text) -> automaton, a row per shard of about REFERENCE_SHARD words: a pickled suffix automaton of whole texts, built by a task."""

    def run(batches):
        automaton, words = SuffixAutomaton(), 0
        for b in batches:
            for text in text_bytes(b.column("text")):
                automaton.add(text.split())
                words += len(text.split())
                if words >= REFERENCE_SHARD:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(automaton)], pa.binary())], ["automaton"])
                    automaton, words = SuffixAutomaton(), 0
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(automaton)], pa.binary())], ["automaton"])

    return references.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "automaton binary")


def matching_spans(docs: DataFrame, references: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs against a bounded reference table (text): doc_id and removed, the maximal word ranges whose matching statistics reach window.

    Automata of the references' shards, built by tasks, are broadcast, and each document is streamed through all of them. The references' words are
    counted first; above MAX_REFERENCE_WORDS this raises, and the union of both tables belongs in substring_dedup. Null texts have no words; an
    empty table of either side gives no ranges.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = references.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if size > MAX_REFERENCE_WORDS:
        raise ValueError(f"{size} words of references are too many to broadcast; use substring_dedup")
    shards = spark.sparkContext.broadcast([r["automaton"] for r in reference_automata(references).collect()])

    def run(batches):
        automata = [pickle.loads(x) for x in shards.value]  # noqa: S301  (built by this job)
        for b in batches:
            out = []
            for text in text_bytes(b.column("text")):
                words = text.split()
                statistics = np.max([np.zeros(len(words), dtype=np.int64), *(np.array(a.matching(words), dtype=np.int64) for a in automata)], axis=0)
                found = np.flatnonzero(statistics >= window) - window + 1
                mask = covered([{"a": x, "b": x} for x in found.tolist()], len(words), window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                out.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "removed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, removed array<struct<start:int,end:int>>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
gs AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY 1),
e AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN gs USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM e
"""
