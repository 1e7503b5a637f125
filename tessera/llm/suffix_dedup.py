"""Suffix-array dedup by prefix-free parsing.

Fragments that may repeat are dealt to shards (repeats.py). In a shard a rolling hash places triggers, which cut the fragments into
phrases that overlap by a trigger. The suffix array of the dictionary of distinct phrases and that of the parse combine into the
order of all suffixes of the shard: first by the suffix of the phrase at hand, then by the rank of the rest of the parse. No phrase suffix longer
than a trigger is a prefix of another, so that order is the true one. Neighbours that share 200 bytes are repeats.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes
from .repeats import Rolling, covered, repeated_spans, with_spans

WINDOW, GRAM = 200, 56
#: Bytes of a trigger; a place is a trigger where the hash is 0 modulo PERIOD.
TRIGGER, PERIOD = 6, 24
#: A random 64-bit value for each byte, the unit hashes of the rolling hash.
BYTE_HASH = np.random.default_rng(7).integers(0, 1 << 64, 257, dtype=np.uint64)


def ranks(keys: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """Ranks from 1 of all suffixes of sequences laid end to end, by prefix doubling. keys order their first `step` units; left: units to the sequence's end."""
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1
    most, n = int(left.max(initial=0)), len(keys)
    while step < most:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - step] = np.where(left[: n - step] > step, rank[step:], 0)
        distinct, new = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        rank = new.astype(np.int64) + 1
        step *= 2
        if len(distinct) == n:
            break
    return rank


def to_end(lengths: np.ndarray) -> np.ndarray:
    """Units left, itself included, for each unit of sequences of these lengths."""
    ends = np.cumsum(lengths)
    return (np.repeat(ends, lengths) - np.arange(int(ends[-1]) if len(ends) else 0)).astype(np.int32)


def corpus_order(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of a text in the order of their suffixes. text: values 0..256 of fragments laid end to end, each ended by TRIGGER zeros, which its length counts.

    The zeros themselves (a fragment's last TRIGGER places) are left out.
    """
    n = len(text)
    left = to_end(lengths)
    h = Rolling(BYTE_HASH[text]).each(TRIGGER)
    trigger = np.zeros(n, dtype=bool)
    trigger[: len(h)] = h % np.uint64(PERIOD) == 0
    trigger &= left > TRIGGER
    trigger[np.cumsum(lengths) - lengths] = True  # a fragment's first phrase starts with it
    start = np.flatnonzero(trigger)
    # a phrase ends with the next trigger, or the zeros at the fragment's end
    fragment_end = start + left[start]
    following = np.append(start[1:], n)
    end = np.minimum(np.minimum(following + TRIGGER, fragment_end), n)
    end = np.where(following >= fragment_end, fragment_end, end)
    data = text.tobytes()
    known: dict[bytes, int] = {}
    parse = np.fromiter((known.setdefault(data[2 * a : 2 * b], len(known)) for a, b in zip(start.tolist(), end.tolist())), dtype=np.int64, count=len(start))
    # suffix array of the dictionary
    words = np.frombuffer(b"".join(known), dtype=np.int16)
    word_lengths = np.array([len(w) // 2 for w in known], dtype=np.int64)
    word_left = to_end(word_lengths)
    word_start = np.cumsum(word_lengths) - word_lengths
    key, step = np.zeros(len(words), dtype=np.int64), 6
    for i in range(step):
        nxt = np.zeros(len(words), dtype=np.int64)
        nxt[: len(words) - i] = np.where(word_left[: len(words) - i] > i, words[i:].astype(np.int64) + 1, 0)
        key = key * 259 + nxt
    word_rank = ranks(key, word_left, step).astype(np.int32)
    del key, nxt
    # suffix array of the parse, over the phrases' ranks
    phrases = np.diff(np.append(np.flatnonzero(np.isin(start, np.cumsum(lengths) - lengths)), len(start)))
    parse_left = to_end(phrases)
    parse_rank = ranks(word_rank[word_start[parse]], parse_left, 1)
    # both together
    del data, known, h, trigger
    place = np.flatnonzero(left > TRIGGER).astype(np.int32)
    phrase = (np.searchsorted(start, place, side="right") - 1).astype(np.int32)
    alpha = word_rank[word_start[parse[phrase]] + place - start[phrase]]
    rest = (np.append(parse_rank, 0)[phrase + 1] * (parse_left[phrase] > 1)).astype(np.int32)
    del phrase
    return place[np.lexsort((rest, alpha))]


def repeated_anywhere(contents: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each content, per passage of `window` bytes: whether it starts anywhere else in the contents too."""
    lengths = np.array([len(c) + TRIGGER for c in contents], dtype=np.int64)
    text = np.zeros(int(lengths.sum()), dtype=np.int16)
    left = to_end(lengths)
    text[left > TRIGGER] = np.frombuffer(b"".join(contents), dtype=np.uint8).astype(np.int16) + 1
    order = corpus_order(text, lengths)
    order = order[left[order] >= window + TRIGGER]
    h = Rolling(BYTE_HASH[text])
    of = h.ranges(order, order + window)
    pair = np.flatnonzero(of[1:] == of[:-1])
    del h, of
    for i in range(window):  # the bytes themselves
        pair = pair[text[order[pair] + i] == text[order[pair + 1] + i]]
    mark = np.zeros(len(text), dtype=bool)
    mark[order[pair]] = mark[order[pair + 1]] = True
    ends = np.cumsum(lengths)
    return [mark[e - n : e - TRIGGER - window + 1] for n, e in zip(lengths.tolist(), ends.tolist())]


def byte_hashes():
    return lambda text: BYTE_HASH[1:][np.frombuffer(text, dtype=np.uint8)]


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per row: doc_id, n_bytes, n_removed, n_spans, kept (binary), removed (array of byte ranges).

    A byte goes if a string of `window` bytes covers it that also starts elsewhere, in any document. Null text is empty. Rows that
    repeat a doc_id or have none are documents of their own; two equal rows are two places, so both lose what is as long as a window. An
    empty table gives none.
    """
    rows, spans = repeated_spans(docs, byte_hashes, "bytes", window, GRAM, bytes, bytes, lambda c: repeated_anywhere(c, window), False)

    def finish(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            n, gone, runs, kept, ranges = [], [], [], [], []
            for text, found in zip(text_bytes(b.column("text")), b.column("spans").to_pylist()):
                n.append(len(text))
                if not found:
                    gone.append(0), runs.append(0), kept.append(text), ranges.append([])
                    continue
                mask = covered(found, len(text), window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                gone.append(int(mask.sum())), runs.append(len(edge) // 2)
                kept.append(np.frombuffer(text, dtype=np.uint8)[~mask].tobytes())
                ranges.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary()), pa.array(ranges, kind)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"],
            )

    return with_spans(rows, spans).mapInArrow(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, removed array<struct<start:int,end:int>>"
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
