"""Routing of passages that may repeat: what substring dedup and suffix-array dedup share.

A passage of `window` units (words or bytes) is looked up through its anchor, the unit k-gram with the least hash in it. Equal
passages have equal anchors at equal places, so only passages of an anchor seen twice in the corpus can repeat. Consecutive
passages of a document with the same anchor occurrence form a fragment. Steps, each a shuffle on a hash:

1. count anchors; keep fragments of anchors seen at least twice;
2. fold equal fragments (anchor, content) into one, with their number and first place: groups of copies end here;
3. anchors left with over one content: the contents go to a shard by anchor, where the operator's index (a suffix automaton,
   or suffix arrays of a prefix-free parse) finds the repeated passages of contents that differ as a whole;
4. an anchor with over HOT contents would fill a shard, and no longer anchor would split what surrounds a very common passage: its fragments
   are cut into single passages, which fold by anchor and content like whole fragments.

Folding takes fragments of one anchor for equal by two hashes of 64 bits each, of the anchor and of the content; the index compares units themselves.
Every document, fragment and passage takes part; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, saved, text_bytes

#: Passages of a document looked at together, which bounds the memory for a very long text.
BLOCK = 1 << 17
#: Contents of one anchor from which its passages are routed one by one: about 1 MB of bytes, or what 100 MB of automaton hold.
HOT = {"words": 2_000, "bytes": 4_000}
#: Units of content that a shard is to hold.
SHARD_UNITS = {"words": 150_000, "bytes": 1_200_000}
#: Anchors with over HOT contents are broadcast up to this many (8 bytes each).
MAX_BROADCAST = 200_000
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
#: A document: an id with a text, this as two hashes of 64 bits each. Rows that are alike in both are one document.
KEY = ["doc_id", "sub", "sup"]
DOCUMENT = "doc_id bigint, sub bigint, sup bigint"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any range of a sequence of 64-bit unit hashes in O(1): sums of unit x ODD^i, shifted back by ODD^-i.

    The powers are kept for the longest sequence so far; these are blocks, or the contents of a shard.
    """

    up = down = np.ones(1, dtype=np.uint64)

    def __init__(self, units: np.ndarray):
        n = len(units)
        if n >= len(Rolling.up):
            size = 1 << max(16, n.bit_length())
            steps = np.full(size, ODD, dtype=np.uint64)
            steps[0] = 1
            Rolling.up = np.multiply.accumulate(steps)
            steps = np.full(size, INVERSE, dtype=np.uint64)
            steps[0] = 1
            Rolling.down = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * Rolling.up[:n], out=self.sums[1:])

    def each(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * Rolling.down[:n])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Rolling.down[start] + (end - start).astype(np.uint64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its leftmost least one."""
    v, at, span = values, np.arange(len(values), dtype=np.int32), 1

    def pick(v1, a1, v2, a2):
        right = v2 < v1
        return np.where(right, v2, v1), np.where(right, a2, a1)

    while span * 2 <= width:
        v, at = pick(v[:-span], at[:-span], v[span:], at[span:])
        span *= 2
    rest = width - span
    if rest:
        n = len(values) - width + 1
        v, at = pick(v[:n], at[:n], v[rest : rest + n], at[rest : rest + n])
    return at


def fragments(units: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (anchor, content, a, b): fragments of passages starting at a..b of a sequence of unit hashes."""
    n = len(units) - window + 1
    for at in range(0, n, BLOCK):
        part = units[at : min(at + BLOCK, n) + window - 1]
        roll = Rolling(part)
        grams = roll.each(k)
        place = least_places((grams >> np.uint64(32)).astype(np.uint32), window - k + 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.append(first[1:] - 1, len(place) - 1)
        yield grams[place[first]].view(np.int64), roll.ranges(first, last + window).view(np.int64), (first + at).astype(np.int32), (last + at).astype(np.int32)


def source(docs: DataFrame) -> DataFrame:
    """docs as doc_id, sub, sup, text. A row is told apart from others of its doc_id, or without one, by 128 bits of hashes of its text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("sub"), F.xxhash64(F.lit("second"), "text").alias("sup"), "text")


def same_document() -> Column:
    """Joins rows with those of renamed keys d, s and u."""
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sub") == F.col("s")) & (F.col("sup") == F.col("u"))


def renamed(rows: DataFrame, *others: str) -> DataFrame:
    return rows.select(*(F.col(x).alias(y) for x, y in zip(KEY, "dsu")), *others)


def once_each(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(a row for each document, those of them that stand in several rows or None if there are none)."""
    equal = saved(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEY))
    n = equal.limit(MAX_BROADCAST + 1).count()
    if not n:
        discard(rows.sparkSession, equal)
        return rows, None
    keys = renamed(F.broadcast(equal) if n <= MAX_BROADCAST else equal)
    first = saved(rows.join(keys, same_document(), "left_semi").groupBy(*KEY).agg(F.first("text").alias("text")))
    return rows.join(keys, same_document(), "left_anti").unionByName(first), first


def scan(rows: DataFrame, unit_hashes: Callable, window: int, k: int, with_place: bool) -> DataFrame:
    """Fragments of all rows; with_place: with content and place, else the anchor alone."""

    def run(batches):
        hashes = unit_hashes()
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(4)]
            rows_of: list[tuple[int, int]] = []
            for i, text in enumerate(text_bytes(b.column("text"))):
                for found in fragments(hashes(text), window, k):
                    rows_of.append((i, len(found[0])))
                    for p, x in zip(parts, found):
                        p.append(x)
            if not rows_of:
                continue
            anchor, content, a, last = (np.concatenate(p) for p in parts)
            if not with_place:
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                continue
            row = np.repeat([r for r, _ in rows_of], [n for _, n in rows_of])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(content), *(b.column(c).take(pa.array(row)) for c in KEY), pa.array(a), pa.array(last)],
                ["anchor", "content", *KEY, "a", "b"],
            )

    schema = f"anchor bigint, content bigint, {DOCUMENT}, a int, b int" if with_place else "anchor bigint"
    return rows.mapInArrow(run, schema)


def folded(found: DataFrame) -> DataFrame:
    """(anchor, content) -> number n and first place (smallest doc_id, then start)."""
    return found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "a", "b")).alias("first")
    )


def cut(rows: DataFrame, wanted: DataFrame, unit: str, slices: Callable, schema: str) -> DataFrame:
    """Run slices(document, text, list of wanted structs) -> columns' values on each document that `wanted` has entries for."""
    listed = wanted.groupBy(*KEY).agg(F.collect_list("want").alias("wants"))
    joined = rows.join(renamed(listed, "wants"), same_document())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for *doc, text, wants in zip(*(b.column(c).to_pylist() for c in KEY), text_bytes(b.column("text")), b.column("wants").to_pylist()):
                for values in slices(doc, text, wants):
                    for o, v in zip(out, values):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, type=t) for o, t in zip(out, types)], names)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return joined.select(*KEY, "text", "wants").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, unit_hashes: Callable, unit: str, window: int, k: int, split: Callable, join: Callable, index: Callable, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """-> (rows, spans): rows (doc_id, sub, sup, text) and spans (doc_id, sub, sup, a, b): passages starting at a..b that go.

    Rows alike in id and text are one document, whose spans hold for each of them; unless keep_first (units are bytes then), all their passages stand elsewhere and go.
    unit_hashes() -> function(text) -> uint64 per unit; split(text) -> units, join(units) -> bytes of a content. index(list of contents in order of
    first place) -> for each a bool array, a value per passage: whether it occurs in a content before (keep_first), or in any other.
    """
    spark = docs.sparkSession
    prepare(spark)
    every = source(docs)
    rows, equal = once_each(every)
    # written, so that the join below has two plain shuffles and AQE splits a very common anchor
    often = saved(scan(rows, unit_hashes, window, k, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"))
    found = saved(scan(rows, unit_hashes, window, k, True).join(often, "anchor"))
    # both sides written, so that an anchor with very many contents is split
    once = saved(folded(found))
    many = saved(once.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"))
    contents = saved(once.join(many, "anchor", "left").withColumn("contents", F.coalesce("contents", F.lit(1))))
    discard(spark, once, many)

    # whole fragments that are copies: all places, or all but the first
    calm = contents.filter(F.col("contents") <= HOT[unit]).select(*[F.col(c).alias(f"c_{c}") for c in ("anchor", "content", "n", "first", "contents")])
    at = found.join(calm.filter("c_n > 1"), (F.col("anchor") == F.col("c_anchor")) & (F.col("content") == F.col("c_content")))
    not_first = ~F.struct(*KEY, "a", "b").eqNullSafe(F.col("c_first"))
    # each part written on its own: a join alone in its stage is split where a content is very common, and no shard is decided twice
    spans = saved((at.filter(not_first) if keep_first else at).select(*KEY, "a", "b"))

    # contents that share an anchor, by shard
    shared = contents.filter((F.col("contents") > 1) & (F.col("contents") <= HOT[unit]))
    sizes = shared.agg(F.sum(F.col("first.b") - F.col("first.a") + window)).first()[0] or 0
    if sizes:
        shards = int(sizes // SHARD_UNITS[unit]) + 1
        wanted = shared.select(*(F.col(f"first.{c}").alias(c) for c in KEY), F.struct(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), F.col("first.a").alias("a"), F.col("first.b").alias("b"), F.col("n").alias("n")).alias("want"))

        def slices(doc, text, wants):
            units = split(text)
            for w in wants:
                yield w["shard"], *doc, w["a"], w["n"], join(units[w["a"] : w["b"] + window])

        pieces = cut(rows, wanted, unit, slices, f"shard int, {DOCUMENT}, a int, n bigint, content binary")

        def decide(batches):
            for table in batches:
                # nulls first, as in Spark's order of places
                order = table.take(pc.sort_indices(table, [(c, "ascending") for c in (*KEY, "a")], null_placement="at_start"))
                starts = order.column("a").to_numpy()
                marks = index(order.column("content").to_pylist())
                n = order.column("n").to_numpy()
                row, a, b = [], [], []
                for i, m in enumerate(marks):
                    if not keep_first and n[i] > 1:
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
                    row += [i] * (len(edge) // 2)
                    a += (edge[::2] + starts[i]).tolist()
                    b += (edge[1::2] - 1 + starts[i]).tolist()
                got = order.select(KEY).take(pa.array(row, pa.int64()))
                yield got.append_column("a", pa.array(a, pa.int32())).append_column("b", pa.array(b, pa.int32()))

        def by_shard(table: pa.Table) -> pa.Table:
            return next(decide([table]))

        spans = spans.unionByName(saved(pieces.groupBy("shard").applyInArrow(by_shard, f"{DOCUMENT}, a int, b int")))

    # anchors with too many contents: passage by passage
    if contents.filter(F.col("contents") > HOT[unit]).limit(1).count():
        # written, so a join is split where an anchor is very common; a short list is broadcast, and then no fragment moves
        hot = saved(contents.filter(F.col("contents") > HOT[unit]).select("anchor").distinct())
        wanted = found.join(F.broadcast(hot) if hot.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else hot, "anchor", "left_semi").select(*KEY, F.struct("anchor", "a", "b").alias("want"))

        def passages(doc, text, wants):
            roll = Rolling(unit_hashes()(text))
            for w in wants:
                start = np.arange(w["a"], w["b"] + 1)
                for s, h in zip(start.tolist(), roll.ranges(start, start + window).view(np.int64).tolist()):
                    yield w["anchor"], h, *doc, s

        single = saved(cut(rows, wanted, unit, passages, f"anchor bigint, passage bigint, {DOCUMENT}, a int"))
        again = saved(single.groupBy("anchor", "passage").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "a")).alias("first")).filter("n > 1"))
        here = single.join(again, ["anchor", "passage"])
        if keep_first:
            here = here.filter(~F.struct(*KEY, "a").eqNullSafe(F.col("first")))
        spans = spans.unionByName(saved(here.select(*KEY, "a", F.col("a").alias("b"))))
        discard(spark, hot, single, again)
    if equal is not None and not keep_first:
        last = (F.octet_length("text") - window).cast("int")
        spans = spans.unionByName(equal.select(*KEY, F.lit(0).alias("a"), last.alias("b")).filter("b >= 0"))
    discard(spark, often, found, contents)
    return every, spans


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with `spans`, an array of struct(a, b); null where there are none."""
    listed = spans.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return rows.join(renamed(listed, "spans"), same_document(), "left").select("doc_id", "text", "spans")


def covered(spans: list[dict] | None, n: int, window: int) -> np.ndarray:
    """Bool per unit: covered by a passage that starts in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int32)
    if spans:
        np.add.at(change, [s["a"] for s in spans], 1)
        np.add.at(change, [s["b"] + window for s in spans], -1)
    return np.cumsum(change[:n]) > 0
