"""SimHash near-dedup: segment-popcount embedding, grid range join under Manhattan distance, exact check.

A 64-bit fingerprint is embedded as its 32 counts of set bits in two-bit segments. The Manhattan distance of two embeddings is
at most the Hamming distance of the fingerprints, so a range join of radius r on embeddings loses no pair. The grid: the
segments are dealt to `blocks` blocks; two points within r differ in at most r blocks and so agree on all counts
of some `blocks - r` blocks. Each point goes to one cell per such choice. Within a cell the Manhattan bound is checked
first, then the Hamming distance; a cell gives a spanning set of its links (not all pairs), which keeps connectivity
whole. A cell above CELL members is cut into chunks and compared chunk against chunk, so no task holds more than two chunks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, prepare, saved, text_bytes
from .components import Forest, components

#: Members of a chunk of a cell.
CELL = 4096
#: Shingles hashed at a time, which bounds the memory for a very long text.
BLOCK = 1 << 16
ODD = 0x5555555555555555


def shingle_hashes(text: bytes, k: int, seed: int = 42):
    """XXH64 of the k-word shingles (ASCII lower case, words of other than ASCII white space), in blocks of uint64."""
    words = text.lower().split()
    n = max(1, len(words) - k + 1) if words else 0
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + k - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(k))))
        yield np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=np.uint64)


def fingerprint_bits(text: bytes, k: int, bits: int = 64, seed: int = 42) -> np.ndarray:
    """Bit i (from the lowest) is set if it is in over half of the hashes; wider ones mix each hash anew for each 64."""
    ones, n = np.zeros(bits, dtype=np.int64), 0
    for h in shingle_hashes(text, k, seed):
        n += len(h)
        for lane in range(bits // 64):
            x = h if not lane else (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            x = x if not lane else x ^ (x >> np.uint64(29))
            ones[64 * lane : 64 * lane + 64] += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return ones * 2 > n


def fingerprints(docs: DataFrame, k: int = 3, wide: int = 0, wide_k: int = 5) -> DataFrame:
    """doc_id, fp (64 bits as a long), wide (binary of `wide` bits over wide_k words, empty if 0). No word: all bits zero."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            fp = np.array([np.packbits(fingerprint_bits(t, k), bitorder="little").view(np.int64)[0] for t in texts], dtype=np.int64)
            wides = [np.packbits(fingerprint_bits(t, wide_k, wide), bitorder="little").tobytes() if wide else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), pa.array(wides, pa.binary())], ["doc_id", "fp", "wide"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, wide binary")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding():
    """The 32 two-bit counts of fp, packed: high bit a AND b, low bit a XOR b."""
    fp, half = F.col("fp"), F.shiftrightunsigned("fp", 1)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(ODD)), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(F.lit(ODD)))


def cell_masks(radius: int, blocks: int) -> list[int]:
    """A mask over the packed counts for each choice of blocks - radius blocks."""
    cuts = [32 * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << 2 * s for s in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [signed(sum(block[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def cell_members(points: DataFrame, radius: int, blocks: int) -> DataFrame:
    """points (node, fp, wide) -> a row per cell (or pair of chunks of a large cell) with over one member: its members."""
    masks = cell_masks(radius, blocks)
    keyed = points.withColumn("e", embedding()).select(
        "node", "fp", "wide",
        F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell"),
    )
    sizes = keyed.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(F.lit(0))
    return (
        keyed.join(sizes, ["choice", "cell"])
        .withColumn("chunks", F.ceil(F.col("n") / CELL))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .withColumn("first", F.least("chunk", "other"))
        .withColumn("second", F.greatest("chunk", "other"))
        .groupBy("choice", "cell", "first", "second")
        .agg(F.collect_list(F.struct("node", "fp", "wide")).alias("members"))
        .select("members")
        .filter(F.size("members") > 1)
    )


def counts(fp: np.ndarray) -> np.ndarray:
    half = fp >> np.uint64(1)
    return ((fp & half & np.uint64(ODD)) << np.uint64(1)) | ((fp ^ half) & np.uint64(ODD))


def manhattan(a, b) -> np.ndarray:
    """Distance of packed two-bit counts (0 to 2): per segment |a - b| is 1 where the low bits differ, 2 where only the high ones do."""
    x = a ^ b
    low = x & np.uint64(ODD)
    return np.bitwise_count(low) + 2 * np.bitwise_count((x >> np.uint64(1)) & np.uint64(ODD) & ~low)


def cell_links(node: np.ndarray, fp: np.ndarray, radius: int, forest: Forest) -> list[tuple[int, int]]:
    """Spanning links of one cell: pairs within `radius` that join two trees of the forest."""
    out, e = [], counts(fp)
    for i in range(1, len(node)):
        near = np.flatnonzero(manhattan(e[i], e[:i]) <= radius)
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= radius]
        out += [(int(node[i]), int(node[j])) for j in near if forest.union(int(node[i]), int(node[j]))]
    return out


def cell_pairs(points: DataFrame, radius: int, blocks: int, pairs_of) -> DataFrame:
    """Edges (u, v) that pairs_of(node, fp, wide, forest) gives for the members of each cell, sorted by node; a task keeps one forest."""

    def run(batches):
        forest = Forest()
        for b in batches:
            found = []
            for members in b.column("members"):
                values = members.values
                node, fp = (values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(node, kind="stable")
                wide = np.frombuffer(b"".join(values.field(2).to_pylist()), dtype=np.uint64).reshape(len(node), -1)
                found += pairs_of(node[order], fp.view(np.uint64)[order], wide[order], forest)
            if len(forest.parent) > 1_000_000:
                forest = Forest()
            a = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    return cell_members(points, radius, blocks).mapInArrow(run, "u bigint, v bigint")


def links(points: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """points (node long, fp, wide unused), fp distinct or not -> edges (u, v) that connect what lies within Hamming distance `radius`."""
    return cell_pairs(points, radius, blocks, lambda node, fp, wide, forest: cell_links(node, fp, radius, forest))


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 3, blocks: int = 6) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per row: doc_id, fp, component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. A null doc_id takes part, but is nobody's
    component_id unless its component has no other. Equal fingerprints are one point, so groups of copies cost one row each.
    """
    prints = saved(fingerprints(docs, k).select("doc_id", "fp"))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(points.select(F.col("fp").alias("node"), "fp", F.lit(b"").alias("wide")), radius, blocks))
    joined = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: near_dedup: bits of a row's parities, each whether the row has an odd number of shingles of that bit. Sets that differ in d shingles
#: differ in at most d parities, so they rule out pairs and lose none.
WIDE = 1024
#: Words of a shingle of near_dedup.
NEAR_WORDS = 5
#: Shingles of a chunk of a family; a row counts as LEAST at least, so a chunk has 4,096 rows at most. One longer text is a chunk.
CHUNK, LEAST = 1 << 18, 64
#: Families over FAMILY rows are compared with PIVOTS of their own rows first.
FAMILY, PIVOTS = 64, 8


def shingle_sets(docs: DataFrame, k: int, *extra: str) -> DataFrame:
    """docs (node, text, extra longs) -> node, extra, wide, n, grams: the distinct XXH64 hashes of the k-word shingles, their number, and their WIDE parities."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            sets = [np.unique(np.concatenate([*shingle_hashes(t, k), np.empty(0, np.uint64)])).view(np.int64) for t in texts]
            wides = [np.packbits(np.bincount(g & (WIDE - 1), minlength=WIDE) & 1).tobytes() for g in sets]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            columns = [b.column("node"), *map(b.column, extra), pa.array(wides, pa.binary()), pa.array(np.diff(ends)), grams]
            yield pa.RecordBatch.from_arrays(columns, ["node", *extra, "wide", "n", "grams"])

    longs = "".join(f", {x} bigint" for x in extra)
    return docs.select("node", "text", *extra).mapInArrow(run, f"node bigint{longs}, wide binary, n int, grams array<bigint>")


def head_nodes(docs: DataFrame, k: int) -> DataFrame:
    """docs (node, text) -> the nodes that can have a partner at similarity 4/5 over k-word shingles; most others are left out, no such node is.

    Of a pair at 4/5 each row shares at least 4/5 of its own n shingles, so m >= 1 shared ones are among the least n - ceil(4n/5) + m
    hashes of both. With m = 1 + n // 20 a row needs 1 + ceil(4n/5) // 20 head shingles that another row's head has: that holds for a
    partner of any size. Heads are a quarter of all shingles; only they are dealt out by shingle. Rows of
    one batch that share a shingle count it there and send it on once: of a very common one, a task gets a record a batch, not a record a row.
    """

    def heads(batches):
        """gram, node, need, known: 0 for a shingle of one row of the batch, 1 for one of several, -times for what a row shares within the batch."""
        for b in batches:
            sets = [np.unique(np.concatenate([*shingle_hashes(t, k), np.empty(0, np.uint64)])) for t in text_bytes(b.column("text"))]
            n = np.array([len(g) for g in sets], dtype=np.int64)
            least = -(-4 * n // 5)
            take = n - least + 1 + n // 20
            gram = np.concatenate([*(g[:m] for g, m in zip(sets, take)), np.empty(0, np.uint64)]).view(np.int64)
            row = np.repeat(np.arange(len(sets)), np.minimum(take, n))
            order = np.argsort(gram, kind="stable")
            again = gram[order][1:] == gram[order][:-1]
            first, several = np.zeros((2, len(gram)), dtype=bool)
            first[order] = np.r_[True, ~again][: len(gram)]
            several[order] = (np.r_[again, False] | np.r_[False, again])[: len(gram)]
            times = np.bincount(row[several], minlength=len(sets))
            inside = np.flatnonzero(times)
            rows = np.r_[row[first], inside]
            node = b.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[gram[first], node[inside]]),  # the latter only spread; one that meets a shingle makes it count, which loses nothing
                    pa.array(node[rows]),
                    pa.array((1 + least // 20)[rows].astype(np.int32)),
                    pa.array(np.r_[several[first], -times[inside]].astype(np.int32)),
                ],
                ["gram", "node", "need", "known"],
            )

    dealt = docs.select("node", "text").mapInArrow(heads, "gram bigint, node bigint, need int, known int")
    rows = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    times = F.when(F.col("known") < 0, -F.col("known")).when((F.col("known") == 0) & (rows > 1), 1).otherwise(0)
    found = dealt.select("node", "need", times.alias("times")).filter("times > 0")
    return found.groupBy("node").agg(F.sum("times").alias("times"), F.min("need").alias("need")).filter("times >= need").select("node")


def prefix_links(sets: DataFrame) -> DataFrame:
    """sets (node, n, grams) -> links (u, v) that put every pair at similarity 4/5 into one component.

    Prefix filter: with the shingles of each row sorted by the number of rows that have them, rarest first, both rows of such a pair have a
    common one among their first n - ceil(4n/5) + 1. The rows of a shingle link to the least of them, so a common one makes no pairs.
    Rows of one node and size go as one: with more shingles to sort, its head is longer by as many as it gained and so holds the head of each row.
    """
    flat = sets.select("node", "n", F.explode("grams").alias("gram"))
    often = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    ranked = flat.join(often, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("rows", "gram"))).alias("common"))
    take = F.size("common") + 1 - F.ceil(F.col("n") * 4 / 5).cast("int")  # the shingles of one row come first
    heads = saved(ranked.withColumn("take", take).filter("take > 0").select("node", F.explode(F.slice("common", F.lit(1), F.col("take"))).alias("x")).select("node", "x.gram"))
    least = heads.groupBy("gram").agg(F.min("node").alias("least"))
    return heads.join(least, "gram").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))


def similar_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets (node, n, grams) have Jaccard similarity 4/5 or more. Sizes go first: a pair whose sizes differ by over a fifth can't reach it."""
    size = lambda end: sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    grams = lambda end: sets.select(F.col("node").alias(end), F.col("grams").alias(f"grams_{end}"), F.col("n").alias(f"n_{end}"))
    close = pairs.join(size("u"), "u").join(size("v"), "v").filter("5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)")
    both = close.join(grams("u"), ["u", "n_u"]).join(grams("v"), ["v", "n_v"])
    shared = F.size(F.array_intersect("grams_u", "grams_v"))
    return both.filter(9 * shared >= 4 * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def similar(pairs: DataFrame, docs: DataFrame, k: int = NEAR_WORDS) -> DataFrame:
    """Those of pairs (u, v) whose texts in docs (node, text) have Jaccard similarity 4/5 or more over their sets of k-word shingles.

    Exact but for clashes of 64-bit hashes.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return similar_sets(pairs, saved(shingle_sets(docs.join(ends, "node", "left_semi"), k)))


def fingerprint_links(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """SimHash links (u, v) between rows of texts (node, text): fingerprints within 3 bits, as op10 links them, whose sets (node, n, grams) are at similarity 4/5.

    Rows of one fingerprint are a star at the least of them, which also stands for them in the grid. A row without a set has no link.
    """
    prints = saved(fingerprints(texts.withColumnRenamed("node", "doc_id")).select(F.col("doc_id").alias("node"), "fp"))
    points = prints.groupBy("fp").agg(F.min("node").alias("least"))
    near = links(points.select(F.col("fp").alias("node"), "fp", F.lit(b"").alias("wide"))).toDF("fp_u", "fp_v")
    end = lambda x: points.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x))
    across = near.join(end("u"), "fp_u").join(end("v"), "fp_v").select("u", "v")
    alike = prints.join(points, "fp").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return similar_sets(across.unionByName(alike).distinct(), sets)


def pivot_links(sets: DataFrame) -> DataFrame:
    """Links (u, v) at similarity 4/5 between the rows of each family (root) of over FAMILY rows and PIVOTS of its rows, chosen by hash."""
    nodes = sets.select("root", "node")
    large = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > FAMILY).select("root")
    members = nodes.join(large, "root")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node"), "node"))
    pivots = members.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("root", F.col("node").alias("v"))
    pairs = members.select("root", F.col("node").alias("u")).join(pivots, "root").filter("u <> v").select("u", "v")
    return similar_sets(pairs, sets)


def family_chunks(sets: DataFrame, trees: DataFrame) -> DataFrame:
    """sets (root, node, wide, n, grams), trees (node, tree) found so far -> a row per pair of chunks to compare: apart (two chunks?), members.

    The rows of a family's largest tree are linked already and are never compared with each other. The other rows are its rest: chunk
    against chunk, and against the chunks of the tree. A family that is one tree gives no row.
    """
    treed = sets.select("root", "node", "n").join(trees, "node", "left")
    sizes = treed.filter("tree is not null").groupBy("root", "tree").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("root").agg(F.max_by("tree", F.struct("rows", "tree")).alias("main"))
    placed = treed.join(main, "root", "left").select("root", "node", "n", (F.col("tree").isNotNull() & (F.col("tree") == F.col("main"))).alias("linked")).distinct()
    weight = F.greatest("n", F.lit(LEAST))
    chunks = lambda of: F.ceil(F.coalesce(F.sum(F.when(of, weight)), F.lit(0)) / CHUNK)
    plan = placed.groupBy("root").agg(chunks(~F.col("linked")).alias("rest"), chunks(F.col("linked")).alias("core")).filter("rest > 0 and rest + core > 0")
    number = F.when(F.col("linked"), F.col("rest") + F.pmod(F.xxhash64("node"), F.greatest("core", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), "rest"))
    last = F.when(F.col("linked"), F.col("rest")).otherwise(F.col("rest") + F.col("core")) - 1
    dealt = placed.join(plan, "root").select("root", "node", "n", "linked", number.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("other"))
    return (
        dealt.join(sets, ["root", "node", "n"])
        .groupBy("root", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"))
        .agg(F.collect_list(F.struct("node", "wide", "grams", F.col("linked"), "chunk")).alias("members"))
        .filter(F.size("members") > 1)
        .select((F.col("first") < F.col("second")).alias("apart"), "members")
    )


def chunk_links(node: np.ndarray, wide: np.ndarray, grams: list[np.ndarray], linked: np.ndarray, chunk: np.ndarray, apart: bool) -> list[tuple[int, int]]:
    """Links at similarity 4/5 that join two trees, nearest parities first. Only pairs across chunks if `apart`."""
    out, forest = [], Forest()
    core = np.flatnonzero(linked)
    for i in core[1:]:
        forest.union(int(node[core[0]]), int(node[i]))
    sizes = np.array([len(g) for g in grams])
    for i in range(1, len(node)):
        fits = 5 * np.minimum(sizes[:i], sizes[i]) >= 4 * np.maximum(sizes[:i], sizes[i])
        if apart:
            fits &= chunk[:i] != chunk[i]
        near = np.flatnonzero(fits)
        bits = np.bitwise_count(wide[near] ^ wide[i]).sum(1)
        near, bits = (x[9 * bits.astype(np.int64) <= sizes[near] + sizes[i]] for x in (near, bits))  # more can't reach 4/5
        for at in np.argsort(bits, kind="stable"):
            j, (u, v) = near[at], (int(node[near[at]]), int(node[i]))
            if forest.find(u) == forest.find(v):
                continue
            small, big = (grams[i], grams[j]) if sizes[i] < sizes[j] else (grams[j], grams[i])
            shared = np.count_nonzero(big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small) if len(big) else 0
            if 9 * shared >= 4 * (sizes[i] + sizes[j]):
                forest.union(u, v)
                out.append((u, v))
    return out


def family_links(sets: DataFrame, trees: DataFrame) -> DataFrame:
    """Links (u, v) at similarity 4/5 that connect the rows of each family as all its pairs would, given the trees."""

    def run(batches):
        for b in batches:
            found = []
            for apart, members in zip(b.column("apart").to_pylist(), b.column("members")):
                values = members.values
                node, chunk = (values.field(i).to_numpy() for i in (0, 4))
                wide = np.frombuffer(b"".join(values.field(1).to_pylist()), dtype=np.uint64).reshape(len(node), -1)
                linked = values.field(3).to_numpy(zero_copy_only=False)
                lists = values.field(2)
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)  # sorted as unsigned
                order = np.argsort(node, kind="stable")
                grams = [flat[ends[i] : ends[i + 1]] for i in order]
                found += chunk_links(node[order], wide[order], grams, linked[order], chunk[order], apart)
            a = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    return family_chunks(sets, trees).mapInArrow(run, "u bigint, v bigint")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group of rows linked at similarity 0.8 or more over five-word shingles, that with the smallest doc_id stays.

    SimHash fingerprints propose links through their grid and the sets of shingles check them. For the copies that lie more than 3 bits
    apart, a prefix filter over the sets proposes families and misses no pair at 0.8: within a family the sets of all pairs decide, but for
    pairs that SimHash has connected already. Columns stay. Rows without a word, and rows with null doc_id,
    all stay. Rows that repeat a doc_id stay or go together.
    """
    prepare(docs.sparkSession)
    worded = docs.filter(F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    texts = worded.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))
    # written, so that its size is known when the join is planned: a list small enough to be broadcast moves no text
    heads = saved(head_nodes(texts, NEAR_WORDS))
    likely = saved(shingle_sets(texts.join(heads, "node", "left_semi"), NEAR_WORDS))
    # written for the same reason: sets move only if the list of families is large
    families = saved(components(prefix_links(likely)))
    sets = saved(likely.join(families, "node").select("node", "root", "wide", "n", "grams"))
    discard(docs.sparkSession, heads, likely, families)
    first = saved(fingerprint_links(texts, sets).unionByName(pivot_links(sets)))
    links_found = saved(first.unionByName(family_links(sets, components(first).withColumnRenamed("root", "tree"))))
    gone = components(links_found).filter("node <> root").select(F.col("node").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
