"""Hard negatives by a vertical scan of vectors (branch and bound over dimensions).

The vectors are written as a columnar file, a row per block: one column of numbers for each dimension, with its least and greatest value. A task
takes the dimensions in the order of an anchor's magnitudes, greatest first, and adds their contributions for the candidates that are left. What
the remaining dimensions can still add lies between sums of their least and greatest contributions, so each candidate has a lower and an upper
bound, and the bitmap of candidates shrinks until the windows of scores are certain. Two scans: the first finds each anchor's best positives, the
second the negatives within the windows that these positives set.

The file is never shuffled: blocks of anchors are broadcast, at most about GROUP_BYTES of them at a time, and every task scans its part of the file
once for each such group. A task keeps an anchor's best so far from block to block, so it returns few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configured, discard, prepare, saved

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Percent of the positive's score between which a negative's lies.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Bytes of a block of vectors, of a block of anchors, and of the anchors that are broadcast at a time (the last in the mean).
BLOCK_BYTES, ANCHOR_BYTES, GROUP_BYTES = 4 << 20, 512 << 10, 32 << 20
#: Bytes that a task holds for an anchor besides its vector; dimensions between two prunings.
HELD, STEP = 1024, 8
#: Scores are longs; a product beyond them counts as the nearest one.
LEAST, MOST = -(1 << 63), (1 << 63) - 1

BLOCK = "dim int, rows binary, ids binary, labels binary, vectors binary"


def labelled(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, v (array of longs floor(SCALE * x)) of the rows that take part, saved; a component beyond the longs counts as the nearest one."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return saved(embeddings.filter(F.coalesce(fine, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")))


def columnar(rows: DataFrame, block_bytes: int = BLOCK_BYTES, held: int = 0, extra: str | None = None) -> DataFrame:
    """rows (row, vec_id, label, v) -> the file, saved. A block holds vectors of one length from one task. extra: a column of longs' arrays, kept as bytes of POSITIVES longs a row."""

    def block(dim: int, parts: list) -> pa.RecordBatch:
        ids, vectors, more = (np.concatenate([p[i] for p in parts], axis=a) for i, a in ((0, 1), (1, 0), (2, 0)))
        row = [[dim], *([x.tobytes()] for x in ids), [np.ascontiguousarray(vectors.T).tobytes()], [more.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 5))], ["dim", "rows", "ids", "labels", "vectors", "more"])

    def run(batches):
        waiting: dict[int, list] = {}
        for b in batches:
            ids, (v, more) = np.array([b.column(i).to_numpy() for i in range(3)], dtype=np.int64), (b.column(i) for i in (3, 4))
            cuts, flat = v.offsets.to_numpy(), v.flatten().to_numpy()
            sizes, starts = np.diff(cuts), cuts[:-1] - cuts[0]
            scores = more.flatten().to_numpy().reshape(b.num_rows, -1)
            for dim in np.unique(sizes).tolist():
                at, most = np.flatnonzero(sizes == dim), max(1, block_bytes // (8 * dim + held or 1))
                own = waiting.setdefault(dim, [])
                for k in range(0, len(at), most):
                    part = at[k : k + most]
                    if sum(p[0].shape[1] for p in own) + len(part) > most:
                        yield block(dim, own)
                        own.clear()
                    own.append((ids[:, part], flat[starts[part][:, None] + np.arange(dim)], scores[part]))
            if len(waiting) > 64:  # tables of vectors of all lengths
                yield from (block(dim, own) for dim, own in waiting.items() if own)
                waiting = {}
        yield from (block(dim, own) for dim, own in waiting.items() if own)

    more = F.array().cast("array<bigint>") if extra is None else F.col(extra)
    return saved(rows.select("row", "vec_id", "label", "v", more.alias("more")).mapInArrow(run, f"{BLOCK}, more binary"))


class Block:
    """A row of the file in a task."""

    def __init__(self, dim: int, rows: bytes, ids: bytes, labels: bytes, vectors: bytes):
        self.dim = dim
        self.rows, self.ids, self.labels = (np.frombuffer(x, dtype=np.int64) for x in (rows, ids, labels))
        self.whole = np.frombuffer(vectors, dtype=np.int64).reshape(dim, len(self.rows))
        self.columns = self.whole.astype(np.float64)
        self.lows, self.highs = (self.columns.min(1), self.columns.max(1)) if dim else (np.zeros(0), np.zeros(0))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (positions) that keep(lower, upper bounds) leaves of alive after all dimensions, with their exact scores."""
        a = anchor.astype(np.float64)
        order = np.argsort(-np.abs(a), kind="stable")
        ends = np.array([a * self.lows, a * self.highs])[:, order]
        low, high = (np.append(np.cumsum(x[::-1])[::-1], 0.0) for x in (ends.min(0), ends.max(0)))
        size = float(np.abs(ends).max(0).sum())
        exact = size < 2**53
        slack = 0.0 if exact else size * 1e-12
        so_far = np.zeros(len(alive))
        for at in range(0, self.dim, STEP):
            d = order[at : at + STEP]
            so_far = so_far + a[d] @ (self.columns[d] if len(alive) == len(self.rows) else self.columns[d][:, alive])
            stay = keep(so_far + low[at + len(d)] - slack, so_far + high[at + len(d)] + slack)
            if not stay.all():
                alive, so_far = alive[stay], so_far[stay]
            if not len(alive):
                break
        if exact:
            return alive, so_far.astype(np.int64)
        whole = [sum(x * y for x, y in zip(anchor.tolist(), self.whole[:, i].tolist())) for i in alive]
        return alive, np.array([min(max(x, LEAST), MOST) for x in whole], dtype=np.int64)


def first(k: int, scores: np.ndarray, *ids: np.ndarray) -> np.ndarray:
    """Positions of the k highest scores; ties to the smaller of ids."""
    return np.lexsort((*ids[::-1], scores == LEAST, -np.maximum(scores, LEAST + 1)))[:k]


def kth(k: int, values: np.ndarray) -> float:
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


class Best:
    """Scores, ids and rows of an anchor's best so far."""

    def __init__(self):
        self.found = np.zeros((3, 0), dtype=np.int64)

    def add(self, k: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        both = np.concatenate([self.found, [scores, ids, rows]], axis=1)
        self.found = both[:, first(k, *both)]

    def floor(self, k: int) -> float:
        """What a further score must reach; less by what a double may lose of a long."""
        return self.found[0, -1] * (1 - np.sign(self.found[0, -1]) * 1e-15) if self.found.shape[1] == k else -np.inf


def nearest_positives(block: Block, anchor: np.ndarray, row: int, label: int, best: list[Best], k: int) -> None:
    alive = np.flatnonzero((block.labels == label) & (block.rows != row))
    floor = best[0].floor(k)
    alive, scores = block.scan(anchor, alive, lambda low, high: high >= max(floor, kth(k, low)))
    best[0].add(k, scores, block.ids[alive], block.rows[alive])


def windowed_negatives(block: Block, anchor: np.ndarray, label: int, positives: list[int], best: list[Best], k: int) -> None:
    """Adds to best, window by window, the block's rows of other labels whose score lies in the window of a positive's score."""
    ranges = [(-(-LEAST_SHARE * p // 100), MOST_SHARE * p // 100) for p in positives]
    ends = [(float(lo), float(hi), b.floor(k)) for (lo, hi), b in zip(ranges, best) if lo <= hi]

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), dtype=bool)
        for lo, hi, floor in ends:
            stay |= (low <= hi) & (high >= max(lo, floor, kth(k, low[(low >= lo) & (high <= hi)])))
        return stay

    if not ends:
        return
    alive, scores = block.scan(anchor, np.flatnonzero(block.labels != label), keep)
    for (lo, hi), own in zip(ranges, best):
        fit = alive[(scores >= lo) & (scores <= hi)]
        own.add(k, scores[(scores >= lo) & (scores <= hi)], block.ids[fit], block.rows[fit])


def scanned(file: DataFrame, anchors: DataFrame, wanted: int, negatives: bool) -> DataFrame:
    """The file against blocks of anchors -> anchor (row), window, id, other (row), score: each task's best for each anchor and window, saved.

    negatives: anchors carry the scores of their positives, and each of these sets a window; else one window for all rows of the anchor's label.
    """
    spark = file.sparkSession
    names = ["rows", "labels", "vectors", "more"]
    group = anchors.agg(F.sum(F.octet_length("vectors") + HELD * F.octet_length("rows") / 8)).first()[0] or 0
    groups = max(1, int(-(-group // GROUP_BYTES)))
    asking = anchors.select("dim", *(F.col(n).alias(f"a_{n}") for n in names), F.pmod(F.xxhash64("rows"), F.lit(groups)).alias("g"))

    def run(batches):
        best: dict[int, list[Best]] = {}
        for b in batches:
            for x in b.to_pylist():
                block = Block(x["dim"], x["rows"], x["ids"], x["labels"], x["vectors"])
                rows, labels = (np.frombuffer(x[n], dtype=np.int64) for n in ("a_rows", "a_labels"))
                vectors, more = np.frombuffer(x["a_vectors"], dtype=np.int64).reshape(x["dim"], len(rows)), np.frombuffer(x["a_more"], dtype=np.int64).reshape(len(rows), -1)
                for i, (row, label) in enumerate(zip(rows.tolist(), labels.tolist())):
                    if negatives:
                        n, scores = more[i, 0], more[i, 1:].tolist()
                        own = best.setdefault(row, [Best() for _ in range(n)])
                        windowed_negatives(block, vectors[:, i], label, scores[:n], own, wanted)
                    else:
                        nearest_positives(block, vectors[:, i], row, label, best.setdefault(row, [Best()]), wanted)
        for row, own in best.items():
            for w, x in enumerate(own):
                score, ids, rows = x.found
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row)), pa.array(np.full(len(score), w)), pa.array(ids), pa.array(rows), pa.array(score)], ["anchor", "window", "id", "other", "score"])

    parts = []
    # a few whole blocks at a time; the join repeats a block for each block of anchors as it streams by, without a shuffle
    with configured(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        for g in range(groups):
            own = asking.filter(F.col("g") == g).drop("g")
            parts.append(saved(file.drop("more").join(F.broadcast(own), "dim").mapInArrow(run, "anchor bigint, window bigint, id bigint, other bigint, score bigint")))
    if len(parts) == 1:
        return parts[0]
    whole = saved(spark.read.schema(parts[0].schema).parquet(*(p.__dict__["saved_at"] for p in parts)))
    discard(spark, *parts)
    return whole


def ranked(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its first positives, the first rows of another label whose score is 30 % to 90 % of the positive's. Rows with a
    null id, label or vector and those holding null, NaN or infinite components take no part. Only vectors of one length are compared. Every row
    is a candidate but an anchor's own row: rows that repeat an id count each, and an anchor that stands twice is answered twice. Ties go to
    the smaller vec_id. A positive of negative score has no negatives. An empty table, or one without anchors, gives none.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    rows = labelled(embeddings)
    file = columnar(rows)
    asked = saved(rows.filter(is_anchor))
    blocks = columnar(asked, ANCHOR_BYTES, HELD)
    best = scanned(file, blocks, positives, False)
    near = saved(ranked(best, positives).select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("s"))
    # how many there are, then the scores, filled up to the same length
    padded = F.concat(F.array(F.size("s").cast("bigint")), F.slice(F.concat("s", F.array_repeat(F.lit(0).cast("bigint"), positives)), 1, positives)).alias("scores")
    again = columnar(asked.join(scores, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "v", padded), ANCHOR_BYTES, HELD, "scores")
    windowed = scanned(file, again, negatives, True)
    pairs = near.withColumn("window", F.col("rank").cast("bigint") - 1).drop("rank").join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    result = saved(ranked(windowed, negatives).join(pairs, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    discard(spark, rows, file, asked, blocks, best, near, again, windowed)
    return result


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
             n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
      FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LEAST_SHARE} * p.score <= 100 * n.score AND 100 * n.score <= {MOST_SHARE} * p.score)
SELECT * FROM r WHERE rank <= {NEGATIVES}
"""
