"""Exact top-k inner products by vector-approximation files.

The approximation file holds for each block of vectors the range of each component and, for each vector, a byte per component: the cell of a
uniform grid over that range. Per query, cells give an upper and a lower bound of the inner product. One pass over the approximations keeps,
per query, the vectors whose upper bound reaches the k-th best lower bound; exact vectors are then read in the order of their bounds, in two
reads: the best FIRST of each query, and after them those whose bound reaches the exact k-th score. What is left can't enter the result.

Equal vectors are folded first, with their smallest ids, so one very common vector costs a single row. Blocks of queries are
broadcast, about GROUP_BYTES of them at a time, and each task scans its part of the written file once for each such group: the file is never shuffled or
copied. A task compares TILE vectors at a time, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configured, discard, prepare, saved

K, SCALE, CELLS = 10, 1024, 256
#: Rows of a block of queries and of a block of vectors; vectors compared with a block of queries at a time.
QUERY_BLOCK, VECTOR_BLOCK, TILE = 1024, 16_384, 1024
#: Bytes of queries that are broadcast at a time, in the mean.
GROUP_BYTES = 32 << 20
#: Candidates of each query whose exact vectors are read first.
FIRST = 40
#: Scores are longs; a product beyond them counts as the nearest one.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: array of longs floor(SCALE * x); without null vectors and those holding null, NaN or infinite components.

    A component beyond the longs counts as the nearest one.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, dim)


def approximated(vectors: DataFrame) -> DataFrame:
    """vectors (dim, vb, number, v) -> the file, a row per block: dim, vb, numbers, lows, highs and cells (bytes, vector by vector)."""

    def build(table: pa.Table) -> pa.Table:
        dim, vb = table.column("dim")[0].as_py(), table.column("vb")[0].as_py()
        v = matrix(table, dim)
        lows, highs = (v.min(0), v.max(0)) if dim else (np.zeros(0), np.zeros(0))
        width = np.maximum((highs - lows) / CELLS, 1e-9)
        cells = np.minimum((v - lows) / width, CELLS - 1).astype(np.uint8)
        row = [[dim], [vb], [table.column("number").to_numpy().tobytes()], [lows.tobytes()], [highs.tobytes()], [cells.tobytes()]]
        return pa.table([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["dim", "vb", "numbers", "lows", "highs", "cells"])

    return vectors.groupBy("dim", "vb").applyInArrow(build, "dim int, vb int, numbers binary, lows binary, highs binary, cells binary")


def asked_blocks(queries: DataFrame) -> DataFrame:
    """queries (dim, qb, q, v) -> a row per block: dim, qs and asked (longs as bytes, vector by vector)."""

    def build(table: pa.Table) -> pa.Table:
        row = [[table.column("dim")[0].as_py()], [table.column("q").to_numpy().tobytes()], [table.column("v").combine_chunks().flatten().to_numpy().tobytes()]]
        return pa.table([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], names=["dim", "qs", "asked"])

    return queries.groupBy("dim", "qb").applyInArrow(build, "dim int, qs binary, asked binary")


def corners(cells: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest vector of each row of cells; a unit and what rounding may take, wider each way."""
    width = np.maximum((highs - lows) / CELLS, 1e-9)
    slack = 1 + 1e-14 * np.maximum(np.abs(lows), np.abs(highs))
    return lows + cells * width - slack, np.minimum(lows + (cells + 1.0) * width, highs) + slack


def bounds(queries: np.ndarray, cells: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each query's product with each vector of a tile, within the longs."""
    low, high = corners(cells, lows, highs)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = (1e-13 * (np.abs(queries) @ np.maximum(np.abs(lows), np.abs(highs))))[:, None]
    ends = (float(LEAST), float(MOST))
    return np.clip(plus @ low.T + minus @ high.T - slack, *ends), np.clip(plus @ high.T + minus @ low.T + slack, *ends)


def near_vectors(queries: np.ndarray, cells: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, vector row, lower, upper bound) of the vectors whose upper bound reaches the k-th best lower bound of their query's in the block."""
    best = np.full((len(queries), k), -np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(cells), TILE):
        low, high = bounds(queries, cells[at : at + TILE], lows, highs)
        best = np.partition(np.concatenate([best, low], axis=1), -k, axis=1)[:, -k:]
        q, v = np.nonzero(high >= best[:, :1])  # the least of a query's k best stands first
        found.append((q, v + at, low[q, v], high[q, v]))
    q, v, low, high = (np.concatenate(x) for x in zip(*found))
    stay = high >= best[q, 0]
    return q[stay], v[stay], low[stay], high[stay]


def product(a: Column, b: Column, largest: Column) -> Column:
    """Inner product of two arrays of longs as a long; exact, or the nearest long where it lies beyond. largest: bound of its terms' sum, as a double."""
    plain = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
    wide = lambda x: x.cast("decimal(19,0)")
    exact = F.aggregate(F.zip_with(a, b, lambda x, y: F.try_multiply(wide(x), wide(y)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: F.try_add(s, x).try_cast("decimal(38,0)"))
    about = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    held = F.least(F.greatest(exact, F.lit(LEAST).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    return F.when(largest < 9e18, plain).when(exact.isNull(), F.when(about > 0, F.lit(MOST)).otherwise(F.lit(LEAST))).otherwise(held)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """vectors (vec_id, v) -> query_id, rank, vec_id, score: each query's k highest products with other rows, ties to the smaller vec_id.

    Only vectors of one length are compared. Every row is a candidate: rows that share a vec_id are listed each. A query is a vec_id and a
    vector, without one row of its own; where a query's vec_id has several vectors, each has a list. An empty table gives none.
    """
    prepare(vectors.sparkSession)
    rows = saved(vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")))
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    # of equal vectors the k + 1 smallest ids: one of them may be the query's own
    members = rows.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= k + 1)
    size = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0)).alias("size")
    distinct = saved(members.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "copies"))).alias("ids")).select("v", "ids", F.size("v").alias("dim"), size, F.monotonically_increasing_id().alias("number")))
    asked = rows.filter(is_query).select("vec_id", "v")
    queries = saved(asked.select("v").distinct().join(distinct.select("v", "dim", "size", F.col("number").alias("q")), "v"))
    n_queries, n_vectors = queries.count(), distinct.count()
    q_blocks, v_blocks = -(-n_queries // QUERY_BLOCK) or 1, max(-(-n_vectors // VECTOR_BLOCK), 1)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asking = saved(asked_blocks(queries.select("dim", "q", "v", block("q", q_blocks).alias("qb"))))
    file = saved(approximated(distinct.select("dim", "number", "v", block("number", v_blocks).alias("vb"))))
    groups = max(1, -(-(asking.agg(F.sum(F.octet_length("asked"))).first()[0] or 0) // GROUP_BYTES))

    def scan(batches):
        kinds = {"q": np.int64, "number": np.int64, "low": np.float64, "high": np.float64}
        for b in batches:
            for x in b.to_pylist():
                qs, number, lows, highs, cells, asked = (np.frombuffer(x[c], dtype=t) for c, t in (("qs", np.int64), ("numbers", np.int64), ("lows", np.float64), ("highs", np.float64), ("cells", np.uint8), ("asked", np.int64)))
                q, v, low, high = near_vectors(asked.reshape(len(qs), x["dim"]).astype(np.float64), cells.reshape(len(number), x["dim"]), lows, highs, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.from_numpy_dtype(t)) for c, t in zip((qs[q], number[v], low, high), kinds.values())], list(kinds))

    parts = []
    # a few whole blocks at a time; the join repeats a block of vectors for each block of queries as it streams by, without a shuffle
    with configured(vectors.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        for g in range(groups):
            some = asking.filter(block("qs", groups) == g)
            parts.append(saved(file.join(F.broadcast(some), "dim").mapInArrow(scan, "q bigint, number bigint, low double, high double")))
    near = vectors.sparkSession.read.schema(parts[0].schema).parquet(*(p.__dict__["saved_at"] for p in parts))
    # the k+1st best lower bound over all blocks; its own vector may be one of them
    by_low, by_high = Window.partitionBy("q").orderBy(F.desc("low"), "number"), Window.partitionBy("q").orderBy(F.desc("high"), "number")
    kth = saved(near.withColumn("r", F.row_number().over(by_low)).filter(F.col("r") == k + 1).select("q", F.col("low").alias("kth")))
    left = saved(near.join(kth, "q", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("q", "number", "high"))
    other = queries.select("q", F.col("v").alias("qv"), F.col("size").alias("q_size"))
    largest = F.col("size") * F.col("q_size") * F.size("v")

    def read(candidates: DataFrame) -> DataFrame:
        return candidates.join(distinct.select("number", "v", "size"), "number").join(other, "q").select("q", "number", product(F.col("qv"), F.col("v"), largest).alias("score"))

    first = read(left.withColumn("r", F.row_number().over(by_high)).filter(F.col("r") <= FIRST).select("q", "number"))
    certain = saved(first.withColumn("s", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("s") == k + 1).select("q", F.col("score").alias("enough")))
    scored = saved(read(left.join(certain, "q", "left").filter(F.col("enough").isNull() | (F.col("high") >= F.col("enough"))).select("q", "number")))
    # a query's k + 1 best distinct vectors hold its k best rows besides itself
    best = scored.withColumn("s", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("s") <= k + 1).drop("s")
    pairs = best.join(distinct.select("number", "ids"), "number").select("q", "number", "score", F.inline("ids"))
    pairs = pairs.withColumn("s", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("s") <= k + 1)
    ask = asked.join(queries.select("q", "v"), "v").select(F.col("vec_id").alias("query_id"), "q")
    own = ((F.col("q") == F.col("number")) & (F.col("query_id") == F.col("vec_id"))).cast("bigint")
    others = pairs.join(ask, "q").withColumn("copies", F.least(F.col("copies") - own, F.lit(k))).filter("copies > 0")
    listed = others.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")))
    result = saved(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(vectors.sparkSession, rows, distinct, queries, asking, file, *parts, kth, left, certain, scored)
    return result


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
