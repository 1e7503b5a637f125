"""Chunking and thresholded nearest neighbours."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import cosine


def chunk_bounds(text: str, size: int = 2000) -> list[tuple[int, int]]:
    """Disjoint raw spans: each ends at the last paragraph, line, sentence or word end at or before start + size that lies beyond half of it."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", " "):
                at = text.rfind(mark, start + size // 2, end + len(mark))  # a mark may begin at `end` itself
                if at > start + size * 0.5:
                    end = at + (2 if mark == ". " else 1)
                    break
        out.append((start, end))
        start = end
    return out


def chunk(docs: DataFrame, size: int = 2000) -> DataFrame:
    """doc_id, chunk_index, total_chunks, chunk_start, chunk_end, content (trimmed). Chunks that trim to nothing are left out but keep their number."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = [(i, a, e, text[a:e].strip()) for i, (a, e) in enumerate(chunk_bounds(text or "", size))]
                found = [x for x in found if x[3]]
                rows += [(doc, i, len(found), a, e, c) for i, a, e, c in found]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "chunk_index", "total_chunks", "chunk_start", "chunk_end", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_index int, total_chunks int, chunk_start int, chunk_end int, content string")


def scored(rows: DataFrame, query: DataFrame) -> DataFrame:
    """rows with their cosine `similarity` to a one-row query (embedding as q); null embeddings have none."""
    return rows.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", cosine(F.col("embedding"), F.col("q"))).drop("q")


def match(rows: DataFrame, query: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k most similar rows above the threshold to a one-row query (embedding as q), ties by vec_id; null embeddings drop out."""
    found = scored(rows, query).filter(F.col("similarity") > threshold)
    return found.orderBy(F.desc("similarity"), "vec_id").limit(k).select("vec_id", F.round("similarity", 6).alias("similarity"))


def placed(rows: DataFrame, k: int) -> DataFrame:
    """The k most similar rows with their place from 1."""
    top = rows.orderBy(F.desc("similarity"), "vec_id").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")))


def reranked(found: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """found (place, score, ...), a bounded list: the n best by an outside score, ties in their order, of these only scores from the threshold on."""
    return found.orderBy(F.desc("score"), "place").limit(n).filter(F.col("score") >= threshold)


def search(rows: DataFrame, query: DataFrame, score, threshold: float = 0.3, k: int = 20, n: int = 5, rerank: bool = True) -> DataFrame:
    """Nearest rows above the threshold, k of them, then the n best by score(rows); without reranking, or with one row, the first n as found."""
    found = placed(scored(rows, query).filter(F.col("similarity") > threshold), k).withColumn("score", score(rows))
    if not rerank:
        return found.filter(F.col("place") <= n)
    alone = F.count(F.lit(1)).over(Window.partitionBy()) == 1
    marked = found.withColumn("alone", alone)
    return marked.orderBy(F.desc("score"), "place").limit(n).filter((F.col("score") >= 0.0) | F.col("alone")).drop("alone")
