"""Exact dedup by stateful streaming: keyed state without expiry, full bytes checked on hits.

A stream of (digest, doc_id, locator) rows feeds a keyed aggregation whose state lives in the RocksDB state store
(disk-backed, snapshots in the shared checkpoint folder, no watermark and so no expiry). State per digest: the
stable identifier (largest doc_id so far), the content locator of that row (file and row index where the input is read
from files, and its length in bytes) and the number of rows. Every hit is confirmed by comparing the full text with that at the
locator of the row that stays; texts that differ under one digest are regrouped by text. Texts whose digest came once are never moved.

Everything here is DataFrame or SQL operations.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configured, discard, free_name, saved, shared_folder

#: The digests hit more than once are broadcast up to this many (40 bytes each); beyond, a shuffled join that AQE splits on skew.
MAX_BROADCAST = 100_000

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no 4 MB of disk set aside for each one's manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def body() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def locator(docs: DataFrame) -> list[Column]:
    """File and row index of each row; nulls where docs isn't read from Parquet files."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return [F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row")]
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def keyed_state(stream: DataFrame) -> DataFrame:
    """Streaming plan: per digest the largest doc_id, its locator and the number of rows. Works on batches alike."""
    return stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row", "n_bytes")).alias("holder"), F.count(F.lit(1)).alias("n_rows")
    )


def run_stream(arrivals: DataFrame, bytes_per_batch: int = 16 << 30) -> DataFrame:
    """Stream arrivals, a saved table, through keyed_state; the last state of every digest, saved.

    It is read micro-batch by micro-batch (bytes_per_batch of it at a time), so state carries from one micro-batch to the next.
    """
    spark = arrivals.sparkSession
    sink, checkpoint = shared_folder(spark), shared_folder(spark)
    stream = spark.readStream.schema(arrivals.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(arrivals.__dict__["saved_at"])

    def emit(batch: DataFrame, number: int) -> None:
        batch.select("digest", "holder", "n_rows", F.lit(number).alias("batch")).write.mode("overwrite").parquet(
            f"{sink}/batch={number:09d}"
        )

    with configured(spark, ROCKS):
        query = (
            keyed_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    schema = "digest binary, holder struct<doc_id: bigint, file: string, row: bigint, n_bytes: int>, n_rows bigint, batch bigint"
    batches = query.lastProgress["batchId"] if query.lastProgress else -1
    discard(spark, checkpoint)
    if batches < 0:
        return spark.createDataFrame([], schema).drop("batch")
    updates = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(sink)
    if batches == 0:
        return updates.drop("batch")
    return updates.groupBy("digest").agg(F.max_by(F.struct("holder", "n_rows"), "batch").alias("s")).select("digest", "s.*")


def few(table: DataFrame) -> DataFrame:
    """table, marked for a broadcast if it has MAX_BROADCAST rows at most."""
    return F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table


def marked(docs: DataFrame, digest: Column | None = None, bytes_per_batch: int = 16 << 30) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per row: digest, doc_id, keep_id, group_size. digest: of body(), SHA-256 unless given."""
    digest = (F.unhex(F.sha2(body().cast("binary"), 256)) if digest is None else digest).alias("digest")
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    arrivals = saved(docs.select(digest, doc_id, *locator(docs), F.octet_length(body()).alias("n_bytes")))
    state = run_stream(arrivals, bytes_per_batch)
    known = arrivals.select("digest", "doc_id").join(state.select("digest", F.col("holder.doc_id").alias("keep_id"), F.col("n_rows").alias("group_size")), "digest")
    # the texts of digests hit again, each against that at the locator of the row that stays
    hits = saved(state.filter("n_rows > 1").select("digest", "holder"))
    texts = docs.select(digest, doc_id, *locator(docs), body().alias("text"))
    members = saved(texts.join(few(hits.select("digest")), "digest", "left_semi"))
    at = [F.col(c).eqNullSafe(F.col(f"holder.{c}")) for c in ("file", "row", "doc_id")]
    held = saved(members.join(few(hits), "digest").filter(at[0] & at[1] & at[2]).groupBy("digest").agg(F.min("text").alias("held_text")))
    # the join alone, so that a large group is split
    unlike = saved(members.join(held, "digest").filter("text <> held_text").select("digest"))
    if not unlike.isEmpty():
        clash = unlike.distinct()
        again = members.join(clash, "digest", "left_semi").select("digest", "doc_id", "text")
        groups = again.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = saved(known.join(clash, "digest", "left_anti").unionByName(
            again.join(groups, ["digest", "text"]).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "doc_id", "keep_id", "group_size")
        ))
    discard(docs.sparkSession, members, held, unlike)
    return known


def exact_dedup(docs: DataFrame, digest: Column | None = None, bytes_per_batch: int = 16 << 30) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null text counts as empty. A null doc_id is smaller than
    any other; rows that repeat a doc_id within a group of equal texts are all marked alike. An empty table gives none.
    """
    return marked(docs, digest, bytes_per_batch).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; of rows alike in doc_id and text one stays. Columns stay, whatever their names.

    Rows whose text came once stay where they are: only the digests of repeated texts meet them. An empty table gives none.
    """
    groups = saved(
        marked(docs.select("doc_id", "text")).filter("group_size > 1")
        .groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.count_if(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("alike"))
    )
    sha, keep, alike = (free_name(x, docs.columns) for x in ("sha", "keep", "alike"))
    repeated = groups.select(F.col("digest").alias(sha), F.struct("keep_id").alias(keep), F.col("alike").alias(alike))
    left = docs.withColumn(sha, F.unhex(F.sha2(body().cast("binary"), 256))).join(few(repeated), sha, "left")
    left = left.filter(F.col(keep).isNull() | F.col("doc_id").cast("bigint").eqNullSafe(F.col(f"{keep}.keep_id")))
    if groups.filter("alike > 1").isEmpty():
        return left.select(docs.columns)
    again = F.coalesce(F.col(alike) > 1, F.lit(False))
    return left.filter(~again).select(docs.columns).unionByName(left.filter(again).dropDuplicates([sha]).select(docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
