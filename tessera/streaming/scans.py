"""Folders of documents as a stream of files: each run takes the files that no run before it has taken, in subfolders too, and sets aside those that are no text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length bigint, content binary"
TAKEN = "path string, modificationTime timestamp, length bigint, text string, reason string, run bigint"


def scan_new(spark: SparkSession, folder: str, store: str, pattern: str = "*", files_per_batch: int = 1000) -> int:
    """Takes what is new below folder into store; the number of files taken, set aside or not.

    The stream's checkpoint knows the files taken. A micro-batch is written under its number, over what a failed try may have left, so each file is
    there once. A file that isn't UTF-8 is set aside, without a text and with a reason; Spark passes over files
    of no bytes, and so does this.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    text = F.col("content").cast("string")
    fine = F.is_valid_utf8(text)

    def take(batch: DataFrame, number: int) -> None:
        read = batch.select("path", "modificationTime", "length", F.when(fine, text).alias("text"), F.when(~fine, "not UTF-8").alias("reason"), F.lit(number).cast("bigint").alias("run"))
        read.write.mode("overwrite").parquet(f"{store}/files/{number:09d}")

    query = files.writeStream.option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def taken(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(TAKEN).option("recursiveFileLookup", True).parquet(f"{store}/files")


def texts(spark: SparkSession, store: str) -> DataFrame:
    """path, modificationTime, length, text and run (the micro-batch) of all files taken so far."""
    return taken(spark, store).filter("reason is null").drop("reason")


def rejects(spark: SparkSession, store: str) -> DataFrame:
    """path, length, reason and run of the files set aside."""
    return taken(spark, store).filter("reason is not null").select("path", "length", "reason", "run")
