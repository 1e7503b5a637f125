"""Loading a table in batches that succeed or fail alone: what a failing batch holds is left out and reported, the rest is loaded, and a second
run loads what is missing.

A batch is a file of its own, written under another name and then moved to its place, so a task that is tried again, or twice at once, leaves one
copy of it, and what stands there is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keyed import batched

BATCH = 100
REPORT = "batch bigint, n bigint, status string, error string"


def embeddable(most: int, column: str = "text") -> Callable[[pa.Table], pa.Table]:
    """A check of a batch before it goes in: raises at its first text that is missing or has over `most` code points."""

    def check(batch: pa.Table) -> pa.Table:
        for i, text in enumerate(batch.column(column).to_pylist()):
            if text is None or len(text) > most:
                raise ValueError(f"row {i} of the batch: " + ("no text" if text is None else f"{len(text)} characters, at most {most} fit"))
        return batch

    return check


def load(rows: DataFrame, order: str, folder: str, prepared: Callable[[pa.Table], pa.Table], size: int = BATCH) -> DataFrame:
    """Loads rows into folder by batches of `size` in the order of a column without ties -> the report: batch, n, status, error, saved.

    prepared(batch) gives what is written; whatever it or the write raises fails this batch alone. status: `loaded`, `failed`, or `there` for a batch that an
    earlier run has loaded. A run over the same keys with mended rows loads what had failed, once. A batch is one task's, of `size` rows in memory.
    """
    spark = rows.sparkSession
    numbered = batched(rows, order, size).withColumn("batch", F.col("batch").cast("bigint"))
    dealt = numbered.repartition("batch").sortWithinPartitions("batch", order).select("batch", *rows.columns)

    def put(store: fs.FileSystem, base: str, number: int, parts: list[pa.RecordBatch]) -> tuple[str, str | None]:
        place = f"{base}/batches/batch-{number:012d}.parquet"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            return "there", None
        waiting = f"{base}/_waiting/{uuid.uuid4().hex}"
        try:
            batch = prepared(pa.Table.from_batches(parts))
            with store.open_output_stream(waiting) as out:
                pq.write_table(batch, out)
            store.move(waiting, place)
        except Exception as e:  # noqa: BLE001  (any failure is this batch's, and goes into the report)
            return "failed", f"{type(e).__name__}: {e}"
        return "loaded", None

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{base}/batches", recursive=True)
        store.create_dir(f"{base}/_waiting", recursive=True)
        number, parts = None, []

        def done():
            status, error = put(store, base, number, parts)
            return pa.RecordBatch.from_pylist([{"batch": number, "n": sum(p.num_rows for p in parts), "status": status, "error": error}], schema=schema)

        schema = pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("status", pa.string()), ("error", pa.string())])
        for b in batches:
            numbers = b.column(0).to_numpy()
            at = 0
            while at < len(numbers):
                end = at + int((numbers[at:] == numbers[at]).sum())
                if number is not None and numbers[at] != number:
                    yield done()
                    parts = []
                number = int(numbers[at])
                parts.append(b.slice(at, end - at).select(rows_columns))
                at = end
        if parts:
            yield done()

    rows_columns = rows.columns
    report = f"{folder}/_reports/{uuid.uuid4().hex}"
    dealt.mapInArrow(run, REPORT).write.parquet(report)
    return spark.read.schema(REPORT).parquet(report)


def loaded(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """What is in a folder of `load`; like: a table of its columns."""
    return spark.read.schema(like.schema).parquet(f"{folder}/batches")
