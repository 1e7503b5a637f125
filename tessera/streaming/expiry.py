"""Streams whose state ends by itself: runs that turn stale without a heartbeat, and records of status that a sweep takes away.

Both keep keyed state in RocksDB, runs with event-time timers and statuses as session windows: when the watermark passes an entry's end it leaves the state
as a row of the result, so the state holds what is alive and no more. An event that comes after the end of its entry, but before the watermark told so, ends it first: results don't
depend on how events fall into micro-batches, if those of a key come in order. Times are counted in whole milliseconds.

`stale_runs` and `swept` give the same rows of a finished table by windows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from tessera.operators.records import lease_events

# the processors travel with the query: workers that set up its state on the driver needn't find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A run without a heartbeat for so long is stale; a record of status that nobody renews lives as long as that.
STALE_HOURS, STATUS_MINUTES = 4, 60


def millis(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


class Runs(StatefulProcessor):
    """State of a conversation: its running run (root, time of the last heartbeat) or nothing. A timer stands where that run would turn stale."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "root bigint, beat bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.run.get() if self.run.exists() else None
        root, beat = before or (None, None)
        out = []
        for at, _, kind, of in sorted(zip(*(x for chunk in [pd.concat(list(rows))] for x in (chunk["ms"], chunk["n"], chunk["kind"], chunk["root"])))):
            if beat is not None and at >= beat + self.patience:
                out.append((key[0], root, beat + self.patience))
                root, beat = None, None
            given = None if pd.isna(of) else int(of)
            if kind == "start":
                root, beat = given, at
            elif beat is not None and given in (None, root):
                root, beat = (root, at) if kind == "touch" else (None, None)
        if before is not None:
            self.handle.deleteTimer(int(before[1] + self.patience))
        if beat is None:
            self.run.clear()
        else:
            self.run.update((root, int(beat)))
            self.handle.registerTimer(int(beat + self.patience))
        yield ended(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        root, beat = self.run.get()
        self.run.clear()
        yield ended([(key[0], root, beat + self.patience)])

    def close(self) -> None:
        pass


def ended(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"conv": pd.Series([r[0] for r in rows], dtype="int64"), "root": pd.Series([r[1] for r in rows], dtype="Int64"), "stale_ms": pd.Series([r[2] for r in rows], dtype="int64")})


def stale_runs_stream(events: DataFrame, hours: int = STALE_HOURS, delay: str = "0 seconds") -> DataFrame:
    """A stream of events as records.lease_events has them (conv, at, n, kind, root) -> conv, root, stale_ms of each run that turned stale."""
    rows = events.select("conv", F.col("at").cast("timestamp").alias("at"), millis(F.col("at")).alias("ms"), "n", "kind", F.col("root").cast("bigint").alias("root"))
    return rows.withWatermark("at", delay).groupBy("conv").transformWithStateInPandas(Runs(hours * 3_600_000), "conv bigint, root bigint, stale_ms bigint", "Append", "EventTime")


def stale_runs(events: DataFrame, hours: int = STALE_HOURS) -> DataFrame:
    """events (conv, at, n, kind, root) -> conv, root, stale_ms of each run that stood `hours` without an effective event up to the last event of all.

    A run ends there as stale: what comes for it later has no effect. Times are whole milliseconds.
    """
    key = Window.partitionBy("conv", "run").orderBy("at", "n")
    started = F.sum((F.col("kind") == "start").cast("int")).over(Window.partitionBy("conv").orderBy("at", "n"))
    live = lease_events(events).join(events.select("conv", "n", F.col("root").cast("bigint").alias("own")), ["conv", "n"]).withColumn("run", started)
    beats = live.filter("done and (running or kind = 'finish')").select("conv", "run", "at", "n", "kind", millis(F.col("at")).alias("ms"), F.first("own").over(key).alias("root"))
    end = events.agg(F.max(millis(F.col("at"))).alias("end"))
    gaps = beats.withColumn("after", F.lead("ms").over(key)).crossJoin(F.broadcast(end)).withColumn("after", F.coalesce("after", F.lead("ms").over(Window.partitionBy("conv").orderBy("at", "n")), "end"))
    late = gaps.filter((F.col("kind") != "finish") & (F.col("after") >= F.col("ms") + hours * 3_600_000))
    return late.groupBy("conv", "run").agg(F.min_by("root", "ms").alias("root"), F.min(F.col("ms") + hours * 3_600_000).alias("stale_ms")).drop("run")


def swept_stream(updates: DataFrame, minutes: int = STATUS_MINUTES, delay: str = "0 seconds") -> DataFrame:
    """A stream of updates (conv, file, at, n, status) -> conv, file, status, ended_ms of each record that nobody renewed in time; it is swept away then.

    A record and what renews it are a session of its file, with the life of a record as its gap. A microsecond more, as times are whole milliseconds: at
    its end a record still lives.
    """
    rows = updates.select("conv", "file", F.timestamp_millis(millis(F.col("at"))).alias("at"), "n", "status")
    life = F.session_window("at", f"{minutes * 60_000} milliseconds 1 microsecond")
    ended = rows.withWatermark("at", delay).groupBy("conv", "file", life).agg(F.max_by("status", F.struct("at", "n")).alias("status"))
    return ended.select("conv", "file", "status", F.unix_millis("session_window.end").alias("ended_ms"))


def swept(updates: DataFrame, minutes: int = STATUS_MINUTES) -> DataFrame:
    """updates (conv, file, at, n, status) -> conv, file, status, ended_ms of each record that ended before its next update, or before the last update of all."""
    after = F.lead("ms").over(Window.partitionBy("conv", "file").orderBy("at", "n"))
    rows = updates.withColumn("ms", millis(F.col("at"))).withColumn("after", after).withColumn("ended_ms", F.col("ms") + minutes * 60_000)
    end = updates.agg(F.max(millis(F.col("at"))).alias("end"))
    return rows.crossJoin(F.broadcast(end)).filter(F.col("ended_ms") < F.coalesce("after", "end")).select("conv", "file", "status", "ended_ms")


def run_through(spark: SparkSession, stream: DataFrame, folder: str) -> tuple[DataFrame, list[int]]:
    """All that is there of a stream, run to its end with checkpoints below folder: the rows that it gave, and the rows of state after each micro-batch."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), state
