"""Rate limits and change feeds, on batches and streams alike."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .events import MOST_BYTES, folded


def admit(window: deque, now: int, most: int, seconds: int) -> bool:
    """Whether a request at `now` is admitted; window, the entries that count, holds at most `most` of them."""
    while window and window[0] <= now - seconds:
        window.popleft()
    if len(window) < most:
        window.append(now)
        return True
    while window and window[-1] == now:
        window.pop()
    return False


def admitted(requests: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """requests (user_id, action, epoch, event_id) -> the same with `admitted`: exact sliding window per user and action.

    Entries of epoch <= now - seconds fall out; a request is admitted while fewer than `most` are left. A rejected request takes the
    entries of its own second with it, admitted ones too. Requests of a key are taken by epoch, then event_id: keys are dealt by hash, sorted
    within partitions and read as a stream, with one window in memory whatever the size of a key.
    """
    columns = ["user_id", "action", "epoch", "event_id"]
    rows = requests.select(columns).repartition("user_id", "action").sortWithinPartitions(*columns)

    def run(batches):
        last, window = None, deque()
        for b in batches:
            marks = []
            for user, action, now in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (user, action) != last:
                    last, window = (user, action), deque()
                marks.append(admit(window, now, most, seconds))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.bool_())], [*columns, "admitted"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("admitted", BooleanType())]))


def admitted_stream(requests: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """A stream of requests with `admitted`; a key's window is its state. Requests of a key count in order of micro-batches, then of epoch and event_id."""

    def step(state, rows):
        window = deque(state[0] if state else [])
        marks = [admit(window, now, most, seconds) for now in rows["epoch"].tolist()]
        return (list(window),), rows.assign(admitted=marks)[["user_id", "action", "epoch", "event_id", "admitted"]]

    return folded(requests, ["user_id", "action"], "user_id bigint, action string, epoch bigint, event_id bigint, admitted boolean", "epochs array<bigint>", ["epoch", "event_id"], step)


def leases_stream(events: DataFrame) -> DataFrame:
    """A stream of events (conv, at, n, kind, root) with `done` and `running`, as records.lease_events has them; a conversation's run is its state."""

    def step(state, rows):
        there, running, own = state if state else (False, False, None)
        done, after = [], []
        for kind, root in zip(rows["kind"], rows["root"].astype(object).where(rows["root"].notna(), None)):
            fits = there and (root is None or (own is not None and int(root) == own))
            if kind == "start":
                there = running = ok = True
                own = None if root is None else int(root)
            elif kind == "touch":
                ok = fits and running
            else:
                ok = fits
                running = running and not fits
            done.append(ok)
            after.append(running)
        return (there, running, own), rows.assign(done=done, running=after)[["conv", "n", "done", "running"]]

    return folded(events, ["conv"], "conv bigint, n bigint, done boolean, running boolean", "there boolean, running boolean, own bigint", ["at", "n"], step)


def notifications(rows: DataFrame) -> DataFrame:
    """A change notice per row, without the content: key, routing channel and a JSON payload of ids, has_content and length; none of MOST_BYTES or more."""
    payload = F.to_json(F.struct("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("has_content"), F.length(F.coalesce("text", F.lit(""))).alias("content_length")))
    out = rows.select("conv_id", "turn", F.concat(F.lit("conversation:"), F.col("conv_id").cast("string")).alias("channel"), payload.alias("payload"))
    return out.filter(F.octet_length("payload") < MOST_BYTES)


def live(rows: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Rows whose time to live hasn't run out at as_of."""
    return rows.filter(F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)) > F.lit(as_of).cast("timestamp_ntz"))
