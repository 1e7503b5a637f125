"""Notices and change feeds: on batches and on streams the same plan, and keyed folds as Structured Streaming with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

# Kinds of notices.
KINDS = [
    "job:started", "job:progress", "job:completed", "job:failed", "message:updated", "state:updated", "file:ready", "file:error", "paper:started",
    "paper:progress", "paper:completed", "paper:failed",
]
#: Bytes that a notice may take.
MOST_BYTES = 8000


def notices(rows: DataFrame) -> DataFrame:
    """rows (event_id, type, conversation) as messages: channel by conversation, JSON message; unknown kinds, and messages of MOST_BYTES or more, go."""
    known = rows.filter(F.col("type").isin(KINDS))
    out = known.select("event_id", F.concat(F.lit("conversation:"), F.col("conversation").cast("string")).alias("channel"), F.to_json(F.struct("type", F.col("conversation").cast("string").alias("conversationId"))).alias("message"))
    return out.filter(F.octet_length("message") < MOST_BYTES)


def routed(messages: DataFrame, pattern: str = "conversation:%") -> DataFrame:
    """Messages of the channels that a subscriber's pattern fits: the conversation of the channel, the kind in the message."""
    return messages.filter(F.col("channel").like(pattern)).select("event_id", "channel", F.get_json_object("message", "$.type").alias("type"), F.split_part("channel", F.lit(":"), F.lit(2)).alias("conversation"))


def changes(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `change`: INSERT for the first row of a key, UPDATE for any later one."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("change", F.when(n == 1, "INSERT").otherwise("UPDATE"))


def folded(stream: DataFrame, keys: list[str], schema: str, state_schema: str, order: list[str], step: Callable) -> DataFrame:
    """A stream folded by key: step(state or None, rows sorted by `order`) -> (state, rows out). State stays from micro-batch to micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        new, out = step(state.get if state.exists else None, rows)
        state.update(new)
        yield out

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
