"""Keyed writes as pure functions of tables, keep-first dedup, numbering and windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.readers import kept


def upsert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing, and the new rows whose key it doesn't hold."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))


def update_by_key(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes other than the key replace those of the row with that key; a null change is a change."""
    columns = [c for c in changes.columns if c != key]
    marked = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(marked, key, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("s")).select(key, "s.*")


def collision_suffix(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The second and further uses of a key get _2, _3, ..."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit("_"), n.cast("string"))).otherwise(F.col(key)))


def top_per_group(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= cap)


def offered_load(requests: DataFrame, seconds: int, *key: str) -> DataFrame:
    """requests with the number of requests of their key in the last `seconds` whole seconds, their own included."""
    w = Window.partitionBy(*key).orderBy("epoch").rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))


def prepend_dataset(old: Column, new: Column) -> Column:
    """New first, replacing one of the same filename; unchanged if its id is there."""
    return F.when(F.exists(old, lambda x: x["id"] == new["id"]), old).otherwise(F.concat(F.array(new), F.filter(old, lambda x: x["filename"] != new["filename"])))


def append_dataset(old: Column, new: Column) -> Column:
    """New last, replacing one of the same filename."""
    return F.concat(F.filter(old, lambda x: x["filename"] != new["filename"]), F.array(new))


def without_dataset(old: Column, ident: Column) -> Column:
    return F.filter(old, lambda x: x["id"] != ident)


# Keys of a state that a fork takes with it.
FORKED_KEYS = [
    "objective", "discoveries", "plan", "keyInsights", "methodology", "hypothesis", "currentHypothesis", "datasets", "uploadedDatasets", "clarificationContext",
    "researchMode",
]


def forked_state(values: Column) -> Column:
    return F.map_filter(values, lambda k, v: k.isin(FORKED_KEYS))


def forked(messages: DataFrame, key: str, shift: int) -> DataFrame:
    """Copies of messages under a new key, with the old one as parent_id, without a state, and with `ui` where the source is missing."""
    return messages.withColumns({"parent_id": F.col(key), key: F.col(key) + shift, "source": F.coalesce("source", F.lit("ui")), "state_id": F.lit(None).cast("bigint")})


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place` from 1 in a global order: range partitions are numbered within, and get the number of rows before them.

    The ranges are written once, as their cuts come from a sample: another run of the same plan may cut, or join small ranges, elsewhere.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return within.join(F.broadcast(before), "__part").withColumn("place", F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")


def batched(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with `batch`: the number from 0 of their batch of `size` rows in a global order."""
    return placed(rows, [order]).withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("place")


def repeated_by_prefix(answers: DataFrame) -> DataFrame:
    """answers (conv_id, turn, text) -> conv_id and turn of those to which an earlier one of their conversation is equal, a beginning or a continuation.

    An empty one begins all, but nothing continues it. In the order of texts the beginnings of a text lie on a stack, and its continuations follow it at
    once, so one pass over a conversation in that order decides without comparing its answers with each other; only the stack is in memory.
    """
    rows = answers.select("conv_id", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "text", "turn")

    def run(batches):
        conv, stack, out = None, [], []  # of a text: itself, its turn, the least turn of its beginnings and of its continuations

        def pop():
            text, turn, above, below = stack.pop()
            if above < turn or (text and below < turn):
                out.append((conv, turn))
            if stack:
                stack[-1][3] = min(stack[-1][3], below, turn)

        for b in batches:
            for c, text, turn in zip(*(b.column(i).to_pylist() for i in range(3))):
                while stack and (c != conv or not text.startswith(stack[-1][0])):
                    pop()
                conv = c
                above = min(stack[-1][1], stack[-1][2]) if stack else float("inf")
                stack.append([text, turn, above, float("inf")])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["conv_id", "turn"])
            out.clear()
        while stack:
            pop()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["conv_id", "turn"])

    return rows.mapInArrow(run, "conv_id bigint, turn bigint")
