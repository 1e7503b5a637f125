"""Writes of records as pure functions of tables: inserts, migrations, state documents, sessions, payments; one row or none; leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with the new rows behind it; columns that a new row doesn't give are null."""
    return existing.unionByName(new, allowMissingColumns=True)


def expect_one(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key; a key with several rows is an error, one without any has no row."""
    several = F.count(F.lit(1)) > 1
    row = F.when(several, F.raise_error(F.lit("more than one row"))).otherwise(F.first(F.struct(*[c for c in rows.columns if c not in key])))
    return rows.groupBy(*key).agg(row.alias("r")).select(*key, "r.*")


def deleted(rows: DataFrame, referring: DataFrame, key: str, stamp: str, as_of: str, days: int) -> DataFrame:
    """Rows that nothing refers to and that are older than `days` at as_of."""
    old = F.col(stamp) < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return rows.filter(old).join(referring.select(key), key, "left_anti")


def migrated(users: DataFrame, moves: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """moves (user_id, new_id): users under their new id, the old row gone, unless the new id exists already; children re-keyed."""
    to = users.join(moves, "user_id", "left")
    kept = to.filter("new_id is null").drop("new_id")
    taken = kept.select(F.col("user_id").alias("new_id"))
    new = to.filter("new_id is not null").join(taken, "new_id", "left_anti").withColumn("user_id", F.col("new_id")).drop("new_id")
    moved = children.join(moves, "user_id", "left").withColumn("user_id", F.coalesce("new_id", "user_id")).drop("new_id")
    return inserted(kept, new.select(kept.columns)), moved


def preserved(stored: Column, new: Column, field: str) -> Column:
    """A state document (map of JSON texts): the new one, but for the stored value of `field` where there is one."""
    old = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: k == field)
    return F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)), old)


def with_feedback(feedback: Column, entry: Column, approved: Column, plan: Column, regenerated: Column) -> tuple[Column, Column, Column]:
    """(feedback, status, plan) after one more feedback: the plan counts as approved or as generated anew, and a regenerated plan takes its place."""
    return F.array_append(F.coalesce(feedback, F.array().cast("array<string>")), entry), F.when(approved, "plan_approved").otherwise("plan_generated"), F.coalesce(regenerated, plan)


# What is done to a session and the status it has then; a link changes none.
TRANSITIONS = [("submit", "answers_submitted"), ("set_plan", "plan_generated"), ("approve", "plan_approved"), ("abandon", "abandoned")]


def session_status(actions: DataFrame) -> DataFrame:
    """actions (session, at, action) -> session, status after the last action that sets one; `questions_generated` before any."""
    status = F.coalesce(*[F.when(F.col("action") == a, s) for a, s in TRANSITIONS])
    last = F.max_by(status, F.when(status.isNotNull(), F.col("at")))
    return actions.groupBy("session").agg(F.coalesce(last, F.lit("questions_generated")).alias("status"))


def lease_events(events: DataFrame) -> DataFrame:
    """events (conv, at, n, kind: start, touch or finish, root) with `done`: whether the event had an effect, and `running` after it.

    A start opens a run with its root. A touch works on a running run, a finish on any; both only where their root, if given, is the run's.
    Events of a conversation count in order of (at, n). An event before the first start has no effect.
    """
    key = Window.partitionBy("conv").orderBy("at", "n")
    run = events.withColumn("run", F.sum((F.col("kind") == "start").cast("int")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("conv", "run").orderBy("at", "n")
    opened = run.withColumn("of", F.first("root").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("run") > 0) & (F.col("root").isNull() | F.coalesce(F.col("root") == F.col("of"), F.lit(False)))
    ends = opened.withColumn("ends", ((F.col("kind") == "finish") & fits).cast("int"))
    over = ends.withColumn("over", F.coalesce(F.sum("ends").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    done = F.when(F.col("kind") == "start", True).when(F.col("kind") == "touch", fits & ~F.col("over")).otherwise(fits)
    return over.select("conv", "at", "n", "kind", done.alias("done"), ((F.col("run") > 0) & ~F.col("over") & (F.col("ends") == 0)).alias("running"))
