"""Tasks of plans: the index by id, evidence, artifacts, promotion, the discovery gate and the planner's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import state, text

from .keyed import top_per_group


def task_index(tasks: DataFrame) -> DataFrame:
    """(plan_id, k, pos): each job id and task id with the last task that has it; task ids repeat within a level."""
    keys = tasks.select("plan_id", "pos", F.explode(F.array("job_id", "id")).alias("k")).filter("k is not null")
    return keys.groupBy("plan_id", "k").agg(F.max("pos").alias("pos"))


def valid_job_id(x: Column) -> Column:
    return x.isNotNull() & (x != "") & ~text.trim(x).isin("N/A", "undefined", "null", "")


def allowed_tasks(evidence: DataFrame, tasks: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """evidence (plan_id, discovery, cited) -> plan_id, discovery, pos of the tasks that it may draw on.

    own (plan_id, discovery, job_id): a discovery's own job, which counts as cited where its evidence cites none that is valid, or where it has no evidence.
    A cited id that is none brings in all tasks not cited yet; a discovery left without a task draws on all. tasks is read several times.
    """
    key = ["plan_id", "discovery"]
    cited = evidence.select(*key, "cited").withColumn("ok", valid_job_id(F.col("cited")))
    every = cited.groupBy(*key).agg(F.bool_or("ok").alias("some"), F.bool_or(~F.col("ok")).alias("bad"))
    if own is not None:
        every = every.join(own, key, "full").select(*key, "some", "bad", F.when(~F.coalesce("some", F.lit(False)) & (F.col("job_id") != ""), F.col("job_id")).alias("own"))
        cited = cited.unionByName(every.filter("own is not null").select(*key, F.col("own").alias("cited"), valid_job_id(F.col("own")).alias("ok")))
        every = every.withColumn("bad", F.coalesce("bad", F.lit(False)) | (F.col("own").isNotNull() & ~valid_job_id(F.col("own"))))
    found = cited.filter("ok").join(task_index(tasks).withColumnRenamed("k", "cited"), ["plan_id", "cited"]).select(*key, "pos")
    some = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    open_ones = every.join(some, key, "left").filter("bad or n is null")
    # what is taken already goes by its job id, or else its id
    taken = found.join(tasks.select("plan_id", "pos", F.coalesce("job_id", "id").alias("k")), ["plan_id", "pos"]).select(*key, "k")
    rest = open_ones.select(*key).join(tasks.select("plan_id", "pos", F.array_compact(F.array("job_id", "id")).alias("ks")), "plan_id")
    known = rest.select(*key, "pos", F.explode("ks").alias("k")).join(taken, [*key, "k"], "left_semi").select(*key, "pos")
    return found.unionByName(rest.select(*key, "pos").join(known, [*key, "pos"], "left_anti"))


def evidence_tasks(allowed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(plan_id, k, pos): the task behind each job id and each id of the allowed tasks; a task may come under both."""
    keys = allowed.join(tasks.select("plan_id", "pos", "job_id", "id"), ["plan_id", "pos"]).select("plan_id", F.explode(F.array_compact(F.array("job_id", "id"))).alias("k")).distinct()
    return keys.join(task_index(tasks), ["plan_id", "k"])


def with_artifacts(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """tasks with their artifacts in order; an empty array without any."""
    rest = [c for c in artifacts.columns if c not in ("task_key", "art_no", "art_id")]
    listed = artifacts.groupBy("task_key").agg(F.array_sort(F.collect_list(F.struct("art_no", "art_id", *rest))).alias("artifacts"))
    empty = F.array().cast(listed.schema["artifacts"].dataType)
    return tasks.join(listed, "task_key", "left").withColumn("artifacts", F.coalesce("artifacts", empty))


def repaired_paths(said: DataFrame, known: DataFrame) -> DataFrame:
    """said (plan_id, name, path, ...): the path of the plan's artifact of that name, or else of its own path's last part.

    known (plan_id, pos, art_no, name, path): artifacts of all tasks of a plan. A name, and then the last part of its path, is the key of an artifact, and the
    last one in the order of tasks and artifacts has it, whichever of both it is. Where that one has no path, the key finds nothing.
    """
    last = text.basename(F.col("path"))
    keys = F.array_compact(F.array(F.when(F.col("name") != "", F.struct(F.lit(0).alias("kind"), F.col("name").alias("key"))), F.when(last != "", F.struct(F.lit(1).alias("kind"), last.alias("key")))))
    placed = known.select("plan_id", "path", "pos", "art_no", F.explode(keys).alias("k"))
    index = placed.groupBy("plan_id", F.col("k.key").alias("key")).agg(F.max_by("path", F.struct("pos", "art_no", "k.kind")).alias("good")).filter("good <> ''")
    named, ended = index.select("plan_id", F.col("key").alias("name"), F.col("good").alias("by_name")), index.select("plan_id", F.col("key").alias("last"), F.col("good").alias("by_path"))
    return said.withColumn("last", last).join(named, ["plan_id", "name"], "left").join(ended, ["plan_id", "last"], "left").withColumn("path", F.coalesce("by_name", "by_path", "path")).drop("by_name", "by_path", "last")


def promoted(plan: DataFrame, suggested: DataFrame) -> DataFrame:
    """The plan and the suggested tasks on its next level, under new ids and without an output; an empty plan's highest level is -1."""
    top = plan.groupBy("plan_id").agg(F.max(F.coalesce("level", F.lit(0))).alias("top"))
    level = F.coalesce("top", F.lit(-1)) + 1
    new = suggested.join(top, "plan_id", "left").select("plan_id", F.concat(F.when(F.col("type") == "ANALYSIS", "ana-").otherwise("lit-"), level.cast("string")).alias("id"), level.alias("level"), F.lit(None).cast("string").alias("output"))
    return plan.select("plan_id", "id", "level", "output").unionByName(new)


def discovery_gate(messages: DataFrame, tasks: DataFrame, new_tasks: DataFrame, enough: int = 3) -> DataFrame:
    """messages (plan_id, n) -> plan_id, runs, tasks: whether discovery runs, and on how many tasks with an output; on all at the first run, then on new ones."""
    told = lambda t: t.filter(F.col("output").rlike(r"\S")).groupBy("plan_id").agg(F.count(F.lit(1)).alias("k"))
    counted = messages.join(told(tasks).withColumnRenamed("k", "of_all"), "plan_id", "left").join(told(new_tasks).withColumnRenamed("k", "of_new"), "plan_id", "left")
    n = F.when(F.col("n") < enough, F.lit(0)).otherwise(F.coalesce(F.when(F.col("n") == enough, F.col("of_all")).otherwise(F.col("of_new")), F.lit(0)))
    return counted.select("plan_id", (n > 0).alias("runs"), n.alias("tasks"))


def context(tasks: DataFrame, artifacts: DataFrame, messages: DataFrame) -> DataFrame:
    """plan_id, context: the sections of a planner's prompt in order; a section without content is left out."""
    ordered = lambda cond, *columns: F.array_sort(F.collect_list(F.when(cond, F.struct("pos", *columns))))
    plans = tasks.groupBy("plan_id").agg(
        F.max("level").alias("level"), F.max_by("objective", "pos").alias("objective"), ordered(F.col("output").rlike(r"\S"), "output").alias("insights"), ordered(~F.col("ended"), "type", "objective").alias("next")
    )
    done = with_artifacts(tasks.filter("type = 'ANALYSIS' and ended"), artifacts).select("plan_id", "pos", "id", F.explode("artifacts").alias("a"))
    line = F.concat(F.lit("  - "), F.coalesce("a.name", F.lit("undefined")), F.lit(" (id: "), "a.art_id", F.lit(") [from "), "id", F.lit("]: "), "a.type")
    made = done.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", "a.art_no", "a.art_id", F.coalesce("a.name", F.lit("")).alias("name"), "a.type", line.alias("line")))).alias("made"))
    short = F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(F.col("content"))
    said = F.concat_ws("\n", F.when(F.col("question") != "", F.concat(F.lit("User: "), "question")), F.when(F.col("content") != "", F.concat(F.lit("Assistant: "), short)))
    recent = top_per_group(messages.withColumn("said", said).select("plan_id", "turn", "said"), "plan_id", [F.desc("turn")], 4).filter("place > 1")
    history = recent.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("h"))
    whole = plans.join(made, "plan_id", "left").join(history, "plan_id", "left")
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), F.array_join(items, "\n")))
    return whole.select(
        "plan_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Current Iteration: "), (F.col("level") + 1).cast("string")),
            F.when(F.size("h") > 0, F.concat(F.lit("Recent Conversation History (last "), F.size("h").cast("string"), F.lit(" exchanges):\n"), F.array_join(F.transform("h", lambda x: x["said"]), "\n\n"))),
            F.concat(F.lit("Current Objective (the current goal of the research, updated after each research iteration): "), "objective"),
            section("Key Insights:", state.numbered(F.transform("insights", lambda x: x["output"]))),
            section("Available Artifacts (from completed analysis tasks):", F.transform("made", lambda x: x["line"])),
            section("Suggested Next Steps (from previous iteration):", state.numbered(F.transform("next", lambda x: F.concat(F.lit("["), x["type"], F.lit("] "), x["objective"])))),
        ).alias("context"),
    )
