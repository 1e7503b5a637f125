"""Readers of files: folders, Markdown with front matter, strict CSV, JSON; and messages with the pages that they name."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import state, text


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a local one only where that is unset and the session is one local process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """rows written to a folder of their own and read from there, so that what reads them several times works them out once."""
    folder = scratch(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def scanned(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below a folder, subfolders included, whose name fits the pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def with_front_matter(files: DataFrame, metadata: Column) -> DataFrame:
    """files (raw, ...) with `content` and `metadata`, a map of strings; the file's own front matter wins over what is given."""
    own, body = state.front_matter(F.col("raw"))
    own_keys = F.map_keys(own)
    merged = F.map_concat(F.map_filter(metadata, lambda k, v: ~F.array_contains(own_keys, k)), own)
    return files.withColumns({"metadata": merged, "content": body}).drop("raw")


def strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text; empty lines are skipped, a line that doesn't fit the header fails the read."""
    header = spark.read.option("header", True).csv(path).schema
    return spark.read.schema(header).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """line: the header, and each row with its cells joined by a comma and a space; an empty cell stays empty."""
    line = F.concat_ws(", ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns])
    return rows.sparkSession.createDataFrame([(", ".join(rows.columns),)], "line string").unionByName(rows.select(line.alias("line")))


def json_kind(x: Column) -> Column:
    """array, object, string, number or boolean; null for what is no JSON. JSON's null is an object."""
    kind = F.schema_of_variant(F.try_parse_json(x))
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT") | (kind == "VOID"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.isNotNull(), "number")
    )


#: Steps that a running sum takes at a time.
BLOCK = 128


def running_sums(x: Column) -> Column:
    """For each number of an array the sum up to it. Sums go by blocks of BLOCK, so that a long array isn't copied for each of its numbers."""
    def up_to(part: Column, start: Column) -> Column:
        begun = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begun, lambda a, v: F.struct((a["s"] + v).alias("s"), F.array_append(a["out"], a["s"] + v).alias("out")), lambda a: a["out"])

    zero = F.lit(0).cast("int")
    total = lambda part: F.aggregate(part, zero, lambda a, v: a + v)
    parts = F.when(F.size(x) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK)), lambda i: F.slice(x, i + 1, F.lit(BLOCK))))
    sums = lambda p: F.zip_with(p, F.concat(F.array(zero), up_to(F.transform(p, total), zero)), lambda part, before: F.when(part.isNotNull(), up_to(part, before)))
    return text.let(parts, lambda p: F.flatten(F.array_compact(sums(p))))


def indented_json(x: Column) -> Column:
    """JSON over lines, two spaces a level, whatever its nesting, with the members in their order; null for what is no JSON.

    Strings and numbers stay as they are written. A key that stands twice in an object stays twice.
    """
    tokens = F.regexp_extract_all(x, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'), F.lit(0))
    step = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def written(t: Column, depth: Column, before: Column, after: Column) -> Column:
        opened, closed = t.isin("{", "["), t.isin("}", "]")
        return (
            F.when(opened & ~F.coalesce(after.isin("}", "]"), F.lit(False)), F.concat(t, line(depth))).when(closed & ~F.coalesce(before.isin("{", "["), F.lit(False)), F.concat(line(depth), t))
            .when(t == ",", F.concat(t, line(depth))).when(t == ":", F.lit(": ")).otherwise(t)
        )

    def laid_out(ts: Column) -> Column:
        placed = lambda depths: F.transform(ts, lambda t, i: written(t, F.get(depths, i), F.get(ts, i - 1), F.get(ts, i + 1)))
        return F.array_join(text.let(running_sums(F.transform(ts, step)), placed), "")

    return F.when(F.try_parse_json(x).isNotNull(), text.let(tokens, laid_out))


def enriched(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, text), the last of each conversation, with `added`: what the pages say whose addresses it names.

    pages (url, content), a row per address; or (conv_id, url, content), a row per conversation and address, where an address may have been read
    several times and each conversation has what was read for it. An address without content is said to be unreadable. Messages without an address are left out.
    """
    key = ["conv_id", "url"] if "conv_id" in pages.columns else ["url"]
    urls = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))
    named = messages.select("conv_id", "turn", F.posexplode(urls).alias("pos", "url")).join(pages.filter(F.col("content").rlike(r"\S")), key, "left")
    read = F.concat(F.lit("Here is the content of the page "), "url", F.lit(" that the user referenced. If it is related to the question, feel free to integrate it in the answer:\n\n"), "content")
    unread = F.concat(F.lit("Content of the page "), "url", F.lit(" wasn't able to be read, but I can search the internet for other results."))
    parts = named.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(read, unread).alias("part")))).alias("parts"))
    return parts.select("conv_id", "turn", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n").alias("added"))
