"""Plans, discoveries and answers as column expressions: lenient JSON, XML, progress and context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .references import is_json
from .text import let

TASK = "type string, objective string, level int, output string"
PLANNING = f"currentObjective string, plan array<struct<{TASK}>>"
QUOTED = r'"([^"\\]*(?:\\.[^"\\]*)*)"'


def unescaped(x: Column) -> Column:
    return F.replace(x, F.lit('\\"'), F.lit('"'))


def whole_task(t: Column, i: Column) -> Column:
    """A task with the defaults of what is missing: literature, no objective, its place from 1 as level, no output."""
    blank = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.struct(
        blank(t["type"], "LITERATURE").alias("type"), F.coalesce(t["objective"], F.lit("")).alias("objective"),
        F.coalesce(t["level"], i + 1).alias("level"), F.coalesce(t["output"], F.lit("")).alias("output"),
    )


def no_tasks() -> Column:
    return F.array().cast(f"array<struct<{TASK}>>")


def planning(x: Column, fallback: Column) -> Column:
    """struct(method, objective, plan) of an answer, by the first way that works.

    direct: the whole is JSON; code_block: the first fenced block is; json_match: from the first brace to the last, if that has a plan or an
    objective; regex: an objective or tasks are found as quoted fields; default: the fallback objective as a task, or nothing.
    """
    result = lambda method, o, plan: F.struct(F.lit(method).alias("method"), o.alias("objective"), plan.alias("plan"))
    objective = unescaped(F.regexp_extract(x, r'"currentObjective"\s*:\s*' + QUOTED, 1))
    field = r'(?s)"type"\s*:\s*"(LITERATURE|ANALYSIS)".*?"objective"\s*:\s*' + QUOTED
    kinds, aims = (F.regexp_extract_all(x, F.lit(field), F.lit(i)) for i in (1, 2))
    found = F.transform(
        F.zip_with(kinds, aims, lambda k, o: F.struct(k.alias("type"), unescaped(o).alias("objective"), F.lit(None).cast("int").alias("level"), F.lit("").alias("output"))), whole_task
    )
    usual = F.struct(F.lit("LITERATURE").alias("type"), fallback.alias("objective"), F.lit(1).alias("level"), F.lit("").alias("output"))
    default = result("default", F.coalesce(fallback, F.lit("Continue research based on user query")), F.when(fallback.isNotNull(), F.array(usual)).otherwise(no_tasks()))
    fields = let(F.struct(objective.alias("o"), found.alias("t")), lambda r: F.when((F.size(r["t"]) > 0) | (r["o"] != ""), result("regex", r["o"], r["t"])))

    def way(method: str, part: Column, meant=None) -> Column:
        """The result of a part, null if it isn't JSON or not meant."""
        tasks = lambda p: result(method, F.coalesce(p["currentObjective"], F.lit("")), F.coalesce(F.transform(p["plan"], whole_task), no_tasks()))
        parsed = lambda t: let(F.from_json(t, PLANNING), lambda p: tasks(p) if meant is None else F.when(meant(p), tasks(p)))
        return let(part, lambda t: F.when(is_json(t), parsed(t)))

    planned = lambda p: p["plan"].isNotNull() | (F.coalesce(p["currentObjective"], F.lit("")) != "")
    block, braces = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.coalesce(way("direct", x), way("code_block", block), way("json_match", braces, planned), fields, default)


def largest_planning(x: Column) -> Column:
    """What stands from the first brace to the last, if it is JSON with a plan or an objective."""
    return let(F.regexp_extract(x, r"(?s)(\{.*\})", 1), lambda t: F.when(is_json(t), let(F.from_json(t, PLANNING), lambda p: F.when(p["plan"].isNotNull() | (F.coalesce(p["currentObjective"], F.lit("")) != ""), t))))


def nested_objects(x: Column) -> Column:
    """All that stands between a brace and the one that closes it, within others too, in the order of their ends; braces in quotes within an object don't count.

    One pass over the braces and quotes, with the places of the open ones as a stack.
    """
    tokens = F.regexp_extract_all(x, F.lit(r'(?s)[^{}"\\]+|\\.|["{}]|\\'), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("open"), F.lit(False).alias("quoted"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        to, depth = s["at"] + F.length(t), F.size(s["open"])
        closes = ~s["quoted"] & (t == "}") & (depth > 0)
        opened = F.when(~s["quoted"] & (t == "{"), F.array_append(s["open"], s["at"])).when(closes, F.slice(s["open"], F.lit(1), depth - 1)).otherwise(s["open"])
        span = F.struct(F.try_element_at(s["open"], depth).alias("a"), to.alias("b"))
        return F.struct(to.alias("at"), opened.alias("open"), F.when((t == '"') & (depth > 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), F.when(closes, F.array_append(s["found"], span)).otherwise(s["found"]).alias("found"))

    return F.transform(F.aggregate(tokens, start, step, lambda s: s["found"]), lambda f: F.substring(x, f["a"], f["b"] - f["a"]))


def unfenced(x: Column) -> Column:
    """x without its first ```json and the ``` at its end."""
    return text.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)\A(.*?)```json\n?", "$1"), r"\n?```\z", ""))


def fenced_object(x: Column) -> Column:
    return F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)


def reply_json(x: Column) -> Column:
    """The JSON of a model's reply: without fences, or its first fenced object; null if neither parses."""
    return F.coalesce(*(let(part, lambda t: F.when(is_json(t), t)) for part in (unfenced(x), fenced_object(x))))


def discovered(x: Column, existing: Column) -> Column:
    """Titles of a reply's discoveries; of the existing ones where the reply doesn't parse; none where it has no list of them."""
    items = lambda found: F.try_variant_get(F.try_parse_json(found), "$.discoveries", "array<variant>")
    titles = lambda found: F.transform(items(found), lambda v: F.try_variant_get(v, "$.title", "string"))
    return let(reply_json(x), lambda found: F.when(found.isNull(), existing).otherwise(F.coalesce(titles(found), F.array().cast("array<string>"))))


def reflection(x: Column, stored: Column) -> Column:
    """struct(objective, insights) of a reply; those stored where it doesn't parse; insights that are no list count as none."""
    kept = F.struct(F.coalesce(stored["objective"], F.lit("")).alias("objective"), F.coalesce(stored["insights"], F.array().cast("array<string>")).alias("insights"))

    def parsed(value: Column) -> Column:
        insights = F.coalesce(F.try_variant_get(value, "$.keyInsights", "array<string>"), F.array().cast("array<string>"))
        return F.struct(F.try_variant_get(value, "$.currentObjective", "string").alias("objective"), insights.alias("insights"))

    return let(reply_json(x), lambda found: F.when(found.isNull(), kept).otherwise(let(F.try_parse_json(found), parsed)))


# Categories and priorities of a clarifying question.
CATEGORIES = ["ambiguity", "data_requirements", "scope_constraints", "methodology", "output"]
PRIORITIES = ["high", "medium", "low"]
QUESTION = "category string, question string, priority string"


def question_list(x: Column) -> Column:
    """Questions of a reply, its first fenced block or the whole; none if that doesn't parse."""
    none = F.array().cast(f"array<struct<{QUESTION}>>")
    listed = lambda part: F.when(is_json(part), F.from_json(part, f"questions array<struct<{QUESTION}>>")["questions"])
    block = lambda whole: text.trim(F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)```", 1))
    part = let(text.trim(x), lambda whole: let(block(whole), lambda b: F.when(b != "", b).otherwise(whole)))
    return F.coalesce(let(part, listed), none)


def valid_questions(questions: Column) -> Column:
    good = lambda q: q["category"].isin(CATEGORIES) & q["priority"].isin(PRIORITIES) & (F.coalesce(q["question"], F.lit("")) != "")
    return F.filter(questions, lambda q: F.coalesce(good(q), F.lit(False)))


def message_or_raw(x: Column) -> Column:
    """The `message` of a JSON reply (null if it has none), without fences; the raw text if it isn't JSON."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?s)\A(.*?)```json\n?", "$1"), r"\n?```\z", "")
    return F.when(is_json(bare), F.try_variant_get(F.try_parse_json(bare), "$.message", "string")).otherwise(x)


# Tags whose value is a list, and XML entities in the order they are decoded.
LIST_TAGS = ["actions", "providers", "evaluators"]
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]


def xml_values(x: Column) -> Column:
    """Map of tag -> values in the block `<response>`, or else in the first block; null without a tag that closes itself.

    The values of actions, providers and evaluators are split at commas, `simple` is true or false; any other has one value. A later tag wins.
    """
    block = F.regexp_extract(x, r"(?s)<response>(.*?)</response>", 1)
    inner = F.when(x.rlike(r"(?s)<response>.*?</response>"), block).otherwise(F.regexp_extract(x, r"(?s)<(\w+)>(.*?)</\1>", 2))
    tag = r"(?s)<([\w-]+)>(.*?)</([\w-]+)>"
    opened, value, closed = (F.regexp_extract_all(inner, F.lit(tag), F.lit(i)) for i in (1, 2, 3))

    def decoded(v: Column) -> Column:
        for name, character in XML_ENTITIES:
            v = F.replace(v, F.lit(name), F.lit(character))
        return text.trim(v)

    def values(k: Column, v: Column) -> Column:
        listed = F.when(v == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(v, ","), lambda w: text.trim(w)))
        return F.when(k.isin(LIST_TAGS), listed).when(k == "simple", F.array((F.lower(v) == "true").cast("string"))).otherwise(F.array(v))

    closes = F.filter(F.arrays_zip(opened.alias("k"), value.alias("v"), closed.alias("c")), lambda p: p["k"] == p["c"])
    pairs = F.transform(closes, lambda p: F.struct(p["k"].alias("k"), values(p["k"], decoded(p["v"])).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(pairs) > 0, F.map_from_entries(last))


def kept_steps(steps: Column, least: int = 5, most: int = 15) -> Column:
    """Steps, cleaned, of 3 to 8 words and at most 80 characters, each once whatever its case; null unless there are `least` to `most`."""
    fits = lambda x: F.size(F.split(x, r"\s+")).between(3, 8) & (F.length(x) <= 80)
    # in the order of their lower case the first of each stands first: no step is compared with all others
    placed = lambda clean: F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = lambda p: F.filter(p, lambda e, k: (k == 0) | (F.get(p, k - 1)["low"] != e["low"]))
    in_order = lambda p: F.transform(F.array_sort(F.transform(firsts(p), lambda e: F.struct(e["i"], e["x"].alias("x")))), lambda e: e["x"])
    once = let(F.filter(F.transform(steps, text.step), fits), lambda clean: let(placed(clean), in_order))
    return let(once, lambda o: F.when(F.size(o).between(least, most), o))


def visible_count(steps: Column, visible: Column) -> Column:
    return F.least(F.size(steps), F.greatest(F.coalesce(visible, F.lit(1)), F.lit(1)))


def is_stale(running: Column, heartbeat: Column, expires: Column, now: Column, hours: int = 4) -> Column:
    """A running run is stale from its expiry on, more than `hours` after its heartbeat, or if it has neither."""
    late = (F.coalesce(now >= expires, F.lit(False))) | F.coalesce(now > heartbeat + F.make_dt_interval(hours=F.lit(hours)), F.lit(False))
    return F.coalesce(running, F.lit(False)) & (late | (heartbeat.isNull() & expires.isNull()))


def prompt_entry(name: Column, description: Column, content: Column, most: int = 2000) -> Column:
    """A data set in a prompt: line ends in its name and description as spaces, its text cut and without fences of its own."""
    line = lambda x: F.regexp_replace(x, r"[\r\n]", " ")
    safe = F.regexp_replace(F.substring(content, 1, most), "`{3,}", "` ` `")
    body = F.concat(F.lit("\n```\n"), safe, F.when(F.length(content) > most, "\n...").otherwise(""), F.lit("\n```"))
    some = lambda x, y: F.when(F.coalesce(x, F.lit("")) != "", y).otherwise("")
    return F.concat(F.lit("### "), line(name), some(description, F.concat(F.lit("\n"), line(description))), some(content, body))


def numbered(items: Column, start: str = "  ") -> Column:
    return F.transform(items, lambda x, i: F.concat(F.lit(start), (i + 1).cast("string"), F.lit(". "), x))


def xelatex_preamble(tex: Column) -> Column:
    """A LaTeX file for XeLaTeX: fontspec for inputenc, no fontenc and lmodern, and fonts and the figures' folder before the document."""
    # What is put in where the file doesn't name it.
    fonts = r"\IfFontExistsTF{Linux Libertine O}{\setmainfont{Linux Libertine O}\setsansfont{Linux Biolinum O}}{\setmainfont{Linux Libertine}}"
    figures = r"\graphicspath{{figures/}}"
    begin = r"\begin{document}"
    out = F.replace(tex, F.lit(r"\usepackage[utf8]{inputenc}"), F.lit(r"\usepackage{fontspec}"))
    out = F.regexp_replace(F.regexp_replace(out, r"\\usepackage\[T1\]\{fontenc\}\n?", ""), r"\\usepackage\{lmodern\}\n?", "")
    added = F.concat_ws("\n", F.when(~out.contains(r"\setmainfont"), fonts), F.when(~out.contains(r"\graphicspath"), figures))
    at = F.locate(begin, out)
    return F.when((at == 0) | (added == ""), out).otherwise(F.concat(F.substring(out, F.lit(1), at - 1), added, F.lit("\n\n"), F.substring(out, at, F.length(out))))


def front_matter(x: Column) -> tuple[Column, Column]:
    """(map of a file's leading `key: value` block between lines of ---, the trimmed text after it); an empty map without such a block."""
    head = F.when(x.startswith("---"), F.regexp_extract(x, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 0)).otherwise("")
    inner = lambda h: F.regexp_extract(h, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    value = lambda w: F.regexp_replace(text.trim(F.regexp_extract(w, r"^[^:]*:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    pairs = lambda h: F.transform(F.filter(F.split(inner(h), r"\r?\n"), lambda w: w.rlike(r"^[\w-]+\s*:")), lambda w: F.struct(text.trim(F.split(w, ":", 2)[0]).alias("k"), value(w).alias("v")))
    last = lambda p: F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda other: other["k"] == e["k"]))
    return let(head, lambda h: F.map_from_entries(let(pairs(h), last))), let(head, lambda h: text.trim(F.substring(x, F.length(h) + 1, F.length(x))))
