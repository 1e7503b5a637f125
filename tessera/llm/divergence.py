"""Audit of how sources of a language differ in their words, by in-mapper stripes.

A task folds whole documents into hash stripes: per language and term the document frequency and the count of each source. A full table spills
its stripes and starts anew; they meet by (language, term), a source's shares are summed, and a merged stripe holds all counts of its term.
Stripes of terms in fewer than MIN_DOCS documents end there. What is left gives each group's total and each language's vocabulary.

A merged stripe emits the divergence of its sources from the language (part `term`) and adds what its own sources owe to each pair of them
(part `pair`). A source without the term has the same smoothed share p0 for all such terms, so a pair's sum over all terms is

    sum over terms of both [f(p_s, p_t) - f(p_s, p0_t) - f(p0_s, p_t) + f(p0_s, p0_t)]
    + sum over terms of s f(p_s, p0_t) + sum over terms of t f(p0_s, p_t) + (V - terms of s - terms of t) f(p0_s, p0_t)

and no stripe is ever widened to sources that it lacks. The first line is folded in tiles of TILE x TILE sources in the tasks, the second comes
from each source's histogram of shares.
"""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, prepare, saved, text_bytes

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries (term, group) of a task's stripes before they spill; bytes of a text that are split into terms at a time.
SPILL, PIECE = 400_000, 1 << 20
#: Sources of a tile each way; tiles that a task holds (each 512 KB) before they spill.
TILE, TILES = 256, 128
#: Letters, in lower case, and the bytes of all characters above 127; anything else separates terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(text: bytes):
    """Lists of terms of a text, cut between terms at about PIECE bytes."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = (text.rfind(b" ", at, end) + 1) or (text.find(b" ", end) + 1) or len(text)
        yield text[at:end].split()
        at = end


def folded(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) -> shares of stripes: lang, source, term, df, n. The term '' stands for the group itself, with zeros."""
    prepare(docs.sparkSession)

    def spilled(stripes: dict) -> pa.RecordBatch:
        groups, terms, df, n = [], [b""] * len(stripes), [0] * len(stripes), [0] * len(stripes)
        groups += stripes
        for group, (in_docs, counts) in stripes.items():
            groups += [group] * len(counts)
            terms += counts
            n += counts.values()
            df += [in_docs[t] for t in counts]
        lang, source = zip(*groups)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()), pa.array(source, pa.binary()), pa.array(terms, pa.binary()), pa.array(df, pa.int64()), pa.array(n, pa.int64())], ["lang", "source", "term", "df", "n"])

    def fold(batches):
        stripes: dict = {}
        about = 0
        for b in batches:
            for group, text in zip(zip(text_bytes(b.column(0)), text_bytes(b.column(1))), text_bytes(b.column(2))):
                in_docs, counts = stripes.setdefault(group, (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in pieces(text):
                    counts.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                about += 1 + len(seen)
                if about > SPILL:
                    about = len(stripes) + sum(len(c) for _, c in stripes.values())
                    if about > SPILL // 2:
                        yield spilled(stripes)
                        stripes, about = {}, 0
        if stripes:
            yield spilled(stripes)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(fold, "lang binary, source binary, term binary, df bigint, n bigint").select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "df", "n")


def merged(shares: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Shares -> stripes: lang, term, total, counts (array of source, n), with a stripe '' of all the language's sources. One shuffle, by (lang, term)."""
    summed = shares.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    stripes = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return stripes.filter((F.col("df") >= min_docs) | (F.col("term") == "")).drop("df")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exactly; null if total and v are 0."""
    wide = lambda x: x.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(Decimal(SCALE)) * wide(count + 1), F.nullif(wide(total) + wide(v), F.lit(0).cast("decimal(21,0)")))
    return 1 + whole


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """distance of each p from each q."""
    return (p[:, None] - q) ** 2 // q


def paired(stripes: DataFrame) -> DataFrame:
    """stripes (lang, s, p, p0: arrays, by s) -> lang, s, t, value: what the terms of both s and t add to their pair."""

    def emitted(tiles: dict):
        for (lang, x, y), tile in tiles.items():
            s, t = np.nonzero(tile)
            s, t, v = s + x * TILE, t + y * TILE, tile[s, t]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.int64()), pa.array(t, pa.int64()), pa.array(v, pa.int64())], ["lang", "s", "t", "value"])

    def run(batches):
        tiles: dict = {}
        for b in batches:
            cuts = b.column(1).offsets.to_numpy()
            s, p, p0 = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
            cuts = cuts - cuts[0]
            for lang, at, end in zip(b.column(0).to_pylist(), cuts, cuts[1:]):
                ends = [*(np.flatnonzero(np.diff(s[at:end] // TILE)) + 1 + at), end]
                ranges = list(zip([at, *ends], ends))
                for i, j in ranges:
                    for k, m in ranges:
                        key = (lang, int(s[i] // TILE), int(s[k] // TILE))
                        if key not in tiles:
                            if len(tiles) >= TILES:
                                yield from emitted(tiles)
                                tiles = {}
                            tiles[key] = np.zeros((TILE, TILE), dtype=np.int64)
                        a, a0, c, c0 = p[i:j], p0[i:j], p[k:m], p0[k:m]
                        tiles[key][np.ix_(s[i:j] % TILE, s[k:m] % TILE)] += gain(a, c) - gain(a, c0) - gain(a0, c) + gain(a0, c0)
        yield from emitted(tiles)

    return stripes.mapInArrow(run, "lang string, s bigint, t bigint, value bigint").filter("s <> t")


def divergences(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text, ...) -> lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by divergence from it. Part `term`: the TOP terms that the source has more of than its
    language. Null lang, source and text count as ''; repeated rows and ids count each. A group without terms has its pairs; a language
    without kept terms has pairs of value 0 and no terms. Ties go to the item that is smaller in UTF-8. An empty table gives none.
    """
    stripes = saved(merged(folded(docs)))
    entries = stripes.select("lang", "term", "total", F.inline("counts"))
    by_lang = stripes.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"), F.sum("total").alias("lang_total"))
    sources = entries.groupBy("lang", "source").agg(F.sum("n").alias("source_total"), F.count_if(F.col("n") > 0).alias("terms"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("s")
    p0 = share(F.lit(0), F.col("source_total"), F.col("v")).alias("p0")
    groups = saved(sources.join(by_lang, "lang").select("*", number, p0))
    known = saved(entries.filter("term <> ''").join(groups, ["lang", "source"]).select("lang", "source", "s", "term", share(F.col("n"), F.col("source_total"), F.col("v")).alias("p"), "p0", share(F.col("total"), F.col("lang_total"), F.col("v")).alias("q")))

    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= TOP)

    lists = known.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "p", "p0"))).alias("x")).filter(F.size("x") > 1)
    both = paired(lists.select("lang", *(F.col(f"x.{c}").alias(c) for c in ("s", "p", "p0"))))
    other = groups.select("lang", F.col("s").alias("t"), F.col("p0").alias("q0"), F.col("terms").alias("other_terms"))
    alone = known.groupBy("lang", "s", "p").count().join(other, "lang").filter("s <> t").groupBy("lang", "s", "t").agg(
        F.sum((F.col("count") * distance(F.col("p"), F.col("q0"))).cast("decimal(38,0)")).alias("there"), F.sum((F.col("count") * distance(F.col("q0"), F.col("p"))).cast("decimal(38,0)")).alias("back")
    )
    alone = alone.select("lang", F.inline(F.array(F.struct("s", "t", F.col("there").alias("value")), F.struct(F.col("t").alias("s"), F.col("s").alias("t"), F.col("back").alias("value")))))
    neither = groups.join(other, "lang").filter("s <> t").select("lang", "s", "t", ((F.col("v") - F.col("terms") - F.col("other_terms")).cast("decimal(19,0)") * distance(F.col("p0"), F.col("q0"))).cast("decimal(38,0)").alias("value"))
    wide = both.select("lang", "s", "t", F.col("value").cast("decimal(38,0)").alias("value"))
    sums = wide.unionByName(alone).unionByName(neither).groupBy("lang", "s", "t").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("bigint").alias("value"))
    named = groups.select("lang", "s", "source")
    pairs = sums.join(named, ["lang", "s"]).join(named.select("lang", F.col("s").alias("t"), F.col("source").alias("item")), ["lang", "t"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(over))
    result = saved(pairs.unionByName(terms))
    discard(docs.sparkSession, stripes, groups, known)
    return result


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = e.lang AND c.source = e.source) AS tot FROM (SELECT DISTINCT lang, source FROM d) e),
l AS (SELECT lang, count(*) AS v, sum(total) AS tot FROM k GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.tot + l.v) AS p,
             1 + ({SCALE}::HUGEINT * (k.total + 1)) // (l.tot + l.v) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
