"""Language ID by bit-sliced Bloom filters of n-grams.

One table of SLOTS language bitmasks serves all languages: an n-gram sets its languages' bits in three slots, and the AND of
its three slots gives all languages that contain it. Per language the bits over a text's n-grams are counted and corrected for
the false positives expected from that language's share of set bits; the largest corrected count decides.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free_name, held_out, prepare

#: n-gram length in characters, slots of the table.
N, SLOTS = 4, 1 << 20
#: The filters are fitted on about so many labelled rows of each language, chosen by hash of doc_id (all, if fewer).
FIT_ROWS = 2_000
#: Labels that are learned at most, a bound on what is broadcast: the masks take 8 MB for each 64. More are refused, none is left out.
MOST_LANGUAGES = 1_024
#: An n-gram belongs to a language if it is in this share of its fitted rows, and in two rows, at least.
SHARE = 0.01
#: Characters taken at a time; blocks overlap by N - 1, so the n-grams are those of the whole text.
BLOCK = 1 << 18


@cache
def letters() -> np.ndarray:
    """Code point -> itself for letters (category L), space for others."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    codes = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], dtype=np.uint32)
    table[codes] = codes
    return table


def gram_blocks(text: str):
    """64-bit hashes of the character n-grams of a text in lower case, others than letters as spaces; by blocks."""
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if len(codes) < N:
        codes = np.concatenate([codes, np.full(N - len(codes), 32, dtype=np.uint32)])
    for at in range(0, len(codes) - N + 1, BLOCK):
        c = codes[at : at + BLOCK + N - 1].astype(np.uint64)
        h = np.zeros(len(c) - N + 1, dtype=np.uint64)
        for i in range(N):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - N + 1 + i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        yield h


def slots_of(h: np.ndarray):
    for shift in (0, 20, 40):
        yield ((h >> np.uint64(shift)) & np.uint64(SLOTS - 1)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Filters:
    """languages, masks (SLOTS x words of 64 languages), false-positive rate of each language."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        self.masks = np.zeros((-(-len(languages) // 64) or 1, SLOTS), dtype=np.uint64)
        for i, h in enumerate(grams):
            for s in slots_of(h):
                self.masks[i // 64][s] |= np.uint64(1 << i % 64)
        self.rates = [float(np.count_nonzero(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS) ** 3 for i in range(len(languages))]

    def counts(self, text: str) -> np.ndarray:
        """Corrected number of the text's n-grams in each language."""
        hits, n = np.zeros(len(self.languages)), 0
        for h in gram_blocks(text):
            n += len(h)
            places = list(slots_of(h))
            for word, row in enumerate(self.masks):
                m = row[places[0]] & row[places[1]] & row[places[2]]
                for i in range(64 * word, min(len(self.languages), 64 * word + 64)):
                    hits[i] += np.count_nonzero(m & np.uint64(1 << i % 64))
        rates = np.array(self.rates)
        return np.maximum(hits - n * rates, 0) / (1 - np.minimum(rates, 0.999))

    def decide(self, text: str | None) -> tuple[str, float]:
        """und for null, no letter or nothing learned. No n-gram known: the first language, score 0. Ties: the first."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        c = self.counts(text)
        best = int(c.argmax())
        return self.languages[best], float(c[best] / c.sum()) if c.sum() > 0 else 0.0


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, most_languages: int = MOST_LANGUAGES) -> Filters:
    """labelled (doc_id, text, lang): rows with a null text or lang teach nothing. Languages are in order of falling rows, then name.
    Over most_languages labels raise a ValueError before a table is made: labels that no one has cleaned are not languages.

    Each language is sampled on its own, so a rare one is learned beside any number of other rows. What reaches the driver is bounded by the
    sample: the n-grams that are in SHARE of a language's fitted rows, at most 1 / SHARE times the mean number of n-grams of a row.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    steps = 1 << 40
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(totals) > most_languages:
        raise ValueError(f"over {most_languages} labels in lang; clean them, or raise most_languages (8 MB of masks for each 64)")
    if any(n > fit_rows for n in totals.values()):
        bounds = [(lang, max(1, steps * fit_rows // n)) for lang, n in totals.items()]
        table = F.broadcast(spark.createDataFrame(bounds, "lang string, bound bigint"))
        rows = rows.join(table, "lang").filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(steps)) < F.col("bound")).select("doc_id", "text", "lang")

    def run(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if has_letter(text):
                    by.setdefault(lang, []).append(np.unique(np.concatenate(list(gram_blocks(text)))))
            for lang, seen in by.items():
                h, c = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.array([len(seen)] + [0] * (len(h) - 1), pa.int64())],
                    ["lang", "gram", "n", "rows"],
                )

    counted = rows.mapInArrow(run, "lang string, gram bigint, n bigint, rows bigint").persist()
    sizes = counted.groupBy("lang").agg(F.sum("rows").alias("size"))
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).join(F.broadcast(sizes), "lang")  # a row per language
    least = F.when(F.col("size") > 2, F.greatest(F.lit(2.0), SHARE * F.col("size"))).otherwise(1.0)
    kept = grams.filter(F.col("n") >= least).select("lang", "gram").toArrow()
    languages = sorted((r["lang"] for r in sizes.collect()), key=lambda x: (-totals[x], x))
    counted.unpersist()
    number = {lang: i for i, lang in enumerate(languages)}
    of = np.array([number[x] for x in kept["lang"].to_pylist()], dtype=np.int64)
    gram = kept["gram"].to_numpy().astype(np.int64).view(np.uint64)
    return Filters(languages, [gram[of == i] for i in range(len(languages))])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score (share of the best language in all corrected counts). Rows are independent, repeated ones alike.

    Columns stay; where docs has columns of these names, the new ones, which come last, get an underscore more. An empty table gives none.
    The table that is broadcast is SLOTS x 8 bytes for each 64 languages, whatever the corpus; fit bounds their number.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(filters)
    names = [free_name(x, docs.columns) for x in ("lang_pred", "score")]

    def run(batches):
        for b in batches:
            found = [model.value.decide(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*b.schema.names, *names],
            )

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) with held_out, lang_pred and score; learned from rows that aren't held out."""
    filters = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return predict(docs, filters).withColumn(free_name("held_out", docs.columns), held_out())


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
