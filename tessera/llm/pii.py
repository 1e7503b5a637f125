"""PII: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame and SQL functions. A pattern's matches and the text between them (regexp_extract_all and split on the
same pattern) give the offsets in code points by running sums, so no Python sees a text. The sums are taken over blocks of BLOCK
matches and then over the blocks, so a match costs at most a copy of a block. The patterns start at a run's
first character and use possessive runs: the leftmost, non-overlapping matches are those of the plain patterns, in time
linear in the text even for one very long word. Context is looked for in what lies between a match and its neighbours of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> pattern. A match of `email` can begin inside a run only where the match before ended, hence \G.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests that a text can hold a match at all.
HINTS = {"email": "@", "phone": "+"}
BASE = ("email", "ip", "card", "phone")
#: Words that raise the score of a span of that kind when they stand within CONTEXT characters before or after it.
WORDS = {
    "email": "mail|contact|write",
    "ip": "address|host|server|ip",
    "card": "card|visa|credit|payment",
    "phone": "call|phone|tel|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security",
}
CONTEXT = 40
#: Matches of a block of running sums.
BLOCK = 256
#: Score of a confirmed span, what a context word adds, and the score from which an added (not base) span counts.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
RAISE, ENOUGH = 0.3, 0.5


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of digits passes Luhn: every second digit from the right doubled, digit sums mod 10."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """True where an IBAN's rearranged number is 1 modulo 97; letters count 10 to 35."""
    plain = F.regexp_replace(match, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + (c - 48)) % 97).otherwise((rest * 100 + (c - 55)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The check of a kind on a proposed match."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        n = digits(match)
        return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(pairs: Column) -> Column:
    """Array of (gap, length) -> where each match starts: the sums of all gaps up to its own and all lengths before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, p: F.struct((acc["at"] + p["gap"] + p["length"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + p["gap"])).alias("starts"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), zero, step))
    ahead = lambda found: F.aggregate(found, zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
    whole = lambda found: F.flatten(F.zip_with(found, ahead(found), lambda b, before: F.transform(b["starts"], lambda x: x + before)))
    return F.when(F.size(pairs) == 0, F.array().cast("array<int>")).otherwise(let(blocks, whole))


def trimmed_iban(match: Column) -> Column:
    """The longest beginning of a match, by words, that is an IBAN of 15 to 34 characters; null if none is. Capital words behind one are no part of it."""
    words = F.split(match, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.try_element_at(F.filter(heads, lambda h: F.length(F.replace(h, F.lit(" "), F.lit(""))).between(15, 34) & mod97(h)), F.lit(-1))


def spans_of(kind: str, text: Column) -> Column:
    """Array of struct(start, kind_no, kind, end, match, score) of a kind's confirmed spans, by start."""
    pattern = PATTERNS[kind]
    kind_no = list(PATTERNS).index(kind)
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,match:string,score:double>>")

    def entry(match: Column, gap: Column, after: Column) -> Column:
        near = F.lower(F.concat(F.right(gap, F.lit(CONTEXT)), F.lit(" "), F.substring(after, 1, CONTEXT)))
        return F.struct(match.alias("match"), near.alias("near"), F.length(gap).alias("gap"), F.length(match).alias("length"))

    def entries(both: Column) -> Column:
        matches, gaps = both["matches"], both["gaps"]
        n = F.size(matches)
        beside = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("a"))
        return F.transform(beside, lambda x: entry(x["m"], x["g"], x["a"]))

    def scored(m: Column, start: Column) -> Column:
        match = trimmed_iban(m["match"]) if kind == "iban" else m["match"]
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(m["near"].rlike(WORDS[kind]), RAISE).otherwise(0.0))
        return let(match, lambda x: F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (start + F.length(x)).alias("end"), x.alias("match"), score.alias("score")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    found = let(let(both, entries), lambda e: F.zip_with(e, running(e), scored))
    good = lambda m: m["match"].isNotNull() & confirmed(kind, m["match"])
    found = F.filter(found, good if kind in BASE else lambda m: good(m) & (m["score"] >= ENOUGH))
    possible = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(pattern)
    return F.when(possible, found).otherwise(empty)


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with `spans`: array of struct(start, kind_no, kind, end, match, score), ordered by start, then kind.

    Offsets are code points of the text, end exclusive. A null or empty text has no spans. Base kinds (email, ip, card,
    phone) are kept whatever their score; added kinds (IBAN by mod 97; SSN-like numbers) need a score of ENOUGH, which
    an SSN-like number reaches only by a context word. Rows are independent: repeated rows, extra columns stay; where docs has a column
    `spans`, the new one, which comes last, gets an underscore more. An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(free_name("spans", docs.columns), F.array_sort(F.concat(*[spans_of(k, text) for k in PATTERNS])))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", F.col("spans").alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
