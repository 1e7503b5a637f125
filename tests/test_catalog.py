"""Every catalogue query against its SQL, and worked examples of the functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import money, references, state, text
from tessera.operators import keyed, records, retrieval
from tessera.plans import registry
from tessera.sources import readers
from tessera.streaming import limits

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, con, name):
    got = registry.queries()[name](spark, D)
    columns = sorted(got.columns)
    ours = sorted(str(tuple(map(plain, r))) for r in got.select(columns).collect())
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracles()[name]})").fetchall()
    assert ours == sorted(str(tuple(map(plain, r))) for r in sql)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_worked_examples(spark):
    assert one(spark, money.base_units(F.lit("0.01"))) == "10000"
    assert one(spark, money.base_units(F.lit("1.2345678"))) == "1234567"
    assert one(spark, money.base_units(F.lit("0"))) == "0"
    assert [one(spark, money.file_size(F.lit(n))) for n in (0, 1024, 1536)] == ["0 Bytes", "1.00 KB", "1.50 KB"]
    assert one(spark, text.citekey(F.lit("1abc.def"))) == "Xabc_def"
    assert one(spark, text.upload_filename(F.lit("a-b/c.txt"))) == "a_b/c.txt"
    assert one(spark, text.html_text(F.lit("<p>a&amp;lt;b</p>"))) == "a<b"
    assert one(spark, text.domain_name(F.lit("https://www.bbc.co.uk/x"))) == "bbc"
    assert one(spark, text.domain_name(F.lit("https://www.nature.com/"))) == "nature"
    assert one(spark, text.url_kind(F.lit("https://doi.org/10.1234/ABC_d."))[1]) == "10.1234/abc_d"
    assert one(spark, text.url_kind(F.lit("https://doi.org/10.1/x"))[0]) == "url"
    assert one(spark, text.normal_url(F.lit("https://a.b/c/?z=1&a=2#f"))) == "https://a.b/c?a=2&z=1"
    units = money.cost_units(F.lit("gemini-2.5-pro"), F.lit(200001).cast("bigint"), F.lit(0).cast("bigint"))
    assert one(spark, units) == 50000250


def test_chunks():
    assert retrieval.chunk_bounds("x" * 2000) == [(0, 2000)]
    assert retrieval.chunk_bounds("a" * 2001) == [(0, 2000), (2000, 2001)]
    assert retrieval.chunk_bounds("a" * 2000 + " b") == [(0, 2001), (2001, 2002)]


def test_collision_suffix(spark):
    rows = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "i int, key string")
    assert [r["key"] for r in keyed.collision_suffix(rows, "key", ["i"]).orderBy("i").collect()] == ["k", "k_2", "k_3"]


def test_documents_functions(spark):
    cited = one(spark, references.citations(F.lit("[a]{u1, u2} [b]{} [c]{u1}")))
    assert [(c["index"], c["cited"], c["urls"]) for c in cited] == [(1, "a", ["u1", "u2"]), (2, "c", ["u1"])]
    assert one(spark, references.without_citations(F.lit("[]{u1} [b]{}"))) == " b"
    assert one(spark, references.without_citations(F.lit("[a]{u1, u2} [b]{} [c]{u1}"))) == "a b c"
    assert one(spark, references.lenient_json(F.lit('x ```json\n{"a": 1}\n``` {'))[0]) == "braces"  # a fence counts at the beginning only
    assert one(spark, references.lenient_json(F.lit('```json\n{"a": 1}\n```'))[0]) == "json_fence"
    assert one(spark, references.lenient_json(F.lit("{broken"))[0]) == "none"
    assert one(spark, references.parser_of(F.lit("a.PDF"), F.lit("text/csv"))) == "csv"
    assert one(spark, references.parser_of(F.lit("a.bin"), F.lit(None).cast("string"))) is None
    assert one(spark, references.known_citations(F.lit("x [@q] y"), F.array(F.lit("k")))) == "x  y"
    assert one(spark, references.summary(F.lit("# A\n## Summary\nshort\n## B\nz"))) == "short"
    assert one(spark, references.last_lines(F.lit("a\nb"), 5)) == "a\nb"
    assert one(spark, references.escaped_fields(F.lit("@x{k_1,\n  title = {a_b\\_c},\n  url = {a_b}\n}"))) == "@x{k_1,\n  title = {a\\_b\\_c},\n  url = {a_b}\n}"


def test_surveyed_lists(spark):
    """Values that the lists of the survey give, each of which an altered list would miss."""
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    parser = lambda name, mime: one(spark, references.parser_of(F.lit(name), F.lit(mime)))
    assert parser("a.docx", docx) == "excel" and parser("a.gif", "image/gif") is None and parser("a.PNG", "text/csv") == "image" and parser("a.md", "") == "markdown"
    assert [one(spark, references.stage_percent(F.lit(x))) for x in ("validating", "upload", "cleanup", "x")] == [5, 95, 100, 0]
    assert one(spark, references.mime_of(F.lit("a.XLSX"))).endswith("sheet") and one(spark, references.mime_of(F.lit("a.png"))) == "application/octet-stream"
    assert one(spark, text.url_kind(F.lit("https://x.org/f.eot"))[0]) is None and one(spark, text.url_kind(F.lit("https://CDN.x.org/a"))[0]) is None
    assert one(spark, text.url_kind(F.lit("https://fonts.googleapis.com/x"))[0]) is None
    assert [one(spark, text.step(F.lit(x))) for x in ("3 mice", "-* 2] go  on.;", "  a, ")] == ["mice", "go on", "a,"]
    assert [one(spark, text.fork_title(F.lit(x))) for x in (" a ", " [Deep Research] a ")] == ["[Deep Research] a", "[Deep Research] a"]
    assert [one(spark, references.stripped_citations(F.lit(x))) for x in ("a \n", "a \n#### citations\n1")] == ["a \n", "a"]
    assert one(spark, state.message_or_raw(F.lit('```json\n{"message": "m"}\n```'))) == "m" and one(spark, state.message_or_raw(F.lit("raw"))) == "raw"
    assert one(spark, text.simple_hash(F.lit("abc"))) == "%08x" % 96354 and one(spark, text.wallet_uuid(F.lit("0xAB")))[14] == "5"
    assert one(spark, text.replaced_first(F.lit("a {x} b {x}"), "{x}", F.lit("1$$2$&3$`4$'5"))) == "a 1$2{x}3a 4 b {x}5 b {x}"
    assert one(spark, text.decoded_entities(F.lit("&amp;#38; &#8364; &ndash;"))) == "\\\\& € –"


def test_json_ways(spark):
    plan = lambda x, fallback=None: one(spark, state.planning(F.lit(x), F.lit(fallback).cast("string")))
    assert plan('{"plan": [{"objective": "o"}]}').plan[0].asDict() == {"type": "LITERATURE", "objective": "o", "level": 1, "output": ""}
    assert plan('x ```\n{"currentObjective": "c"}\n```').method == "code_block" and plan('so {"plan": []} ok').method == "json_match"
    broken = plan('{"currentObjective": "a \\"b\\"", "plan": [{"type": "ANALYSIS", "objective": "x"}, {')
    assert (broken.method, broken.objective, [(t.type, t.level) for t in broken.plan]) == ("regex", 'a "b"', [("ANALYSIS", 1)])
    assert plan("no", "f").plan[0].objective == "f" and plan("no").objective == "Continue research based on user query" and plan("no").plan == []
    xml = one(spark, state.xml_values(F.lit("<a><b>x</b></a> <response><actions>p, q</actions><t>&lt;&amp;lt;</t><u>1</v></response>")))
    assert xml == {"actions": ["p", "q"], "t": ["<&lt;"]} and one(spark, state.xml_values(F.lit("none"))) is None


def test_streams_equal_batches(spark, tmp_path):
    """The rate limit and the leases over several micro-batches give what one batch gives, and what a plain loop gives."""
    from tessera.plans.catalog import requests
    from tessera.plans.records import lease_events

    asked = requests(spark, D).filter("user_id < 20").withColumn("action", F.lit("a"))
    loop, windows = {}, {}
    for r in sorted(asked.collect(), key=lambda r: (r["epoch"], r["event_id"])):
        window = [e for e in windows.get(r["user_id"], []) if e > r["epoch"] - 86400]
        loop[r["event_id"]] = len(window) < 2
        windows[r["user_id"]] = [*window, r["epoch"]] if len(window) < 2 else [e for e in window if e != r["epoch"]]
    assert {r["event_id"]: r["admitted"] for r in limits.admitted(asked, 2, 86400).collect()} == loop and not all(loop.values())
    leases = lease_events(spark, D).withColumn("root", F.col("root").cast("bigint"))
    for name, rows, order, run, want in (
        ("limit", asked.select("user_id", "action", "epoch", "event_id"), "epoch", lambda s: limits.admitted_stream(s, 2, 86400), {(i, ok) for i, ok in loop.items()}),
        ("lease", leases, "at", limits.leases_stream, {(r["n"], r["done"], r["running"]) for r in records.lease_events(leases).collect()}),
    ):
        middle = rows.agg(F.percentile_approx(F.col(order).cast("double") if order == "epoch" else F.unix_micros(F.col(order).cast("timestamp")), 0.5)).first()[0]
        value = F.col(order).cast("double") if order == "epoch" else F.unix_micros(F.col(order).cast("timestamp"))
        for part, cond in enumerate((value <= middle, value > middle)):
            rows.filter(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-c").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/{name}-out")
        got = {(r["event_id"], r["admitted"]) for r in out.collect()} if name == "limit" else {(r["n"], r["done"], r["running"]) for r in out.collect()}
        assert got == want


def test_readers(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("---\ntitle: 'T'\ntype: note\n---\n body \n")
    (tmp_path / "d" / "sub" / "b.md").write_text("plain")
    (tmp_path / "d" / "c.bin").write_text("no")
    found = readers.scanned(spark, str(tmp_path / "d"), "*.md").withColumn("raw", F.decode("content", "utf-8"))
    rows = readers.with_front_matter(found, F.create_map(F.lit("type"), F.lit("md"))).select("content", "metadata").collect()
    assert sorted((r["content"], sorted(r["metadata"].items())) for r in rows) == [("body", [("title", "T"), ("type", "note")]), ("plain", [("type", "md")])]
    (tmp_path / "x.csv").write_text('a,b\n1,"x, y"\n\n2,\n')
    assert [r["line"] for r in readers.csv_lines(readers.strict_csv(spark, str(tmp_path / "x.csv"))).collect()] == ["a, b", "1, x, y", "2, "]
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.strict_csv(spark, str(tmp_path / "bad.csv")).collect()
    assert one(spark, readers.indented_json(F.lit('{"b": [1], "a": "x\\"y"}'))) is not None and one(spark, readers.json_kind(F.lit("nope"))) is None


def test_one_row_or_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert records.expect_one(rows.filter("k = 1"), ["k"]).collect()[0]["v"] == "a"
    with pytest.raises(Exception, match="more than one row"):
        records.expect_one(rows, ["k"]).collect()


def test_prefix_groups_by_brute_force(spark):
    said = [(c, t, x) for c in range(3) for t, x in enumerate(["ab", "b", "abc", "abcd" if c else "", "a", "abd", "b", "c", "abdx"])]
    want = {(c, t) for c, t, x in said for c2, t2, y in said if c == c2 and t2 < t and (x.startswith(y) or (x and y.startswith(x)))}
    got = [(r["conv_id"], r["turn"]) for r in keyed.repeated_by_prefix(spark.createDataFrame(said, "conv_id long, turn long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_spans_and_maps(spark):
    s, p = "0123456789" * 8, lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.array(p(20, 40), p(70, 70), p(-3, 4), p(5, 9), p(60, 50), p(1_000_000_000, 1_000_000_009), p(79, 80))
    left = s[:70] + s[71:]
    left = left[:20] + left[41:]
    assert one(spark, references.without_spans(F.lit(s), spans)) == left[:5] + left[10:]
    mark = lambda end, *i: F.struct(F.lit(end).alias("end"), F.array(*map(F.lit, i)).cast("array<int>").alias("indices"))
    assert one(spark, references.with_marks(F.lit("abcdefgh"), F.array(mark(2, 0, 2), mark(6, 1), mark(4), mark(99, 4)))) == "ab[1], [3]cdef[2]gh[5]"
    found = lambda x, pattern: [tuple(r) for r in one(spark, references.matches(F.lit(x), pattern))]
    assert found("xx-é😀-xxx", "x+") == [(0, 1), (6, 8)]
    assert found("abc", "x+") == [] and found("", "x+") == [] and found("xx", "x") == [(0, 0), (1, 1)]
    assert found("a(b)c(d)", r"\((\w)\)") == [(1, 3), (5, 7)]
    assert one(spark, references.matches(F.lit(None).cast("string"), "x")) is None
    stored, new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit(None).cast("string"))
    assert one(spark, references.merged(stored, new)) == {"a": "1", "b": "3", "c": None}
    assert one(spark, records.preserved(stored, new, "b")) == {"b": "2", "c": None}
    assert one(spark, records.preserved(F.lit(None).cast("map<string,string>"), new, "b")) == {"b": "3", "c": None}
