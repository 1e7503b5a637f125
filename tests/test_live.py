"""Streams that end what is silent, over several micro-batches, against plain loops; functions of SQL; loads and writes that reach storage."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.plans import live
from tessera.plans.records import lease_events
from tessera.sources.bindings import owners, token_usage
from tessera.streaming import expiry

D = "/root/testdata/sf0.001"


def in_parts(rows, folder, parts=3):
    """rows (at, ...) written as files by time, one for each micro-batch."""
    ms = expiry.millis(F.col("at"))
    cuts = rows.agg(F.percentile_approx(ms, F.array(*(F.lit(k / parts) for k in range(1, parts))))).first()[0]
    for k, (lo, hi) in enumerate(zip([-1, *cuts], [*cuts, 1 << 60])):
        rows.filter((ms > lo) & (ms <= hi)).coalesce(1).write.parquet(f"{folder}/part={k}")
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_stale_runs(spark, tmp_path):
    events = lease_events(spark, D).withColumn("root", F.col("root").cast("bigint"))
    found, state = expiry.run_through(spark, expiry.stale_runs_stream(in_parts(events, f"{tmp_path}/in")), f"{tmp_path}/out")
    got = sorted((r["conv"], r["stale_ms"], str(r["root"])) for r in found.collect())
    rows, want, run = events.withColumn("ms", expiry.millis(F.col("at"))).collect(), [], {}
    for r in sorted(rows, key=lambda r: (r["at"], r["n"])):
        own = run.get(r["conv"])
        if own and r["ms"] >= own[1] + 14_400_000:
            want.append((r["conv"], own[1] + 14_400_000, str(own[0])))
            own = None
        if r["kind"] == "start":
            own = (r["root"], r["ms"])
        elif own and r["root"] in (None, own[0]):
            own = (own[0], r["ms"]) if r["kind"] == "touch" else None
        run[r["conv"]] = own
    end = max(r["ms"] for r in rows)
    want += [(c, own[1] + 14_400_000, str(own[0])) for c, own in run.items() if own and own[1] + 14_400_000 <= end]
    assert got == sorted(want) and len(got) > 50
    assert sorted((r["conv"], r["stale_ms"], str(r["root"])) for r in expiry.stale_runs(events).collect()) == got
    assert state[-1] <= len({c for c, own in run.items() if own})  # what is left is alive


def test_swept_statuses(spark, tmp_path):
    rnd = random.Random(2)
    base = 1_700_000_000_000
    rows = [(rnd.randint(0, 4), f"f{rnd.randint(0, 2)}", base + rnd.randint(0, 40 * 60_000), n, rnd.choice(["pending", "ready"])) for n in range(150)]
    rows += [(9, "f", base, 200, "a"), (9, "f", base + 300_000, 201, "b"), (9, "f", base + 600_001, 202, "c"), (9, "g", base + 40 * 60_000, 203, "d")]  # at its end it lives, a millisecond later it doesn't
    table = spark.createDataFrame(rows, "conv long, file string, ms long, n long, status string").withColumn("at", F.timestamp_millis("ms").cast("timestamp_ntz"))
    found, state = expiry.run_through(spark, expiry.swept_stream(in_parts(table.drop("ms"), f"{tmp_path}/in", 4), 5), f"{tmp_path}/out")
    want, held, end = [], {}, max(r[2] for r in rows)
    for conv, file, ms, _, status in sorted(rows, key=lambda r: (r[2], r[3])):
        if (conv, file) in held and held[conv, file][1] < ms:
            want.append((conv, file, *held[conv, file]))
        held[conv, file] = (status, ms + 300_000)
    alive = {k for k, (_, ends) in held.items() if ends >= end}
    want += [(*k, *held[k]) for k in held if k not in alive]
    assert sorted(map(tuple, found.collect())) == sorted(want) and (9, "f", "b", base + 600_000) in want
    assert sorted(map(tuple, expiry.swept(table, 5).collect())) == sorted(want)
    assert state[-1] < max(state)


def test_functions_of_sql(spark):
    """The functions give what the columns give, are inlined, and let filters through to the scan."""
    from tessera.functions import money

    usage = token_usage(spark, D)
    sql.register(spark, usage, owners(spark, D, False), owners(spark, D, True))
    own = {r["id"]: r["u"] for r in usage.select("id", money.cost_units(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")).alias("u")).collect()}
    assert {r[0]: r[1] for r in spark.sql("SELECT id, token_cost_units(model, prompt_tokens, completion_tokens) FROM token_usage").collect()} == own
    prices = spark.sql("SELECT p.* FROM VALUES ('x', 'Claude-OPUS-4', 1), ('x', 'gemini-2.5-pro', 200000), ('x', 'gemini-2.5-pro', 200001), ('x', NULL, 1), (NULL, 'gpt-5', NULL) AS t(a, b, c), LATERAL get_model_pricing(a, b, c) p")
    assert sorted(map(lambda r: (float(r[0]), float(r[1])), prices.collect())) == [(1.0, 3.0), (1.25, 10.0), (1.75, 14.0), (2.5, 15.0), (5.0, 25.0)]
    assert [float(x) for x in spark.sql("SELECT * FROM get_model_pricing('google', 'gemini-2.5-pro')").first()] == [1.25, 10.0]
    plan = spark.sql("SELECT * FROM get_daily_cost_summary(14, TIMESTAMP_NTZ '2024-01-31 00:00:00')")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-17T00:00)" in plan and "Python" not in plan
    assert spark.sql("SELECT * FROM get_daily_cost_summary(30)").count() == 0  # nothing of the last days
    with pytest.raises(Exception, match="(?i)argument|parameter"):
        spark.sql("SELECT * FROM get_cost_by_model('a', 'b')").collect()
    assert live.call(spark, D, "SELECT * FROM get_cost_by_model('no such')").count() == 0


def test_batches_fail_alone_and_load_once(spark, tmp_path):
    """Planted bad rows fail their batch and no other, the report names them, and a second run over mended rows loads the rest once."""
    from tessera.sources import loading

    good = [(i, f"text {i}") for i in range(1050)]
    bad = [(i, None if i == 250 else "x" * 99 if i in (251, 777) else t) for i, t in good]
    check = loading.embeddable(50)
    first = {r["batch"]: r for r in loading.load(spark.createDataFrame(bad, "doc_id long, text string").repartition(5), "doc_id", str(tmp_path), check).collect()}
    assert {b for b, r in first.items() if r["status"] == "failed"} == {2, 7} and {r["status"] for r in first.values()} == {"failed", "loaded"}
    assert first[2]["error"] == "ValueError: row 50 of the batch: no text" and "99 characters" in first[7]["error"] and first[10]["n"] == 50 and sum(r["n"] for r in first.values()) == 1050
    table = spark.createDataFrame(good, "doc_id long, text string")
    assert loading.loaded(spark, str(tmp_path), table).count() == 850
    again = {r["batch"]: r["status"] for r in loading.load(table, "doc_id", str(tmp_path), check).collect()}
    assert {b for b, x in again.items() if x == "loaded"} == {2, 7} and set(again.values()) == {"loaded", "there"}
    assert sorted(map(tuple, loading.loaded(spark, str(tmp_path), table).collect())) == good
    assert loading.load(table.limit(0), "doc_id", f"{tmp_path}/none", check).count() == 0


def test_versions_rewrite_only_touched_files(spark, tmp_path):
    from tessera.sources import versions

    rows = spark.range(0, 1000, 1, 10).select(F.col("id"), F.col("id").cast("string").alias("v"))
    table = versions.Table(spark, str(tmp_path))
    assert table.create(rows) == 1
    _, before = table.files()
    changes = spark.createDataFrame([(5, "five"), (6, None), (905, "x"), (5000, "no such")], "id long, v string")
    assert table.update_by_key(changes, "id") == 2
    _, after = table.files()
    assert len(before) == 10 and len(set(before) & set(after)) == 8  # files without a key keep their names
    want = {i: str(i) for i in range(1000)} | {5: "five", 6: None, 905: "x"}
    assert {r["id"]: r["v"] for r in table.read().collect()} == want and table.read(1).filter("id = 5").first()["v"] == "5"
    assert table.update_by_key(spark.createDataFrame([(7777, "x")], "id long, v string"), "id") == 2  # nothing to do
    assert table.delete_by_key(spark.range(100, 200), "id") == 3 and len(table.files()[1]) == len(after) - 1
    assert table.upsert_ignore(spark.createDataFrame([(1, "old"), (150, "new")], "id long, v string"), "id") == 4
    want = {i: v for i, v in want.items() if not 100 <= i < 200} | {150: "new"}
    assert {r["id"]: r["v"] for r in table.read().collect()} == want
    schema, names = table.files()
    with pytest.raises(RuntimeError, match="meanwhile"):
        table._commit(4, schema, names)
    assert table.delete_by_key(table.read(), "id") == 5 and table.read().count() == 0 and table.insert(rows.limit(3)) == 6 and table.read().count() == 3


def test_prefix_price_without_nested_loop(spark):
    from tessera.operators import analytics

    routes = [(0, "/api/chat", 1.0), (1, "/api", 2.0), (2, "/api/chat/x", 3.0), (3, "/b", 4.0), (4, "/b", 5.0)]
    paths = ["/api/chat/x", "/api/chat/x", "/apis", "/", "", None, "/b", "/bc", "/ap"]
    rows = spark.createDataFrame([(i % 3, p) for i, p in enumerate(paths)], "k int, path string")
    priced = analytics.prefix_price(rows, "path", spark.createDataFrame(routes, "pos int, route string, price double"), 0.01)
    assert "NestedLoop" not in priced._jdf.queryExecution().toString() and "Cartesian" not in priced._jdf.queryExecution().toString()
    plain = lambda p: next((c for _, r, c in routes if p is not None and p.startswith(r)), 0.01)
    assert sorted(map(str, priced.select("k", "path", "price").collect())) == sorted(str(r) for r in spark.createDataFrame([(i % 3, p, plain(p)) for i, p in enumerate(paths)], "k int, path string, price double").collect())


def test_scans_take_new_files_only(spark, tmp_path):
    from tessera.streaming import scans

    folder, store = tmp_path / "in", str(tmp_path / "store")
    (folder / "a" / "b").mkdir(parents=True)
    (folder / "a" / "one.md").write_text("ä\n")
    (folder / "a" / "b" / "two.md").write_text("")
    (folder / "a" / "b" / "bad.md").write_bytes(b"\xff\xfe\x00x")
    (folder / "skip.bin").write_bytes(b"no")
    assert scans.scan_new(spark, str(folder), store, "*.md") == 2
    (folder / "c").mkdir()
    (folder / "c" / "three.md").write_text("new")
    assert scans.scan_new(spark, str(folder), store, "*.md") == 1 and scans.scan_new(spark, str(folder), store, "*.md") == 0
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["run"]) for r in scans.texts(spark, store).collect()}
    assert got == {"one.md": ("ä\n", 0), "three.md": ("new", 1)}
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in scans.rejects(spark, store).collect()] == [("bad.md", "not UTF-8")]


def test_json_of_any_nesting(spark):
    import json
    import time

    from tessera.functions import state
    from tessera.sources import readers

    rnd = random.Random(1)

    def value(depth):
        kind = rnd.randint(0, 6 if depth else 3)
        if kind > 4:
            return {rnd.choice(["a", "b\"", "ü{", "c,:", ""]) + str(i): value(depth - 1) for i in range(rnd.randint(0, 3))}
        if kind == 4:
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        return [None, True, rnd.randint(-9, 9) / 4, "x \\ \" [ ] { } , : \n é"][kind]

    whole = [value(5) for _ in range(150)] + [[], {}, [[]], [{}], "", 0, {"a": {"b": {"c": [1, [2, [3]]]}}}, list(range(500))]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(whole)] + [(-1, "{nope"), (-2, ""), (-3, None)], "i int, x string")
    got = {r["i"]: r["y"] for r in rows.select("i", readers.indented_json(F.col("x")).alias("y")).collect()}
    assert all(got[i] == json.dumps(v, indent=2, ensure_ascii=False) for i, v in enumerate(whole)) and got[-1] is got[-2] is got[-3] is None
    began = time.time()
    long = spark.createDataFrame([(json.dumps([{"k": i} for i in range(20_000)]),)], "x string").select(readers.indented_json(F.col("x")).alias("y")).first()["y"]
    assert long == json.dumps([{"k": i} for i in range(20_000)], indent=2) and time.time() - began < 60
    spans = lambda x: spark.range(1).select(state.nested_objects(F.lit(x)).alias("o")).first()["o"]
    assert spans('a {b {"c": "}{"} d} } { e') == ['{"c": "}{"}', '{b {"c": "}{"} d}'] and spans("none") == [] and spans('" {"x": "\\"}"}') == ['{"x": "\\"}"}']


def test_plans_by_worked_examples(spark):
    """A discovery's own job counts where it cites nothing valid; a later task's artifact of the same name wins over an earlier one's."""
    from tessera.operators import planning

    tasks = spark.createDataFrame([(1, 0, "lit-0", "j0"), (1, 1, "ana-0", "j1"), (1, 2, "lit-1", None)], "plan_id long, pos int, id string, job_id string")
    evidence = spark.createDataFrame([(1, 0, "j1"), (1, 1, "N/A"), (1, 2, None), (1, 3, "gone")], "plan_id long, discovery int, cited string")
    own = spark.createDataFrame([(1, 0, "j0"), (1, 1, "j0"), (1, 4, "j1"), (1, 5, "null"), (1, 6, None)], "plan_id long, discovery int, job_id string")
    got = {}
    for r in planning.allowed_tasks(evidence, tasks, own).collect():
        got.setdefault(r["discovery"], []).append(r["pos"])
    # 1 cites a placeholder, so it gets its own job and all the rest; 4 has no evidence but its own job
    assert {d: sorted(p) for d, p in got.items()} == {0: [1], 1: [0, 1, 2], 2: [0, 1, 2], 3: [0, 1, 2], 4: [1], 5: [0, 1, 2], 6: [0, 1, 2]}
    known = spark.createDataFrame([(1, 0, 1, "f.png", "runs/a/f.png"), (1, 1, 1, "f.png", "runs/b/g.png"), (1, 2, 1, "lost", None), (1, 0, 2, "lost", "runs/a/lost"), (2, 0, 1, "f.png", "other/f.png")], "plan_id long, pos int, art_no int, name string, path string")
    said = spark.createDataFrame([(1, "f.png", "x"), (1, None, "/home/g.png"), (1, "lost", "/home/f.png"), (1, "lost", "p"), (2, "f.png", None), (3, "f.png", "kept")], "plan_id long, name string, path string")
    assert sorted(map(str, planning.repaired_paths(said, known).select("plan_id", "name", "path").collect())) == sorted(
        str(r) for r in spark.createDataFrame([(1, "f.png", "runs/b/g.png"), (1, None, "runs/b/g.png"), (1, "lost", "runs/b/g.png"), (1, "lost", "p"), (2, "f.png", "other/f.png"), (3, "f.png", "kept")], "plan_id long, name string, path string").collect()
    )


def test_pages_of_one_address(spark):
    """An address that was read for two conversations gives each of them what was read for it."""
    from tessera.sources import readers

    asked = spark.createDataFrame([(1, 2, "see http://a.example/x!"), (2, 4, "http://a.example/x and http://b.example"), (3, 1, "http://a.example/x"), (4, 1, "none")], "conv_id long, turn int, text string")
    pages = spark.createDataFrame([(1, "http://a.example/x", "first"), (2, "http://a.example/x", "second"), (3, "http://a.example/x", " ")], "conv_id long, url string, content string")
    got = {r["conv_id"]: r["added"].split("\n\n---\n\n") for r in readers.enriched(asked, pages).collect()}
    assert {k: [x.split("\n\n")[-1] for x in v] for k, v in got.items() if k < 3} == {1: ["first"], 2: ["second", "Content of the page http://b.example wasn't able to be read, but I can search the internet for other results."]}
    assert set(got) == {1, 2, 3} and "http://a.example/x wasn't able" in got[3][0]


def test_places_of_wide_rows(spark):
    """Wide rows lie in more ranges than their keys alone would: each has its place, and none is lost."""
    from tessera.operators import keyed

    wide = F.concat(*[F.sha2(F.concat("id", F.lit(f" {k}")), 256) for k in range(40)])
    rows = spark.range(4000).repartition(7).select("id", wide.alias("text"))
    assert sorted((r["id"], r["place"]) for r in keyed.placed(rows, ["id"]).select("id", "place", F.length("text")).collect()) == [(i, i + 1) for i in range(4000)]
    assert keyed.placed(rows.limit(0), ["id"]).count() == 0


def most_rows_of_a_task(rows):
    """Rows of the largest partition behind the last join of rows."""
    return max(r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


def test_owners_of_calls_without_a_key(spark):
    """Null keys are no group of their own: they have no owner and don't go to one task; both kinds of owner keep their precedence."""
    from tessera.operators import analytics

    usage = spark.createDataFrame([(i, "chat", i if i % 5 == 0 else None, i if i % 7 == 0 else None, "x", "gpt-5", 1, 2) for i in range(4000)], "id long, type string, message_id long, paper_id long, provider string, model string, prompt_tokens long, completion_tokens long")
    messages = spark.createDataFrame([(i, i + 10_000) for i in range(0, 4000, 10)], "message_id long, user_id long")
    papers = spark.createDataFrame([(i, i + 20_000) for i in range(0, 4000, 7)], "paper_id long, user_id long")
    want = {i: i + 10_000 if i % 10 == 0 else i + 20_000 if i % 7 == 0 else None for i in range(4000)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        owned = analytics.with_owner(usage, messages, papers)
        assert {r["id"]: r["user_id"] for r in owned.collect()} == want and most_rows_of_a_task(owned) < 1500
        sql.register(spark, usage.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")), messages, papers)
        found = spark.sql(f"SELECT * FROM {sql.OWNED}")
        assert sorted(r["user_id"] or 0 for r in found.collect()) == sorted(u or 0 for u in want.values()) and most_rows_of_a_task(found) < 1500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_streams_of_files_out_of_order(spark, tmp_path):
    """Files over the same time lose no row to each other's watermark."""
    events = spark.read.parquet(f"{D}/events.parquet")
    for k in range(3):
        events.withColumns({"event_id": F.col("event_id") + k * 3_000_000, "user_id": F.col("user_id") + k * 1_000_000}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, live.e11_sweep(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, expiry.swept(live.file_updates(spark.read.parquet(f"{tmp_path}/events.parquet")), 720).collect())) and len(got) > 500
    assert live.e2_stale(spark, str(tmp_path)).count() == 3 * live.e2_stale(spark, D).count()


def test_versions_shuffle_no_table_for_few_keys(spark, tmp_path, monkeypatch):
    """Few keys of a large table are sent to its rows: the join that looks for them is a broadcast, though their filter's size is unknown."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tessera.sources import versions

    spark.range(200_000).select("id", F.col("id").cast("string").alias("v")).write.parquet(f"{tmp_path}/rows")
    rows, table, plans = spark.read.parquet(f"{tmp_path}/rows"), versions.Table(spark, f"{tmp_path}/table"), []
    table.create(rows)
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        assert table.update_by_key(rows.filter("id % 50000 = 0").select("id", F.lit("x").alias("v")), "id") == 2
        assert table.delete_by_key(rows.filter("id in (7, 8)"), "id") == 3 and table.upsert_ignore(rows.filter("id < 9"), "id") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("SortMergeJoin" in p for p in plans) and sum("BroadcastHashJoin" in p for p in plans) == 2
    got = table.read()
    assert got.count() == 200_000 and got.filter("v = 'x'").count() == 4 and got.distinct().count() == 200_000
