import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import budget, judgements as jd, typed
from gradeloom.sources import collections as col, ledger, typed_json
from gradeloom.streaming import coverage, escalations

LINES = [
    {"state": "late parcel", "type": "choice", "instructions": "topic", "criteria": {"zeta": "last", "alpha": None, "mid": ""}, "label": "alpha"},
    {"state": {"b": 1, "a": [1, 2]}, "type": "score", "instructions": "how bad", "criteria": ["low", "mid", "high"], "label": 2, "weight": 0.5, "meta": {"tone": "calm"}},
    {"state": "s", "type": "noul", "instructions": "is it", "criteria": {"true": "sure"}, "label": True, "soft_label": [1, 3]},
    {"state": "s", "type": "choice", "instructions": "topic", "criteria": ["x", "2"], "label": "2"},
    {"state": "s", "type": "choice", "instructions": "topic", "criteria": ["x", "y"], "label": 7},
    {"state": "s", "type": "rank", "instructions": "topic", "label": 1},
    {"state": "s", "type": "noul", "instructions": "none"},
    {"state": "s", "type": "noul", "instructions": "odd", "soft_label": [0.2, 0.3, 0.5]},
    {"state": "s", "type": "choice", "instructions": "none", "criteria": {}, "label": 0},
]


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("typed") / "ex.jsonl"
    text = "\n".join(json.dumps(x) for x in LINES)
    path.write_text(text + "\n\n   \n{broken\n")
    return typed.prepare(typed_json.read_typed_jsonl(spark, str(path))).cache()


def test_typed_lines(checked):
    rows = checked.collect()
    assert len(rows) == len(LINES) + 1
    a, b, c, d = rows[:4]
    assert a.option_keys == ["zeta", "alpha", "mid"] and a.label == 1 and a.options == ["zeta: last", "alpha", "mid"]
    assert json.loads(b.state) == {"b": 1, "a": [1, 2]} and b.label == 2 and b.weight == 0.5 and b.meta == {"tone": "calm"}
    assert b.options[1] == "level 1: mid" and a.weight == 1.0 and a.meta == {}
    assert c.label == 1 and c.options[0] == "false: " + typed.NOUL_FALSE and c.options[1] == "true: sure"
    assert d.label == 1 and d.label_kind == "name"
    assert all(r.errors == [] for r in rows[:4])
    assert [r.errors for r in rows[4:]] == [
        ["label out of range"], ["unknown type", "label out of range"], ["no label"], ["soft label length"],
        ["choice needs criteria", "label out of range"], ["not json"],
    ] or all(r.errors for r in rows[4:])


def test_targets_and_permutation(checked):
    ok = typed.with_targets(typed.valid(checked)).withColumn("ex_id", F.monotonically_increasing_id()).cache()
    t = [r.target for r in ok.collect()]
    assert t[0] == [0.0, 1.0, 0.0] and t[2] == [0.25, 0.75]
    for epoch in range(3):
        before = {r.ex_id: r for r in ok.collect()}
        for r in typed.permute_options(ok, epoch=epoch).collect():
            o = before[r.ex_id]
            assert r.options[r.label] == o.options[o.label] and sorted(r.options) == sorted(o.options)
            if r.qtype == "score":
                assert r.options == o.options
            if o.soft_label:
                assert r.soft_label[r.options.index(o.options[1])] == o.soft_label[1]
    sharp = ok.limit(1).select(typed.sharpen(F.array(F.lit(0.2), F.lit(0.8)), 0.5).alias("p")).first().p
    assert abs(sharp[1] - 0.64 / 0.68) < 1e-12


def test_sequence_fit(spark):
    df = spark.createDataFrame([(1, [60] * 10, 50, 600), (2, [2, 2], 5, 10)], "ex_id int, o array<int>, i int, s int")
    a, b = budget.sequence_fit(df, "o", "i", "s").orderBy("ex_id").collect()
    assert a.shrink_fired and a.option_tokens_kept == [16] * 10 and a.head_tokens == 22 and a.state_truncated and a.total_tokens == 512
    assert not b.shrink_fired and b.option_tokens_kept == [2, 2] and b.state_kept == 10 and b.markers_fit
    rep = budget.preflight(budget.budget_report(budget.sequence_fit(df, "o", "i", "s"))).first()
    assert rep.examples == 2 and rep.status == "FAIL" and rep.state_truncated_frac == 0.5


def test_qrels_file(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td1\t1\nq1 d2 -1\nshort line\nq2\td1\t0\n")
    got = {(r.qid, r.doc_id): (r.grade, r.clamped) for r in col.read_qrels(spark, str(tmp_path)).collect()}
    assert got == {("q1", "d1"): (1, False), ("q1", "d2"): (0, True), ("q2", "d1"): (0, False)}


def test_corpus_file(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id":"1","title":null,"text":"t"}\n{"_id":"2","title":"a","text":"b"}\n')
    got = {r.doc_id: r.f for r in col.read_corpus(spark, str(tmp_path)).select("doc_id", col.full_text().alias("f")).collect()}
    assert got == {"1": "t", "2": "a\nb"}


def test_runs_on_disk(spark, tmp_path):
    for i, m in enumerate([{"ndcg": 0.5, "by": {"a": 1.0, "b": 2.0}}, {"ndcg": 0.7}]):
        d = tmp_path / f"run{i}"
        d.mkdir()
        (d / "manifest.json").write_text(json.dumps({"name": f"n{i}", "status": "ok", "wall_seconds": 1.5, "config": {"k": "10"}}, indent=2))
        (d / "metrics.json").write_text(json.dumps(m, indent=2))
    runs = ledger.read_runs(spark, str(tmp_path))
    assert {(r.run, r.status, r.wall_seconds) for r in runs.collect()} == {("run0", "ok", 1.5), ("run1", "ok", 1.5)}
    got = {(r.run, r.path): r.value for r in ledger.run_metrics(runs).collect()}
    assert got == {("run0", "ndcg"): 0.5, ("run0", "by.a"): 1.0, ("run0", "by.b"): 2.0, ("run1", "ndcg"): 0.7}


def test_digest_depends_on_order(spark):
    def d(sigs):
        return spark.range(1).select(jd.request_digest(F.lit("b"), F.lit("q"), F.array(*map(F.lit, sigs)), F.array(F.lit("r"))).alias("d")).first().d

    import hashlib

    want = hashlib.sha256("\x1f".join(["b", "q", "x", "y", "r", ""]).encode()).hexdigest()[:20]
    assert d(["x", "y"]) == want != d(["y", "x"])


def test_cache_replay(spark):
    req = spark.createDataFrame([("b", "d1"), ("b", "d2")], "backend string, digest string")
    cache = spark.createDataFrame([("b", "d1", 0.5)], "backend string, digest string, cost_usd double")
    hits, misses = jd.cache_lookup(req, cache)
    assert [r.digest for r in hits.collect()] == ["d1"] and [r.digest for r in misses.collect()] == ["d2"]
    with pytest.raises(RuntimeError):
        jd.require_complete(misses)
    jd.require_complete(jd.cache_lookup(req.filter("digest = 'd1'"), cache)[1])


def test_stored_verdicts_grow_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("b", "d1", 0.5), ("c", "d1", 0.1)], "backend string, digest string, cost_usd double")
    jd.store_verdicts(rows, path)
    jd.store_verdicts(rows.unionByName(rows.limit(1).withColumn("digest", F.lit("d2"))), path)
    assert jd.load_verdicts(spark, path).count() == 3


def test_a_bucketed_cache_is_read_in_place_and_survives_racing_writers(spark):
    table = "verdict_cache_of_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    one = spark.createDataFrame([("b", f"d{i}", 0.1 * i) for i in range(50)], "backend string, digest string, cost_usd double")
    two = spark.createDataFrame([("b", f"d{i}", 0.2 * i) for i in range(25, 75)], "backend string, digest string, cost_usd double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        jd.append_verdicts(one, table, 4)
        # the second job looked before the first had written, so both add what they were told
        two.write.mode("append").bucketBy(4, *jd.CACHE_KEY).sortBy(*jd.CACHE_KEY).saveAsTable(table)
        assert spark.table(table).count() == 100
        held = {r.digest: r.cost_usd for r in jd.cached_verdicts(spark, table).collect()}
        assert len(held) == 75 and held["d30"] == 3.0
        jd.append_verdicts(two, table, 4)
        assert spark.table(table).count() == 100
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        asked = spark.createDataFrame([(f"d{i}", "b") for i in range(70, 90)], "digest string, backend string")
        hits, misses = jd.cache_lookup(asked, jd.cached_verdicts(spark, table))
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the requests
        assert hits.count() == 5 and misses.count() == 15
        jd.compact_verdicts(spark, table, 4)
        assert spark.table(table).count() == 75
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_every_candidate_is_asked_about(spark):
    t = spark.range(1, 66).select(F.lit(1).alias("qid"), F.lit("q").alias("query"), F.col("id").alias("item_id"), F.col("id").alias("contest_rank"), F.lit("t").alias("text"))
    r = jd.build_requests(t, ["no", "yes"], "b").collect()
    assert sorted(len(x.item_ids) for x in r) == [5, 30, 30] and len({i for x in r for i in x.item_ids}) == 65
    assert set(json.loads(r[0].payload)) == {"state", "questions"}


def test_grades(spark):
    df = spark.range(1).select(
        jd.smooth_grade(F.lit(2)).alias("p"), jd.smooth_grade(F.lit(4)).alias("off"),
        jd.expected_grade(F.array(*[F.lit(x) for x in (0.01, 0.04, 0.21, 0.74)])).alias("e"),
    ).first()
    assert abs(df.p[2] - 0.9) < 1e-12 and abs(sum(df.p) - 1) < 1e-12 and df.off is None and abs(df.e - 2.68) < 1e-12


def test_escalation_log_round_is_replaced(spark, tmp_path):
    log = spark.createDataFrame([(1, 2, 0.5)], "qid int, item_id int, student_utility double")
    for r in (0, 1, 1):
        escalations.append_log(log, str(tmp_path / "log"), r)
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("round").count().count() == 2
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_coverage_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    base = spark.range(300).select(
        F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("grp"),
        ((F.col("id") % 10 < 9) | (F.col("id") < 100)).alias("covered"),
    )
    schema = base.schema
    for at in range(3):
        base.filter((F.col("id") >= at * 100) & (F.col("id") < at * 100 + 100)).coalesce(1).write.mode("append").parquet(str(src))
    late = base.filter("id < 5").withColumn("id", F.col("id") + 1000)

    def run(make, mode, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    exact = run(lambda s: coverage.last_n_coverage(s, window=40), "update", "last_n")
    last = {r.grp: r for r in exact.groupBy("grp").agg(F.max_by("coverage", "seen").alias("c"), F.max("seen").alias("n")).collect()}
    assert last["a"].n == 150 and last["a"].c == 1.0 and last["b"].c == 0.8
    late.coalesce(1).write.mode("append").parquet(str(src))
    w = run(lambda s: coverage.windowed_coverage(s, "1 hour", watermark="30 minutes"), "append", "win")
    assert w.filter("grp = 'a'").agg(F.sum("n")).first()[0] <= 150
    whole = coverage.windowed_coverage(base, "1 hour")
    first = {(r.window.start, r.grp): r.n for r in whole.collect()}
    assert all(first[(r.window.start, r.grp)] >= r.n for r in w.filter("window.start > timestamp_seconds(3600)").collect())


def test_run_metrics_of_any_depth(spark):
    from gradeloom.sources import ledger

    text = '{"a":1,"b":{"c":2,"d":{"e":3,"on":true}},"by":{"4":{"r":0.5}},"l":[1,{"x":2},[3]],"s":"no","n":null}'
    rows = spark.createDataFrame([("r", text), ("broken", "{"), ("none", None)], "run string, metrics string")
    got = {(r.run, r.path): r.value for r in ledger.run_metrics(rows).collect()}
    assert got == {("r", p): v for p, v in {"a": 1, "b.c": 2, "b.d.e": 3, "by.4.r": 0.5, "l.0": 1, "l.1.x": 2, "l.2.0": 3}.items()}


def test_a_stored_verdict_without_a_cost_is_a_hit_once(spark):
    req = spark.createDataFrame([("b", "d1"), ("b", "d2"), ("b", "d3")], "backend string, digest string")
    cache = spark.createDataFrame([("b", "d1", 0.5), ("b", "d1", None), ("b", "d2", None)], "backend string, digest string, cost_usd double")
    got = jd.cache_stats(req, cache).first()
    assert (got.hits, got.misses, got.saved_usd) == (2, 1, 0.5)
    assert jd.cache_lookup(req, cache)[0].count() == 2
