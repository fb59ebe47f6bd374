import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.ranks import exact_quantile, running
from gradeloom.operators import calibration as cal, evaluation as ev, losses as ls


def test_running_handles_a_key_with_a_third_of_all_rows(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", rnd.randint(0, 20), i, rnd.randint(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int, hit int")
    got = {r.id: (r.rank, r.s, r.m) for r in running(df, ["k"], [F.col("v").desc(), F.col("id")], {"s": "hit"}, {"m": "v"}, partitions=13).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        total, top = 0, None
        for at, r in enumerate(sorted(g, key=lambda r: (-r[1], r[2])), 1):
            total += r[3]
            assert got[r[2]] == (at, total, top)
            top = r[1] if top is None else max(top, r[1])


def test_exact_quantile(spark):
    rnd = random.Random(2)
    vals = [rnd.random() for _ in range(501)]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v double")
    got = {r.level: r.q for r in exact_quantile(df, [], "v", F.array(F.lit(0.1), F.lit(0.333))).collect()}
    s = sorted(vals)
    for level, q in got.items():
        pos = level * 500
        lo = math.floor(pos)
        assert abs(q - (s[lo] + (pos - lo) * (s[lo + 1] - s[lo]))) < 1e-12


def test_exact_quantiles_of_hard_groups(spark, monkeypatch):
    import numpy as np

    from gradeloom.functions import ranks

    monkeypatch.setattr(ranks, "BINS", 7)
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.normal(size=700).tolist(), "ties": [1.0] * 40 + [2.0] * 3, "one": [5.0], None: [-1e308, 1e308, 0.0, 1e-300],
        "wide": (10.0 ** rng.uniform(-200, 200, 300)).tolist(), "flat": [3.25] * 9, "nan": [float("nan"), 1.0, 2.0, None],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    levels = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.level): (r.n, r.q) for r in exact_quantile(df, ["g"], "v", F.array(*map(F.lit, levels))).collect()}
    assert len(got) == len(groups) * len(levels)
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and v == v)
        for level in levels:
            pos = level * (len(vs) - 1)
            a, b, w = vs[math.floor(pos)], vs[math.ceil(pos)], pos - math.floor(pos)
            want = a if a == b else a * (1 - w) + b * w
            assert got[g, level] == (len(vs), pytest.approx(want, rel=1e-12))


def test_rank_metrics(spark):
    run = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0), (2, 1, 1.0)], "qid int, doc_id int, score double")
    qrels = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 9, 1), (2, 5, 0)], "qid int, doc_id int, grade int")
    n = {r.qid: r.ndcg for r in ev.ndcg(run, qrels).collect()}
    ideal = 3.0 + 1.0 / math.log2(3)
    assert abs(n[1] - (3.0 / math.log2(3)) / ideal) < 1e-12 and n[2] == 0.0
    rec = {r.qid: r.recall for r in ev.recall_at_k(run, qrels).collect()}
    assert rec == {1: 0.5, 2: 0.0}
    assert {r.qid: r.recall for r in ev.recall_at_k(run, qrels, threshold=2).collect()}[1] == 1.0
    assert {r.qid: r.mrr for r in ev.mrr_at_k(run, qrels).collect()} == {1: 0.5, 2: 0.0}


def test_temperature_search_undoes_sharpening(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        z = [rnd.gauss(0, 1.5) for _ in range(4)]
        w = [math.exp(v) for v in z]
        rows.append((i, [3.0 * v for v in z], rnd.choices(range(4), w)[0], "choice"))
    rows += [(5000 + i, [0.0] * 15, 3, "choice") for i in range(5)]
    df = spark.createDataFrame(rows, "ex_id int, logits array<double>, label int, qtype string")
    temps = cal.fit_temperature_map(df)
    t = {r.bucket: r for r in temps.collect()}
    assert 2.5 < t["choice:3-5"].t < 3.6
    assert t["choice:11+"].source == "global" and t["choice:11+"].t == t["(global)"].t
    raw = df.withColumn("probs", F.expr("transform(logits, x -> exp(x - array_max(logits)))")).withColumn("probs", F.expr("transform(probs, x -> x / aggregate(probs, 0D, (a, b) -> a + b))"))
    before = cal.ece_by_bucket(raw).filter("bucket = 'choice:3-5'").first().ece
    after = cal.ece_by_bucket(cal.apply_temperature(df, temps)).filter("bucket = 'choice:3-5'").first().ece
    assert after < before / 3


def test_conformal_coverage_and_small_sets(spark):
    rnd = random.Random(4)
    rows = [(i, "easy" if i % 2 else "hard", 0.0, rnd.gauss(0, 1.0 if i % 2 else 2.0), 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, grp string, u_true double, u_hat double, sigma double")
    hits = cal.with_intervals(df.filter("id >= 1000"), cal.conformal_fit(df.filter("id < 1000")))
    cov = {r.grp: r for r in cal.coverage_by_group(hits).collect()}
    assert 0.86 < cov["__overall__"].coverage < 0.94 and cov["hard"].coverage < cov["easy"].coverage
    assert cov["__overall__"].worst_group_coverage == cov["hard"].coverage
    with pytest.raises(Exception, match="too few"):
        cal.conformal_fit(df.filter("id < 19")).collect()


def test_aurc_prefers_confidence_that_orders_errors(spark):
    rows = [(i, i / 100.0, 1 if i > 30 else 0) for i in range(100)]
    good = spark.createDataFrame(rows, "ex_id int, conf double, correct int").withColumn("s", F.lit("a"))
    bad = good.withColumn("conf", 1 - F.col("conf")).withColumn("s", F.lit("b"))
    got = {r.s: r.aurc for r in ev.aurc(good.unionByName(bad), ["s"]).collect()}
    assert got["a"] < 0.1 < got["b"]


def test_bootstrap_needs_aligned_queries(spark):
    a = spark.createDataFrame([(i, 0.5 + 0.01 * i) for i in range(20)], "qid int, ndcg double")
    d = ev.paired_differences(a, a.withColumn("ndcg", F.col("ndcg") - 0.1)).withColumn("c", F.lit(1))
    r = ev.paired_bootstrap(d, ["c"], resamples=200).first()
    assert abs(r.mean_diff - 0.1) < 1e-9 and r.p_value == 0.0 and abs(r.lo - 0.1) < 1e-9
    with pytest.raises(Exception, match="one side"):
        ev.paired_differences(a, a.filter("qid < 5")).collect()


def slate(spark, rows):
    return spark.createDataFrame([(1, s, i, float(z), r, a, a, u) for s, i, z, r, a, u in rows], "qid int, slate int, item_id int, score double, rel int, is_anchor boolean, masked boolean, utility double")


def test_masked_rows_cannot_move_listnet(spark):
    rows = [(0, 0, 1.0, 2, False, None), (0, 1, 0.0, 0, False, None), (0, 2, 50.0, 0, True, 3.0)]
    a = ls.listnet_loss(slate(spark, rows)).first()["list"]
    b = ls.listnet_loss(slate(spark, [*rows[:2], (0, 2, -50.0, 0, True, 3.0)])).first()["list"]
    assert a == b < 1.0


def test_anchor_losses(spark):
    ruler = [(0, i, 2.0 * u + 7.0, 0, True, u) for i, u in enumerate((-3.0, -1.0, 1.0, 3.0))]
    assert ls.anchor_affine_loss(slate(spark, ruler)).first()["anchor"] < 1e-9
    assert ls.anchor_monotone_loss(slate(spark, ruler)).first()["anchor_mono"] == 0.0
    back = [(s, i, -z, r, a, u) for s, i, z, r, a, u in ruler]
    assert ls.anchor_monotone_loss(slate(spark, back)).first()["anchor_mono"] > 4.0


def test_rps_grows_with_distance(spark):
    p = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], 1), ([1.0, 0.0, 0.0, 0.0], 3)], "p array<double>, rel int")
    near, far = [r.x for r in p.select(ls.rps("p", "rel").alias("x")).collect()]
    assert abs(near - 1 / 3) < 1e-12 and abs(far - 1.0) < 1e-12


def test_lambda_ranknet_by_hand(spark):
    got = ls.lambda_ranknet(slate(spark, [(0, 0, 0.0, 1, False, None), (0, 1, 1.0, 0, False, None)])).first()
    want = math.log(1 + math.exp(1.0)) * abs(1.0 * (1 / math.log2(3) - 1.0)) / 1.0
    assert got.pairs == 1 and abs(got.pair_loss - want) < 1e-12


def test_bootstrap_of_many_tasks_matches_plain_sums(spark, monkeypatch):
    import hashlib

    import numpy as np

    monkeypatch.setattr(ev, "KEYS_AT_ONCE", 3)
    monkeypatch.setattr(ev, "SUMS_AT_ONCE", 1)
    rng = np.random.default_rng(0)
    rows = [(c, i, float(rng.normal(0.1 * k, 1))) for k, c in enumerate(("a", "b", None)) for i in range(40)] + [("a", 7, 0.5)]
    df = spark.createDataFrame(rows, "c string, qid int, diff double").repartition(5)
    got = {r.c: r for r in ev.paired_bootstrap(df, ["c"], resamples=300, seed=4).collect()}
    word = {i: int(hashlib.md5(f"4|{i}".encode()).hexdigest()[:8], 16) for i in range(40)}
    weight = {i: ev.resample_weights(np.array([w]), 300)[0] for i, w in word.items()}
    assert abs(np.mean(list(weight.values())) - 1) < 0.05 and abs(np.var(list(weight.values())) - 1) < 0.1
    for c in ("a", "b", None):
        mine = [r for r in rows if r[0] == c]
        means = sum(weight[i] * d for _, i, d in mine) / sum(weight[i] for _, i, _ in mine)
        want = (len(mine), np.mean([d for _, _, d in mine]), *np.percentile(means, [2.5, 97.5]), min(2 * min((means <= 0).mean(), (means >= 0).mean()), 1))
        assert np.allclose([got[c].n, got[c].mean_diff, got[c].lo, got[c].hi, got[c].p_value], want)
    assert ev.paired_bootstrap(df.limit(0), ["c"]).count() == 0


def test_last_rows_are_kept_chunk_by_chunk():
    import numpy as np
    import pandas as pd

    from gradeloom.streaming.coverage import LastRows

    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"ts": rng.integers(0, 40, 5000), "id": rng.permutation(5000), "covered": rng.random(5000) < 0.5})
    last = LastRows(300)
    for at in range(0, 5000, 77):
        last.add(rows.iloc[at:at + 77])
        assert len(last.kept) <= 300
    want = rows.sort_values(["ts", "id"])["covered"].to_numpy()[-300:].astype("uint8").tobytes()
    assert last.hits() == want and last.seen == 5000 and LastRows(3).hits() == b""
