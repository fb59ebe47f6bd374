import math

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import expr as ex
from gradeloom.operators import frontier as fr, pricing


def scored(spark, utilities, sigma, qid=1):
    rows = [(qid, i, float(u), float(s)) for i, (u, s) in enumerate(zip(utilities, sigma))]
    return spark.createDataFrame(rows, "qid int, item_id long, utility double, sigma double")


def test_normal_cdf(spark):
    xs = [-3.0, -1.0, -0.2, 0.0, 0.4, 2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ex.normal_cdf(F.col("x")).alias("p"))
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 2e-7 for r in df.collect())


def test_frontier_finds_the_contested(spark):
    u = [10.0 - 0.1 * i for i in range(4)] + [5.0 - 0.05 * i for i in range(6)] + [-5.0] * 90
    f = fr.frontier(scored(spark, u, [0.3] * 100), 5)
    members = {r.item_id for r in f.filter("on_frontier").collect()}
    assert members == set(range(4, 10))
    assert f.filter("rank = 5").first().p_swap == 0.5
    whole = fr.frontier(scored(spark, u, [0.3] * 100), 100).agg(F.min("on_frontier"), F.max("swap_probability"), F.min("p_swap")).first()
    assert whole[0] and whole[1] == 0.0 and whole[2] == 0.5


def test_regret_is_zero_only_when_certain(spark):
    u = [2.0 - 0.1 * i for i in range(30)]
    r = [fr.expected_regret(scored(spark, u, [s] * 30), 10, 64, seed=1).first().regret for s in (0.0, 0.1, 0.5, 2.0)]
    assert r[0] == 0.0 and r[0] < r[1] < r[2] < r[3] <= 1.0


def test_decisions(spark):
    state = spark.createDataFrame([(1, 0.03, 8, 2.0), (2, 0.0, 8, 2.0), (3, 0.03, 0, 2.0), (4, 0.03, 8, 0.1)], "qid int, regret double, frontier_size int, pool_quality double")
    low = {r.qid: r for r in fr.decide(state, 1.0).collect()}
    assert low[1].action == "teacher_rubric" and low[2].action == "stop" and low[3].action == "stop"
    assert set(low[1].action_values) == {"teacher_rubric", "teacher_choice", "read_more"}
    assert "widen_retrieval" in low[4].action_values
    assert {r.action for r in fr.decide(state, 1e9).collect()} == {"stop"}
    be = {r.qid: r.break_even_lambda for r in fr.break_even_lambda(state, action="teacher_rubric").collect()}
    only = [a for a in fr.ACTIONS if a["action"] == "teacher_rubric"]
    assert fr.decide(state, be[1] * 0.99, actions=only).filter("qid = 1").first().action == "teacher_rubric"
    assert fr.decide(state, be[1] * 1.01, actions=only).filter("qid = 1").first().action == "stop"


def test_fusion_touches_only_what_was_judged(spark):
    s = scored(spark, [1.0, 0.5, 0.0], [0.5, 0.5, 0.05])
    g = spark.createDataFrame([(1, 1, 3.0), (1, 2, 0.0)], "qid int, item_id long, expected_grade double")
    got = {r.item_id: (round(r.utility, 9), r.sigma) for r in fr.fuse(s, g).collect()}
    assert got == {0: (1.0, 0.5), 1: (2.25, 0.12), 2: (round(0.7 * -3.0, 9), 0.05)}


def test_cascade_buys_nothing_at_a_high_price(spark):
    s = scored(spark, [2.0 - 0.1 * i for i in range(30)], [0.5] * 30)
    v = s.select("qid", "item_id", F.lit(2.0).alias("expected_grade"), F.array(F.lit(1.0)).alias("level_probs"), F.lit(0.001).alias("cost_usd"))
    dear = fr.cascade(s, v, samples=32, lambda_cost=1e9)["summary"].first()
    assert dear.action == "stop" and not dear.escalated and dear.regret_before == dear.regret_after
    cheap = fr.cascade(s, v, samples=32, lambda_cost=1.0)["summary"].first()
    assert cheap.escalated and cheap.cost_usd > 0
    assert not fr.cascade(s, None, samples=32, lambda_cost=1.0)["summary"].first().escalated


GRID = [("a", 1.0, 0.5, "x"), ("b", 2.0, 0.7, "x"), ("c", 2.0, 0.7, "y"), ("d", 3.0, 0.6, "y"), ("e", 4.0, 0.9, "y"), ("base", 8.0, 0.7, "z")]


def test_pareto_and_improvement(spark):
    pts = spark.createDataFrame(GRID, "name string, cost_per_1k double, quality double, family string")
    assert {r.name for r in pricing.pareto(pts).filter("on_front").collect()} == {"a", "b", "c", "e"}
    imp = pricing.improvement_over(pts, "base").first()
    assert imp.cost_ratio == 4.0 and imp.quality_from == "e" and abs(imp.quality_gain - 0.2) < 1e-9
    with pytest.raises(Exception, match="no configuration"):
        pricing.improvement_over(pts, "nobody").collect()


def test_pareto_equals_brute_force_on_many_points(spark):
    import random

    rnd = random.Random(5)
    rows = [(f"p{i}", float(rnd.randint(1, 60)), float(rnd.randint(1, 60)), "f") for i in range(400)]
    want = {a[0] for a in rows if not any(b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2]) for b in rows)}
    pts = spark.createDataFrame(rows, "name string, cost_per_1k double, quality double, family string")
    assert {r.name for r in pricing.pareto(pts).filter("on_front").collect()} == want


def test_targets_without_a_verdict_are_reported_and_missing_prices_filled(spark):
    s = scored(spark, [3.0 - 0.01 * i for i in range(30)], [0.8] * 30)
    v = spark.createDataFrame([(1, i, 2.0, [0.25] * 4, None, 1000) for i in range(2)],
                              "qid int, item_id int, expected_grade double, level_probs array<double>, cost_usd double, tokens long")
    out = fr.cascade(s, v, samples=16, lambda_cost=1.0)
    row = out["summary"].first()
    assert row.n_judged + row.n_unanswered == 30 and row.n_judged == 2 and out["unanswered"].count() == 28
    assert abs(row.cost_usd - 2 * 1000 / 1e6 * 0.042) < 1e-12 and row.latency_ms > 0
