"""Dealing, fits, designs: properties that hold for any data."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import anchors, budget, designs, scale, slates


def pool_of(spark, n=100, qid=1):
    return spark.range(n).select(F.lit(qid).alias("qid"), F.col("id").alias("doc_id"), F.col("id").alias("first_rank"))


def test_every_candidate_is_dealt_once(spark):
    pool = pool_of(spark)
    for stratify in (True, False):
        rows = slates.deal(pool, 10, 2, stratify).collect()
        assert len({r.doc_id for r in rows}) == len(rows) == 100
        sizes = {}
        for r in rows:
            sizes[r.slate] = sizes.get(r.slate, 0) + 1
        assert len(sizes) == 13 and max(sizes.values()) <= 8
    assert slates.passes_per_query(pool, 10, 2).first().passes == 13


def test_anchors_may_not_fill_a_slate(spark):
    with pytest.raises(ValueError):
        slates.deal(pool_of(spark), 4, 4)
    with pytest.raises(ValueError):
        slates.anchor_slots(slates.deal(pool_of(spark)), 5, 4)


def items(spark, shift, slope=1.0, n=4):
    rows = [(1, s, -(j + 1), True, (2.0 * j - 3.0 - shift[s]) / slope, 2.0 * j - 3.0) for s in range(len(shift)) for j in range(n)]
    rows += [(1, s, s, False, 0.5, None) for s in range(len(shift))]
    return spark.createDataFrame(rows, "qid int, slate int, item_id int, is_anchor boolean, lp double, utility double")


def test_shift_is_recovered(spark):
    fits = {r.slate: r for r in scale.fit_slates(items(spark, [0.0, 1.5, -2.0]), "shift").collect()}
    assert [round(fits[s].intercept, 9) for s in range(3)] == [0.0, 1.5, -2.0]
    assert all(f.residual < 1e-6 for f in fits.values())
    cal = {r.slate: r.utility for r in scale.calibrate(items(spark, [0.0, 1.5, -2.0]), "shift").collect()}
    assert [round(cal[s], 9) for s in range(3)] == [0.5, 2.0, -1.5]


def test_ridge_goes_to_its_prior(spark):
    rows = items(spark, [0.0], slope=0.5)
    slopes = [scale.fit_slates(rows, "ridge", lam, 2.0).first().slope for lam in (0.0, 10.0, 1e9)]
    assert abs(slopes[0] - 0.5) < 1e-9 and slopes[0] < slopes[1] < slopes[2] and abs(slopes[2] - 2.0) < 1e-5
    affine = scale.fit_slates(rows, "affine").first()
    assert abs(affine.slope - 0.5) < 1e-9 and affine.residual < 1e-6


def test_affine_fit_of_equal_anchors_is_the_smallest_one(spark):
    rows = spark.createDataFrame([(1, 0, 1, True, 2.0, 1.0), (1, 0, 2, True, 2.0, 3.0)], "qid int, slate int, item_id int, is_anchor boolean, lp double, utility double")
    f = scale.fit_slates(rows, "affine").first()
    assert abs(f.slope - 0.8) < 1e-9 and abs(f.intercept - 0.4) < 1e-9 and abs(f.residual - 1.0) < 1e-9


def test_greedy_anchors_are_distinct_and_near_their_targets(spark):
    pool = spark.createDataFrame([(1, i, i + 1, g) for i, g in enumerate([0.0, 0.1, 1.4, 1.6, 3.0, 2.9])], "qid int, doc_id long, first_rank long, expected_grade double")
    got = [r.v for r in anchors.graded_anchors(pool, 4).orderBy("anchor_no").collect()]
    assert got == [0.0, 1.4, 1.6, 3.0]
    assert anchors.graded_anchors(pool, 10).count() == 6


def test_option_tokens(spark):
    def tokens(m, want=10_000):
        return spark.range(1).select(budget.option_tokens_available(F.lit(m), want)).first()[0]

    assert tokens(10) == 16 and tokens(3) == 48 and tokens(4) == 43 and tokens(200) == 3
    assert tokens(10, 3) == 3


def test_additive_fit_residuals_cancel(spark):
    pool = spark.range(40).select(F.lit(1).alias("qid"), F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("grade"))
    d = designs.block_design(pool, 6, 25, 0.5, seed=3).withColumn("y", F.sin(F.col("item_id") * 1.7) - F.cos(F.col("slate") * 0.9) + 0.1 * F.sin(F.col("slate") * F.col("item_id")))
    solved = designs.fit_additive(d).cache()
    for group in ("item_id", "slate"):
        worst = solved.groupBy(group).agg(F.abs(F.sum("residual")).alias("s")).agg(F.max("s")).first()[0]
        assert worst < 1e-8
    level = solved.select("item_id", "l_hat").distinct().agg(F.sum("l_hat")).first()[0] + solved.select("slate", "c_hat").distinct().agg(F.sum("c_hat")).first()[0]
    assert abs(level) < 1e-6
    rows = solved.collect()
    items, slates_ = sorted({r.item_id for r in rows}), sorted({r.slate for r in rows})
    x = np.zeros((len(rows), len(items) + len(slates_)))
    for k, r in enumerate(rows):
        x[k, items.index(r.item_id)], x[k, len(items) + slates_.index(r.slate)] = 1.0, -1.0
    y = np.array([r.y for r in rows])
    plain = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(plain - np.array([r.residual for r in rows])).max() < 1e-8


def test_long_chains_are_one_component(spark):
    order = np.random.default_rng(3).permutation(150).tolist()
    chain = [(1, order[k], i) for k in range(150) for i in (1000 + k, 1001 + k)]
    got = designs.components(spark.createDataFrame(chain + [(1, 999, 5)], "qid int, slate int, item_id int")).collect()
    assert {r.slate: r.component for r in got} == {**{s: 0 for s in range(150)}, 999: 999}


def test_spread_anchors_read_the_whole_pool(spark):
    pool = spark.range(200).select(F.lit(1).alias("qid"), F.col("id").alias("doc_id"), F.col("id").alias("first_rank"), F.col("id").cast("double").alias("utility"))
    assert [r.v for r in anchors.spread_anchors(pool, 4).orderBy("anchor_no").collect()] == [10.0, 70.0, 129.0, 189.0]
    flat = pool.withColumn("utility", F.lit(1.0))
    assert sorted(r.doc_id for r in anchors.spread_anchors(flat, 4).collect()) == [0, 1, 2, 3]


def test_disjoint_slates_are_not_connected(spark):
    d = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 1, 3), (1, 2, 9), (2, 0, 1)], "qid int, slate int, item_id int")
    got = {r.qid: (r.n_slates, r.n_components, r.connected) for r in designs.connectivity(d).collect()}
    assert got == {1: (3, 2, False), 2: (1, 1, True)}


def test_score_contract(spark):
    packed = slates.pack_options(spark.createDataFrame([(1, 0, i, i, f"text {i}", "q") for i in range(3)], "qid int, slate int, pos int, item_id int, text string, query string"))
    even = slates.score_slates(packed, lambda p: [[math.log(1 / len(o))] * len(o) for o in p["options"]])
    assert slates.scorer_violations(even).count() == 0 and slates.unpack_scores(even).count() == 3
    short = slates.score_slates(packed, lambda p: [[0.0] for _ in p["options"]])
    assert [r.problem for r in slates.scorer_violations(short).collect()] == ["count"]
    wrong = slates.score_slates(packed, lambda p: [[float("nan"), 0.0, 0.0] for _ in p["options"]])
    assert [r.problem for r in slates.scorer_violations(wrong).collect()] == ["not finite"]


def test_training_slates_sort_no_row_for_every_slate(spark):
    rows = [(q, d, g, (d * 7 + (q or 0)) % 23) for q in (1, 2, 3, None) for d in range(5 if q == 3 else 20) for g in [None if q == 2 and d % 3 == 0 else (d * d + (q or 0)) % 4]]
    pool = spark.createDataFrame(rows, "qid long, doc_id long, grade int, first_rank long")
    anchors = spark.createDataFrame([(q, a, 1.0 * a) for q in (1, 2, 3) for a in range(4)], "qid long, anchor_no int, utility double")
    items = slates.training_slates(pool, anchors, slates_per_query=12, seed=5)
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    wide = slates.training_slates(pool, anchors, slates_per_query=12, seed=5, local_pool=10)
    assert "Window" in wide._jdf.queryExecution().optimizedPlan().toString()
    assert wide.exceptAll(items).isEmpty() and items.exceptAll(wide).isEmpty()
    assert items.filter("NOT is_anchor").count() == 3 * 12 * 6 and items.filter("is_anchor").count() == 2 * 12 * 4
