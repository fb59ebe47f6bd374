import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeloom.functions import draws, expr as ex
from gradeloom.operators import anchors as anchors_of, designs, scale


def candidates(spark):
    rows = spark.range(900).select((F.col("id") % 11).alias("qid"), F.col("id").alias("doc_id"), (F.col("id") % 7 % 4).cast("int").alias("grade"), (F.col("id") * 0.5).alias("l"))
    return rows.withColumn("grade", F.when(F.col("doc_id") % 50 != 0, F.col("grade"))).repartition(4)


def test_a_candidate_is_shuffled_once_for_all_slates(spark):
    """Drawing for 60 slates must not sort or shuffle a row for every slate and candidate."""
    plan = designs.block_design(candidates(spark), 8, 60, 0.5, keep=("l",))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(qid", plan)) == 1 and "Join" not in plan and "Window" not in plan


def test_large_queries_give_the_same_slates(spark):
    pool = candidates(spark)
    for only_full in (False, True):
        here = designs._sample(pool, 9, 30, 0.7, 5, only_full, keep=("l",))
        rows = sorted(map(tuple, here.collect()), key=str)
        assert rows == sorted(map(tuple, designs._sample(pool, 9, 30, 0.7, 5, only_full, 81, ("l",)).collect()), key=str)  # some queries
        assert rows == sorted(map(tuple, designs._sample(pool, 9, 30, 0.7, 5, only_full, 0, ("l",)).collect()), key=str)  # all of them
        assert len(rows) == 11 * 30 * 9 and all(r[4] == r[2] * 0.5 for r in rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_stand_in_every_slate_without_a_second_draw(spark):
    """The anchors go to the query's candidates; slates are not drawn again to learn which there are."""
    pool = candidates(spark)
    anchors = pool.filter("doc_id % 40 = 3").select("qid", "doc_id")
    design = designs.anchored_design(pool, anchors, 4, 10, 12, 0.7, seed=3, keep=("l",))
    plan = plan_of(design)
    assert len(re.findall(r"Exchange hashpartitioning\(qid", plan)) == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan
    near, wide = (
        sorted(map(tuple, designs._inlined(designs._slates(pool, 6, 12, 0.7, 3, True, n, ("l",), anchors)).collect()), key=str) for n in (designs.LOCAL_POOL, 0))
    assert near == wide == sorted(map(tuple, design.collect()), key=str)
    named = {tuple(r) for r in anchors.collect()}
    assert {(r[0], r[2]) for r in near if r[5]} == named and not {(r[0], r[2]) for r in near if not r[5]} & named
    assert sum(r[5] for r in near) == 12 * len(named) and sum(not r[5] for r in near) == 11 * 12 * 6


def test_a_report_reads_its_slates_once(spark):
    pool = candidates(spark)
    design = designs.anchored_design(pool, pool.filter("doc_id % 40 = 3").select("qid", "doc_id"), 4, 10, 12, seed=3, keep=("l",))
    items = design.withColumns({"utility": F.col("l"), "lp": F.sin("l"), "truth": F.col("grade").cast("double")})
    report = scale.scale_report(items, ["qid"])
    plan = plan_of(report)
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Expand" not in plan
    assert len(re.findall(r"covar_pop\([^)]*\) windowspec", plan)) == 1  # a moment of a slate is worked out once
    rows = {r.qid: r for r in report.collect()}
    cal = scale.calibrate(items).toPandas()
    for qid, mine in cal.groupby("qid"):
        slates = mine.groupby("slate")[["slope", "residual"]].first()
        r = rows.pop(qid)
        assert r.n_slates == len(slates) == 12 and r.n_pooled == len(mine)
        assert abs(r.slope_mean - slates.slope.mean()) < 1e-9 and abs(r.slope_std - slates.slope.std(ddof=0)) < 1e-9 and abs(r.anchor_residual_mean - slates.residual.mean()) < 1e-9
    assert not rows


def test_digests_of_vectors_are_those_of_the_rows(spark):
    heads, tails = [b"61|%d|%d" % (q, s) for q in (7, 123456789) for s in (0, 31)], ["", "|5", "|1234567", "|" + "ü" * 30]
    ends = draws.Texts(pa.array(tails))
    for head in heads:
        got = draws.digest_words(draws.Texts([head]), np.array([0]), ends, np.arange(4)[None, :])[0]
        short = draws.digest_words(draws.Texts([head]), np.array([0]), ends, np.arange(3)[None, :])[0]  # without the one that needs two blocks
        want = [int(hashlib.md5(head + t.encode()).hexdigest()[:8], 16) for t in tails]
        assert got.tolist() == want and short.tolist() == want[:3]


def test_spread_anchors_sort_no_row_for_every_target(spark):
    rows = [(q, d, float((d * 37 + q) % 19) / 7 if d % 9 else None, (d * 11 + q) % 50) for q in (1, 2, 3) for d in range(2 if q == 3 else 50)]
    pool = spark.createDataFrame(rows, "qid int, doc_id long, utility double, first_rank int")
    near = anchors_of.spread_anchors(pool, 5, keep=("first_rank",))
    plan = plan_of(near)
    assert "Window" not in plan and "Generate" not in plan and len(re.findall(r"Exchange hashpartitioning\(qid", plan)) == 1
    wide = anchors_of.spread_anchors(pool, 5, keep=("first_rank",), local_pool=0)
    assert "Window" in plan_of(wide) and near.columns == wide.columns
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, wide.collect()))
    assert near.filter("rank = first_rank").count() == 11
    assert anchors_of._round9(np.array([0.0000000005, 1.0000000015, 0.25, 3e7 + 0.1])).tolist() == [1e-9, 1.000000002, 0.25, 3e7 + 0.1]


def test_recovery_makes_its_observations_once(spark):
    rng = np.random.default_rng(8)
    rows = [(q, s, int(i), bool(i % 5 == 0), float(np.round(rng.normal(), 3))) for q in (1, 2, 3, 4) for s in range(12) for i in rng.choice(20 if q < 4 else 90, 5, replace=False)]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    obs = spark.createDataFrame(rows, "qid int, slate long, item_id long, is_anchor boolean, y double").repartition(3)
    got = designs.anchor_recovery(designs.fit_additive(obs.mapInArrow(counted, obs.schema), most=60), "is_anchor").collect()
    assert made.value == len(rows)
    named = obs.filter("is_anchor").select("qid", F.col("item_id").alias("doc_id")).distinct()
    want = {r.qid: r for r in designs.anchor_recovery(designs.fit_additive(obs, local_obs=0), named).collect()}
    assert len(got) == len(want) == 4
    for r in got:
        assert all(a == b or abs(a - b) < 1e-6 for a, b in zip(r, want[r.qid]))


def test_queries_solved_together_are_solved_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(q if q != 9 else None, s, None if i == 3 else int(i), float(rng.normal())) for q in range(10) for s in range(3 + q) for i in rng.choice(9 + 4 * q, 4, replace=False)]
    obs = spark.createDataFrame(rows, "qid int, slate long, item_id long, y double")
    fit = designs.fit_additive(obs)
    assert plan_of(fit).count("MapInArrow") == 1 and "FlatMap" not in plan_of(fit)
    for _, mine in fit.toPandas().groupby("qid", dropna=False):
        slates, slate = np.unique(mine.slate, return_inverse=True)
        item = np.unique(mine.item_id.fillna(-1), return_inverse=True)[1]
        component, l_hat, c_hat = designs.solve_additive(slate, item, mine.y.to_numpy(), 1e-11)
        assert (slates[component][slate] == mine.component).all()
        assert np.allclose(l_hat[item], mine.l_hat, atol=1e-8) and np.allclose(c_hat[slate], mine.c_hat, atol=1e-8)


def test_known_sizes_are_not_counted(spark):
    sc, pool = spark.sparkContext, candidates(spark)
    anchors = pool.filter("doc_id % 40 = 3").select("qid", "doc_id")
    sc.setJobGroup("known sizes", "")
    try:
        designs.block_design(pool, 8, 20, most=82)
        designs.anchored_design(pool, anchors, 4, 10, 20, most=82)
        anchors_of.spread_anchors(pool, 4, "l", "doc_id", most=82)
        assert not sc.statusTracker().getJobIdsForGroup("known sizes")
        designs.block_design(pool, 8, 20, most=designs.LOCAL_POOL + 1)  # too many, so they are
        assert sc.statusTracker().getJobIdsForGroup("known sizes")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_scores_that_go_with_the_candidates_are_those_that_are_joined(spark):
    pool = candidates(spark).filter("grade IS NOT NULL").withColumns({"known": F.col("grade") + F.sin("l"), "first_rank": F.col("doc_id")})
    latent = pool.select("qid", F.col("doc_id").alias("item_id"), "l")

    def score(design):
        joins.append("l" not in design.columns)
        d = design.join(latent, ["qid", "item_id"]) if joins[-1] else design
        return ex.log_softmax_rows(d.withColumn("l", F.col("grade") + F.sin("l")), "l", ["qid", "slate"], "lp").drop("l")

    joins = []
    how = dict(counts=(2, 5), free_slates=15, n_slates=9)
    near = designs.fixed_anchor_rows(pool, score, **how, keep=("l",))
    assert joins == [False] * 3 and "Join" not in plan_of(score(designs.block_design(pool, keep=("l",))))
    joined = designs.fixed_anchor_rows(pool, score, **how)
    a, b = ({(r.a, r.qid): tuple(None if v is None else round(v, 9) for v in r) for r in d.select(*near.columns).collect()} for d in (near, joined))
    assert a == b and len(a) == 22
