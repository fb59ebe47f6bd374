import math

import numpy as np
from pyspark.sql import functions as F

from gradeloom.functions import expr as ex
from gradeloom.operators import calibration as cal
from gradeloom.plans import catalog
from gradeloom.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_made_once_a_row(spark):
    """A filter on the bins must not make the logits' draws again for every element of the softmax."""
    assert plan(catalog.QUERIES["reliability_curve"](spark, SF)).count("md5(") <= 2
    assert plan(Tables(spark, SF).labelled.filter(F.array_max("probs") > 0.5)).count("md5(") <= 2


def test_softmax_takes_its_argument_once(spark):
    made = spark.range(3).select(ex.softmax(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ex.uniform(1, "id", i))).alias("p"))
    assert plan(made).count("md5(") == 1
    for r in made.collect():
        assert math.isclose(sum(r.p), 1.0)
    empty = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],)], "a array<double>").select(ex.softmax("a").alias("p")).collect()
    assert [r.p for r in empty] == [None, [], [0.5, 0.5]]


def brute(rows, loss, lo, hi):
    """The narrowing grid of one group, value by value."""
    for _ in range(6):
        step = (hi / lo) ** (1 / 23)
        grid = [lo * step**i for i in range(24)]
        nll = [sum(loss(x, y, t) for x, y in rows) for t in grid]
        t = grid[int(np.argmin(np.round(nll, 12)))]
        lo, hi = max(t / step, lo), min(t * step, hi)
    return math.sqrt(lo * hi)


def nll(x, y, t):
    return math.log(sum(math.exp((v - max(x)) / t) for v in x)) - (x[y] - max(x)) / t


def test_search_sums_in_tasks_and_moves_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"g{k % 3}", rng.normal(size=2 + k % 4).tolist(), k % 2) for k in range(90)]
    odd = [("g0", None, 0), ("g0", [1.0, 2.0], 7), ("g0", [1.0, None], 0), ("g0", [], 0), ("g1", [1.0, 2.0], None), ("none", None, 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "b string, logits array<double>, label int").repartition(5)
    seen, real = [], cal._loss_sums
    monkeypatch.setattr(cal, "_loss_sums", lambda r, *rest: seen.append(r) or real(r, *rest))
    got = {r.b: r for r in cal.fit_temperature(df, ["b"], total="all").collect()}
    for r in seen:  # brackets are sent to the rows
        assert "BroadcastHashJoin" in r._jdf.queryExecution().executedPlan().toString()
    for name in ("g0", "g1", "g2"):
        assert math.isclose(got[name].t, brute([(x, y) for g, x, y in rows if g == name], nll, 0.02, 10.0), rel_tol=1e-6)
    assert math.isclose(got["all"].t, brute([(x, y) for _, x, y in rows], nll, 0.02, 10.0), rel_tol=1e-6)
    assert [got[n].n for n in ("g0", "g1", "g2", "none", "all")] == [34, 31, 30, 1, 96]
    assert got["none"].nll is None


def test_binary_search(spark):
    rng = np.random.default_rng(4)
    p = rng.random(200)
    y = (rng.random(200) < p).astype(int)
    df = spark.createDataFrame([("s", float(a), int(b)) for a, b in zip(p, y)] + [("s", 0.5, None)], "system string, prob double, relevant int")
    got = cal.fit_binary_temperature(df, ["system"]).first()
    loss = lambda z, w, t: max(z / t, 0) + math.log1p(math.exp(-abs(z / t))) - w * z / t
    assert math.isclose(got.t, brute([(math.log(a / (1 - a)), b) for a, b in zip(p, y)], loss, 0.05, 20.0), rel_tol=1e-5) and got.n == 201
