"""Regret by thinned pools equals the whole computation, however the pool lies."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import draws
from gradeloom.operators import regret as rg


def words(seed, qid, item):
    h = hashlib.md5(f"{seed}|{qid}|{item}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


def plain_normal(seed, qid, item, draw):
    units = []
    for word, factor in zip(words(seed, qid, item), draws.DRAW):
        x = (word + draw * factor) % 2**32
        for shift, m in zip((16, 15), draws.MIX):
            x = (x ^ (x >> shift)) * m % 2**32
        units.append(((x ^ (x >> 16)) + 0.5) / 2**32)
    return np.sqrt(-2 * np.log(units[0])) * np.cos(2 * np.pi * units[1])


def brute(rows, k, samples, seed, scaled, clip):
    """rows: (qid, item, utility, sigma) of one query"""
    u = [r[2] for r in rows]
    lo, hi = (max(e, 0.0) if clip else e for e in (min(u), max(u)))
    total = 0.0
    for d in range(samples):
        def gain(r):
            x = r[2] + r[3] * plain_normal(seed, r[0], r[1], d)
            x = lo + (x - min(u)) / max(max(u) - min(u), 1e-9) * max(hi - lo, 1e-9) if scaled else max(x, 0.0)
            return 2**x - 1

        dcg = lambda order: sum(gain(r) / np.log2(i + 2) for i, r in enumerate(order[:k]))
        ideal = dcg(sorted(rows, key=gain, reverse=True))
        ships = dcg(sorted(rows, key=lambda r: (-r[2], r[1])))
        total += max((ideal - ships) / ideal, 0.0) if ideal > 0 else 0.0
    return total / samples


def test_normals_are_normal_and_match_the_plain_ones():
    w = np.array([words(3, "q", i) for i in range(400)])
    x = draws.normals(w, 256)
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.15
    assert np.allclose([x[5, 7], x[399, 255]], [plain_normal(3, "q", 5, 7), plain_normal(3, "q", 399, 255)])


@pytest.mark.parametrize(("scale", "clip"), [("utility", True), ("utility", False), (None, True)])
def test_pools_of_many_parts_match_brute_force(spark, monkeypatch, scale, clip):
    monkeypatch.setattr(rg, "BLOCK", 8)
    rng = np.random.default_rng(0)
    rows = [(q, i, float(np.round(rng.normal(), 1)), float(rng.choice([0.0, 0.2, 1.0]))) for q, n in ((1, 300), (2, 3), (3, 1), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "qid int, item_id long, utility double, sigma double").repartition(5)
    got = {r.qid: r.regret for r in rg.expected_regret(df, 3, 6, seed=9, scale=scale, clip=clip).collect()}
    want = {q: brute([r for r in rows if r[0] == q], 3, 6, 9, scale is not None, clip) for q in (1, 2, 3, 4)}
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-9 for q in want)


def test_thinning_keeps_what_counts():
    rng = np.random.default_rng(2)
    n, k, samples = 3000, 5, 20
    pool = object.__new__(rg._Pool)
    pool.u, pool.s, pool.ids, pool.words = np.round(rng.normal(size=n), 2), rng.random(n), np.arange(n), rng.integers(0, 2**32, (n, 2))
    pool.scale = rng.normal(size=n)
    want = pool.regret(k, samples, True, True)
    left = pool.take(pool.needed(k, samples))
    assert len(left) <= k * (samples + 1) + 4 and left.regret(k, samples, True, True) == want
    halves = [pool.take(np.arange(0, 1400)), pool.take(np.arange(1400, n))]
    both = halves[0].take(halves[0].needed(k, samples)).plus(halves[1].take(halves[1].needed(k, samples)))
    assert both.regret(k, samples, True, True) == want


def test_a_million_candidates_in_one_pool(spark):
    big = spark.range(1_000_000).select(F.lit("hot").alias("qid"), F.col("id").alias("item_id"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000.0).alias("utility"), F.lit(0.3).alias("sigma"))
    small = spark.range(50).select(F.lit(None).cast("string").alias("qid"), F.col("id").alias("item_id"), (F.col("id") / 50).alias("utility"), F.lit(0.1).alias("sigma"))
    got = {r.qid: r.regret for r in rg.expected_regret(big.union(small), 10, 256).collect()}
    assert set(got) == {"hot", None} and 0.1 < got["hot"] < 1 and 0 < got[None] < 1


def test_carried_columns_and_rows_without_values(spark):
    rows = [(1, i, float(i), 0.5 if i % 2 else None, i % 3) for i in range(60)] + [(2, 0, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "qid int, item_id int, utility double, sigma double, round int")
    got = rg.expected_regret(df, 5, 16, carry=["round"])
    assert got.columns == ["qid", "round", "regret"] and sorted((r.qid, r["round"]) for r in got.collect()) == [(1, 0), (1, 1), (1, 2)]
    assert rg.expected_regret(df.limit(0)).count() == 0
