import math

import numpy as np
import pytest

from gradeloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k=20):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            good[i] = min(good.get(i, v), v)
    out = {}
    for q, x in good.items():
        if q % 20 == 0:
            scored = sorted(((-math.fsum(a * b for a, b in zip(x, y)), i) for i, y in good.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows):
    got = {}
    for r in ann.op7(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), 0) for i in range(60)]
    rows += [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0], 0) for i in range(100, 260)]
    rows += [(400, None, 0), (420, [0.0] * 6, 0), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (460, [float("nan")] * 6, 0), (480, [float("inf")] * 6, 0),
             (500, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (40, rows[40][1], 0)]
    want, got = brute([r for r in rows if r[0] != 500]), run(spark, rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_few_rows(spark):
    rows = [(20, [1.0, 0.0], 0), (21, [0.5, 3.0], 0), (40, [-1.0, -1.0], 0)]
    assert run(spark, rows) == {q: [(i, pytest.approx(s)) for i, s in v] for q, v in brute(rows).items()}
    assert run(spark, rows[:1]) == {} and run(spark, []) == {}


@pytest.mark.parametrize("blocks", [1, 3])
def test_recall_on_the_table(spark, monkeypatch, blocks):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    monkeypatch.setattr(ann, "BLOCK_ROWS", -(-len(rows) // blocks))
    monkeypatch.setattr(ann, "BATCH_QUERIES", 60)
    want, got = brute(rows), {}
    for r in ann.op7(table).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [i in got[q] for q, v in want.items() for i, _ in v]
    assert np.mean(hits) >= 0.95
    assert all(abs(got[q][i] - s) < 1e-12 for q, v in want.items() for i, s in v if i in got[q])


def test_pruning_and_lengths_other_than_one():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.repeat(centres, 100, 0) + rng.normal(size=(4000, 16)) * 0.2
    forest = ann.Forest(x)
    looked = []
    plain = forest._candidates
    forest._candidates = lambda lo, hi: looked.append(len(r := plain(lo, hi))) or r
    hits = []
    for i, (rows, _) in zip(range(0, 4000, 80), forest.search(x[::80], 20)):
        best = np.argsort(-(x @ x[i]))[:20]
        hits += [b in rows for b in best]
    assert np.mean(hits) > 0.9 and np.mean(looked) < 0.5 * len(x)
