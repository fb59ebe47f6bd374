import numpy as np
import pytest

from gradeloom.llm import toxicity

SCHEMA = "doc_id long, text string, toxic string"


def test_fit_recovers_a_known_model():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 3))
    w, t = np.array([1.5, -1.0, 0.5]), np.array([-0.5, 0.7, 2.0])
    above = 1 / (1 + np.exp(t - (x @ w)[:, None]))
    grade = (rng.random((6000, 1)) < above).sum(1)
    got_w, got_t = toxicity.fit_ordinal(x, grade, l2=0.01)
    assert np.abs(got_w - w).max() < 0.12 and np.abs(got_t - t).max() < 0.12 and (np.diff(got_t) > 0).all()


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.op3(docs, labels).collect()
    known = {r.doc_id: (r.toxic, r.quality) for r in labels.collect()}
    return rows, known, docs.count()


def test_accuracy_on_labels(found):
    rows, known, n = found
    assert len(rows) == n
    toxic = [r.toxic for r in rows if known.get(r.doc_id, (0, 0))[0] == 1]
    clean = [r.toxic for r in rows if known.get(r.doc_id, (1, 0))[0] == 0]
    assert np.mean(toxic) > 0.93 and np.mean(clean) < 0.003
    for r in rows:
        assert 0 <= r.severity <= 3 and r.toxic == (r.p_toxic >= 0.5) and r.toxic == (r.grade > 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels.filter("doc_id % 3 != 0"))
    rest = labels.filter("doc_id % 3 = 0").join(docs, "doc_id")
    scored = toxicity.score(rest.select("doc_id", rest.toxic.alias("label"), "text"), model).collect()
    hit = [r.toxic for r in scored if r.label == 1]
    assert np.mean(hit) > 0.88 and np.mean([r.toxic for r in scored if r.label == 0]) < 0.006


def test_severity_follows_density(spark):
    docs = [(i, f"plain words here number {i} " * 5 + "slur " * (i % 4), None) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(3, None), (9999, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(docs, SCHEMA), labels)
    hard = [(1, "plain words " * 9), (2, "plain words " * 9 + "slur"), (3, "SLUR!! " * 9), (4, None), (5, "  "), (6, "slur. " * 50_000), (3, "SLUR!! " * 9)]
    out = toxicity.score(spark.createDataFrame(hard, "doc_id long, text string"), model).collect()
    got = {r.doc_id: r.severity for r in out}
    assert len(out) == 7 and got[1] < got[2] < got[3] and got[4] == got[5] == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None), (None, "c", None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.severity for r in toxicity.op3(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.op3(docs.limit(0), none).count() == 0
