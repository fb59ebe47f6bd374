import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import pii


def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "9", "0", "255", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "4111111111111111", "é", "@x.y", "1.2.3.4", "%", "\n"]), max_size=40).map("".join))
def test_base_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


HARD = [None, "", "a@b.c@d.e.f", "@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000000001.2.3.4", "4111 1111-1111 1111", "+1 (603) 555-8791.", "tie a@b.cc", "tie a@b.cc",
        "1" * 60_000, "a" * 60_000 + "@b.cc", "9.9 " * 20_000, "@" * 20_000, "+1" + "(" * 30_000, "1-" * 20_000]


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_hard_texts(spark, model):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, spans string")
    got = {r.doc_id or 0: r for r in pii.find(docs, model).collect()}
    for i, t in enumerate(HARD):
        base = brute_base(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    assert pii.op1(docs.limit(0)).count() == 0


def test_trees_match_the_fitted_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(float(a[0] * a[1] > 0), a.tolist()) for a in x], "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    fitted = GBTClassifier(maxIter=5, maxDepth=pii.DEPTH, seed=1).fit(rows)
    mine = pii.Trees([pii._arrays(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights)).score(x)
    assert np.allclose(mine, [r.probability[1] for r in fitted.transform(rows).collect()])


def test_other_spellings_are_found_and_clean_numbers_left(model):
    found = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in model.find(t)[1]]
    assert found("write to jane.doe(at)mail(dot)example(dot)com today") == [("email", "jane.doe(at)mail(dot)example(dot)com")]
    assert found("the host 10[.]20[.]30[.]40 was") == [("ip", "10[.]20[.]30[.]40")]
    assert ("card", "4111.1111.1111.1111") in found("paid by 4111.1111.1111.1111 then")
    assert found("in 2019 there were 12345678 cases on 2020-01-31") == []
    assert found("they met at the house and dot the i") == []


def test_whole_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.op1(docs).collect()}
    extra = 0
    for d in docs.collect():
        base = brute_base(d.text)
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = list(filter(None, rows[d.doc_id].spans.split(",")))
        assert set(listed) <= set(spans)
        extra += len(spans) - len(listed)
    assert extra <= 5


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "mail a@b.cc or +1 (603) 555-8791, card 4111 1111 1111 1111", 0), (2, None, 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert out[1].text == "mail [EMAIL] or [PHONE], card [CARD]" and out[1].n_chars == len(out[1].text) and out[2].text is None


def test_all_documents_are_learned_from(spark):
    """Candidates of one form are one row, whose weight counts them in every document."""
    docs = spark.createDataFrame([(i, f"write to user{i % 7}@mail.example.com or 10.20.30.{i % 10}") for i in range(9_000)], "doc_id long, text string")
    rows = pii.training_rows(docs.repartition(3)).collect()
    real = [r for r in rows if r.label == 1 and (r.x[0] or r.x[1]) and not r.x[pii.FEATURES.index("hidden_at")] and not r.x[pii.FEATURES.index("brackets")] and not r.x[pii.FEATURES.index("parens")]]
    assert sum(r.n for r in real) == 18_000 and len(rows) < 200


def test_thresholds_count_every_candidate(spark):
    half = (np.array([0, -1, -1]), np.array([0.5, 0.0, 0.0]), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, -1.0, 2.0]))
    model = pii.Trees([half], [1.0])
    rows = [(1, 1.0, [1.0], 990), (1, 0.0, [1.0], 10), (1, 0.0, [0.0], 500), (2, 1.0, [1.0], 989), (2, 0.0, [1.0], 11), (3, 1.0, [1.0], 9)]
    df = spark.createDataFrame(rows, "kind int, label double, x array<double>, n long")
    assert list(pii.calibrated(df, model)) == [1]
