"""Pruned search, positional windows, salted lookups and the fits of designs against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import joins
from gradeloom.operators import designs, retrieval, text as tx


def corpus_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("title", F.lit(""))


def brute_topk(texts, queries, k):
    docs = [[w for w in t.lower().split() if w not in tx.STOPWORDS] for t in texts]
    avgdl, n = sum(map(len, docs)) / len(docs), len(docs)
    out = {}
    for qid, q in queries:
        scored = []
        for i, d in enumerate(docs):
            s = 0.0
            for w in q.split():
                df, tf = sum(w in x for x in docs), d.count(w)
                if tf:
                    s += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(d) / avgdl))
            if s:
                scored.append((-round(s, 6), i))
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


def zipf_texts(rng, n):
    """Few words are everywhere, most are rare."""
    words = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) ** 1.2 for i in range(2000)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(5, 60))) for _ in range(n)]


@pytest.mark.parametrize("lead", [1, 10, 10**6])
def test_pruned_search_equals_scoring_everything(spark, lead):
    rng = random.Random(4)
    texts = zipf_texts(rng, 300) + ["", "w0 w0 w0"]
    queries = [(q, " ".join(rng.sample(texts[q].split(), min(4, len(texts[q].split())))) + " w0 w1 w2 w3") for q in range(12)] + [(99, "w0"), (100, "nowhere")]
    corpus = corpus_of(spark, texts)
    postings = tx.build_postings(corpus)
    known = retrieval.term_bounds(postings).withColumn("idf", tx.idf(F.lit(len(texts)), F.col("df")))
    asked = retrieval.query_terms(spark.createDataFrame(queries, "qid int, text string")).join(known, "term")
    got = {}
    for r in retrieval.pruned_topk(postings, asked, 5, lead)["ranked"].orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    want = {q: d for q, d in brute_topk(texts, queries, 5).items() if d}
    assert got == want


def test_frequent_words_alone_form_no_pairs(spark):
    rng = random.Random(1)
    texts = zipf_texts(rng, 1500)
    queries = [(q, " ".join([*rng.sample([w for w in texts[q].split() if int(w[1:]) > 100] or ["w500"], 1), "w0", "w1", "w2"])) for q in range(20)]
    postings = tx.build_postings(corpus_of(spark, texts))
    known = retrieval.term_bounds(postings).withColumn("idf", tx.idf(F.lit(len(texts)), F.col("df")))
    asked = retrieval.query_terms(spark.createDataFrame(queries, "qid int, text string")).join(known, "term").cache()
    matching = postings.join(asked.select("qid", "term"), "term").select("qid", "doc_id").distinct().count()
    found = retrieval.pruned_topk(postings, asked, 3)
    assert found["pairs"].count() < matching / 2 and found["open"].count() <= found["pairs"].count()


def test_windows_from_a_given_index_and_hot_documents(spark, monkeypatch):
    monkeypatch.setattr(tx, "PER_TEXT", 2)
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=n)) for n in (200, 40, 41, 3)] + ["", "w1-w2, w3!"]
    corpus = corpus_of(spark, texts)
    queries = [(q, f"w{q} w{q + 1} w{q + 2}") for q in range(9)]
    weights = spark.createDataFrame([(q, f"w{q + j}", 1.0 + j) for q in range(9) for j in range(3)], "qid int, term string, weight double")
    pairs = spark.createDataFrame([(q, d) for q, _ in queries for d in range(len(texts))], "qid int, doc_id long")
    made = {(r.qid, r.doc_id): r.window for r in tx.best_windows(pairs, corpus, weights).collect()}
    index = tx.positional_hits(corpus, weights)
    given = {(r.qid, r.doc_id): r.window for r in tx.best_windows(pairs, corpus, weights, index=index).collect()}
    assert made == given and len(made) == 9 * len(texts)
    for (q, d), window in made.items():
        words = texts[d].split()
        mass = [sum(max([1.0 + int(t[1:]) - q for t in w.replace("!", "").replace(",", "").split("-") if 0 <= int(t[1:]) - q < 3], default=0.0) for w in words[i:i + 40])
                for i in range(0, max(len(words) - 40, 0) + 1, 10)]
        at = 10 * mass.index(max(mass)) if len(words) > 40 and max(mass) > 0 else 0
        assert window == " ".join(words[at:at + 40])


def test_lookup_of_a_large_table_is_salted(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 0)
    rows = spark.createDataFrame([(i, "the" if i % 3 else f"t{i}") for i in range(200)], "doc_id int, term string")
    stems = rows.select("term").distinct().withColumn("stem", F.upper("term"))
    got = joins.lookup(rows, stems, "term", "doc_id")
    assert got.count() == 200 and got.filter(F.col("stem") != F.upper("term")).count() == 0


def test_large_queries_are_fitted_over_their_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(q, s, int(i), float(np.round(rng.normal(), 3))) for q in (1, 2) for s in range(8) for i in rng.choice(12 if q == 1 else 40, 4, replace=False)]
    obs = spark.createDataFrame(rows, "qid int, slate long, item_id long, y double")
    near = designs.fit_additive(obs)
    wide = designs.fit_additive(obs, local_obs=0)
    key = lambda d: {(r.qid, r.slate, r.item_id): r for r in d.collect()}
    a, b = key(near), key(wide)
    assert a.keys() == b.keys() and near.columns == wide.columns
    for k in a:
        assert a[k].component == b[k].component
        assert np.allclose([a[k].l_hat, a[k].c_hat, a[k].residual], [b[k].l_hat, b[k].c_hat, b[k].residual], atol=1e-7)


@pytest.mark.parametrize("by", designs.ANCHORS_BY)
def test_fixed_anchors_put_slates_on_one_scale(spark, by):
    rng = np.random.default_rng(2)
    rows = [(q, i, g, float(g + rng.normal(0, 0.2)), i, float(g * 1.5 + rng.normal(0, 0.2))) for q in (1, 2) for i, g in enumerate(rng.integers(0, 4, 45).tolist())]
    pool = spark.createDataFrame(rows, "qid int, doc_id long, grade int, known double, first_rank long, l double")
    latent = pool.select("qid", F.col("doc_id").alias("item_id"), "l")

    def score(design):
        from gradeloom.functions import expr as ex

        return ex.log_softmax_rows(design.join(latent, ["qid", "item_id"]), "l", ["qid", "slate"], "lp").drop("l")

    got = designs.fixed_anchor_rows(pool, score, (2, 4, 9), by=by, free_slates=20, n_slates=15).collect()
    assert sorted((r.a, r.qid) for r in got) == [(2, 1), (2, 2), (4, 1), (4, 2)]  # nine anchors leave one place
    for r in got:
        assert r.r_anchored > r.r_naive and r.distinct_anchor_utilities == r.a and 0.2 < r.slope_prior < 2
    with pytest.raises(ValueError, match="anchors are spread"):
        designs.fixed_anchor_rows(pool, score, by="nothing")
