import math

from pyspark.sql import functions as F

from gradeloom.operators import retrieval, text as tx


def docs(spark):
    return spark.createDataFrame([(1, "", "The cat sat on the cat mat"), (2, "Dogs", "a dog and a cat"), (3, "x", "")], "doc_id int, title string, text string")


def test_bm25_by_hand(spark):
    q = spark.createDataFrame([(7, "cat cat the")], "qid int, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25_search(docs(spark), q, 10).collect()}
    avgdl = (4 + 2 + 0) / 3
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)

    def w(tf, dl):
        return tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))

    assert got == {1: round(2 * idf * w(2, 4), 6), 2: round(2 * idf * w(1, 2), 6)}
    n = docs(spark).agg(F.count(F.lit(1))).scalar()
    p = tx.build_postings(docs(spark))
    stored = {r.doc_id: r.score for r in retrieval.bm25_topk(p, tx.term_statistics(tx.document_frequencies(docs(spark)), n), q, 10).collect()}
    assert stored == got


def test_windows_against_brute_force(spark):
    import random
    import re

    rnd = random.Random(3)
    words = ["red", "Blue!", "green-red", "x", "y", "z", "the"]
    rows = [(i, "t", " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 5, 40, 41, 73, 120])))) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id int, title string, text string")
    q = spark.createDataFrame([(1, "red blue"), (2, "nothing"), (3, "green the")], "qid int, text string")
    weights = {"red": 1.0, "blue": 2.5, "green": 0.7, "nothing": 9.0}
    terms = spark.createDataFrame(list(weights.items()), "term string, idf double")
    pairs = q.select("qid").join(corpus.select("doc_id"), how="full", on=F.lit(True))
    got = {(r.qid, r.doc_id): r.window for r in tx.best_windows(pairs, corpus, retrieval.query_weights(q, terms)).collect()}
    asked = {1: {"red", "blue"}, 2: {"nothing"}, 3: {"green"}}
    assert len(got) == 120
    for (qid, doc), win in got.items():
        ws = re.findall(r"\S+", rows[doc][2])
        hit = [max((weights[t] for t in re.findall("[a-z0-9]+", w.lower()) if t in asked[qid]), default=0.0) for w in ws]
        best, at = 0.0, 0
        for i in range(0, max(1, len(ws) - 39), 10):
            v = round(sum(hit[i:i + 40]), 9)
            if v > best:
                best, at = v, i
        if len(ws) <= 40:
            at = 0
        assert win == " ".join(ws[at:at + 40]), (qid, doc)


def test_cut_and_signatures(spark):
    d = docs(spark).withColumn("window", F.lit("best words here"))
    got = {r.doc_id: r for r in d.select("doc_id", tx.signature("title", 2).alias("t"), tx.signature("head", 5).alias("h"), tx.signature("title+lexical", 8).alias("w")).collect()}
    assert got[1].t == "The cat" and got[2].t == "Dogs" and got[2].h == "Dogs. a dog and a ca" and got[1].h == "The cat sat on the c"
    assert got[2].w == "Dogs best words here" and got[1].w == "best words here"
    exact = tx.cut_exact(lambda s: len(s))
    assert d.filter("doc_id = 2").select(exact("text", F.lit(4)).alias("c")).first().c == "a do"


def test_balanced_probes(spark):
    pool = spark.createDataFrame([(q, i, i, (i % 3) if q == 1 else 0) for q in (1, 2) for i in range(30)], "qid int, doc_id int, rank int, grade int")
    got = retrieval.balanced_probes(pool, 4, 2, 8).collect()
    assert {r.qid for r in got} == {1} and len(got) == 12 and max(r.rank for r in got) == 11


def test_terms_are_placed_where_their_document_lies(spark):
    import re

    rows = [(1, None), (2, ""), (3, " \t"), (4, "A-b c1 d\x0bfoo-foo the FOO"), (5, "été xéy z q"), (6, "tail"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = spark.createDataFrame([(w,) for w in ("a", "b", "c1", "foo", "x", "z", "tail", "the")], "term string")
    want = set()
    for doc, text in rows:
        found, parts = {}, re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
        kept = [(i, t) for i, w in enumerate(parts) for t in re.findall("[a-z0-9]+", w.lower()) if t not in tx.STOPWORDS]
        for i, t in kept:
            found.setdefault(t, []).append(i)
        size = (None, None) if text is None else (len(kept), len(parts))
        want |= {(doc, *size, t, len(p), tuple(p)) for t, p in found.items() if t in {"b", "c1", "foo", "x", "z", "tail"}} | {(doc, *size, None, 0, None)}
    hits = tx.positional_hits(docs, words)
    assert {(*r[:5], r[5] and tuple(r[5])) for r in hits.collect()} == want
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


def test_best_k_is_that_of_all_pairs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 40, int(rng.integers(0, 12)))) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(f"w{w}" for w in rng.integers(0, 45, 5))) for q in range(9)], "qid long, text string")
    monkeypatch.setattr(retrieval, "SCORES", 64)
    got = sorted(map(tuple, retrieval.bm25_search(docs, queries, 7).collect()))
    assert "scored_in_tasks" in dir(retrieval) and len(got) == 63
    monkeypatch.setattr(retrieval, "FEW", 0)  # more queries than are sent to the postings
    assert got == sorted(map(tuple, retrieval.bm25_search(docs, queries, 7).collect()))
