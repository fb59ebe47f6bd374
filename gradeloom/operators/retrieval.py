"""First-stage retrieval: BM25 top-k for every query at once, pools, probes, validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.joins import FEW, few
from ..functions.lineage import cut_lineage
from ..sources.collections import full_text
from . import text as tx
from .evaluation import ndcg


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf): a repeated query term counts as often as it is repeated."""
    return tx.term_counts(queries, "qid", n="qtf")


SCORE_DIGITS = 6  # sums come in any order; rounding keeps equal scores equal


def term_bounds(postings: DataFrame) -> DataFrame:
    """(term, df, top): in how many documents a term is, and the largest weight it has in one."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top"))


def bm25_topk(postings: DataFrame, terms: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """Score stored postings: (qid, doc_id, score, rank), matches only, ties by doc_id.

    ``terms`` is (term, idf) and, where the index keeps them, (df, top) of :func:`term_bounds`.
    """
    known = terms if {"df", "top"} <= set(terms.columns) else terms.select("term", "idf").join(term_bounds(postings), "term")
    return best_k(postings, query_terms(queries).join(known, "term"), k)


#: Scores that a task holds at once: documents times queries.
SCORES = 1 << 21


def best_k(postings: DataFrame, asked: DataFrame, k: int = 100) -> DataFrame:
    """The best k of every query from ``postings`` (term, doc_id, w) and ``asked`` (qid, term, qtf, idf, df, top).

    The terms of few queries go to the postings, which meet by document; of more queries,
    :func:`pruned_topk` forms the pairs as rows.
    """
    asked = cut_lineage(asked)
    queries, rows = asked.agg(F.count_distinct("qid"), F.count(F.lit(1))).first()
    if rows > FEW or queries * max(k, 1) > FEW:
        return pruned_topk(postings, asked, k)["ranked"]
    return scored_in_tasks(postings, asked, k)


def scored_in_tasks(postings: DataFrame, asked: DataFrame, k: int = 100) -> DataFrame:
    """:func:`best_k` for few queries: every pair that shares a term is scored where its document's
    postings lie, as a sum of vectors, and a task hands on its best k of a query only."""
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((asked, "qid"), (postings, "doc_id"))}
    told = asked.select("qid", "term", (F.col("idf") * F.col("qtf")).alias("gain")).orderBy("term").toArrow().combine_chunks()
    if not told.num_rows:
        return top_k(asked.sparkSession.createDataFrame([], f"qid {types['qid']}, doc_id {types['doc_id']}, score double"), k)
    qids, terms = (told[c].combine_chunks().dictionary_encode() for c in ("qid", "term"))
    names, first = terms.dictionary, np.r_[0, np.cumsum(np.bincount(terms.indices.to_numpy()))]
    known = asked.sparkSession.sparkContext.broadcast((names, first, qids.dictionary, qids.indices.to_numpy().astype(np.int64), told["gain"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, ids, query, gain = known.value
        n, best = len(ids), None  # best: (query, rounded score, document, score) of the first k so far

        def added(part: pa.Table) -> None:
            """``part`` holds whole documents, sorted."""
            nonlocal best
            part = part.combine_chunks()
            doc = part["doc_id"].combine_chunks().dictionary_encode()
            term = pc.index_in(part["term"], names).combine_chunks().to_numpy()
            many = first[term + 1] - first[term]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[term], many)
            row, weight = np.repeat(doc.indices.to_numpy().astype(np.int64), many), np.repeat(part["w"].to_numpy(), many)
            docs, step = doc.dictionary.to_numpy(zero_copy_only=False), max(1, SCORES // n)
            edges = np.searchsorted(row, np.arange(0, len(docs) + step, step))
            for lo, a, b in zip(range(0, len(docs), step), edges, edges[1:]):
                size = min(step, len(docs) - lo)
                score = np.bincount((row[a:b] - lo) * n + query[at[a:b]], weight[a:b] * gain[at[a:b]], size * n).reshape(size, n)
                near = np.floor(score * 10.0**SCORE_DIGITS + 0.5)
                floor = np.partition(near, size - k, 0)[size - k] if size > k else np.zeros(n)
                d, q = np.nonzero((score > 0) & (near >= floor))
                new = (q, near[d, q], docs[lo + d], score[d, q])
                new = new if best is None else tuple(map(np.concatenate, zip(best, new)))
                order = np.lexsort((new[2], -new[1], new[0]))
                q = new[0][order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = tuple(x[order[place < k]] for x in new)

        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < 1 << 18:
                continue
            got = pa.concat_tables(held).combine_chunks()
            last = pc.index(got["doc_id"], got["doc_id"][-1]).as_py()  # its document may go on in the next batch
            if last:
                added(got.slice(0, last))
            held = [got.slice(last)]
            size = held[0].num_rows
        if held and size:
            added(pa.concat_tables(held))
        if best is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), pa.array(best[2]), pa.array(best[3], pa.float64())], ["qid", "doc_id", "score"])

    met = postings.select("term", "doc_id", "w").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    met = met.repartition("doc_id").sortWithinPartitions("doc_id")
    found = met.mapInArrow(run, f"qid {types['qid']}, doc_id {types['doc_id']}, score double")
    return top_k(found.withColumn("score", F.round("score", SCORE_DIGITS)), k)


LEAD = 10  # the first guess reads a query's strongest terms until they name this many times k documents
SLACK = 1e-5  # bounds are sums of doubles, scores are rounded: a score this close to a bound is kept


def pruned_topk(postings: DataFrame, asked: DataFrame, k: int = 100, lead: int = LEAD) -> dict[str, DataFrame]:
    """The best k of every query without forming the pairs that cannot be among them.

    ``postings`` is (term, doc_id, w), ``asked`` (qid, term, qtf, idf, df, top). A term adds at
    most ``top * idf * qtf`` to a score. (1) A query's strongest terms propose k documents, whose
    whole scores say how good the k-th best is at least (``floor``). (2) Its weakest terms, as many as
    together stay below that, cannot carry a document alone: only the postings of the others form
    pairs. (3) Pairs that stay below the floor even with all weak terms go, and the rest is completed.
    Frequent terms are the weak ones, so their postings meet only documents already chosen, by
    (document, term), and no join runs on a frequent term alone.

    Returns ``ranked`` and, for reports, ``pairs`` (formed) and ``open`` (left after the bound).
    """
    by_bound = Window.partitionBy("qid").orderBy(F.desc("most"), "term")  # the terms of one query
    terms = asked.select("qid", "term", "df", (F.col("idf") * F.col("qtf")).alias("gain"), (F.col("idf") * F.col("qtf") * F.col("top")).alias("most"))
    terms = cut_lineage(terms.select(
        "*", F.coalesce(F.sum("df").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("most").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest")))

    def met(some: DataFrame) -> DataFrame:
        """(qid, doc_id, score) from the postings of some terms."""
        return postings.select("term", "doc_id", "w").join(some.select("qid", "term", "gain"), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("gain")).alias("score"))

    def completed(pairs: DataFrame, some: DataFrame) -> DataFrame:
        """(qid, doc_id, score): what some terms add to chosen pairs."""
        wanted = pairs.select("qid", "doc_id").join(some.select("qid", "term", "gain"), "qid")
        return wanted.join(postings.select("term", "doc_id", "w"), ["doc_id", "term"]).groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("gain")).alias("score"))

    guessed = top_k(met(terms.filter(F.col("before") < lead * k)), k).select("qid", "doc_id")
    floor = completed(guessed, terms).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floor = floor.filter(F.col("n") >= k).select("qid", (F.col("floor") - SLACK).alias("floor"))
    terms = cut_lineage(terms.join(floor, "qid", "left").withColumn("strong", F.col("floor").isNull() | (F.col("rest") >= F.col("floor"))))
    strong, weak = terms.filter("strong"), terms.filter("NOT strong")
    limits = terms.groupBy("qid").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("strong"), F.col("most"))), F.lit(0.0)).alias("weak"))
    pairs = met(strong)
    chosen = cut_lineage(pairs.join(limits, "qid").filter(F.col("floor").isNull() | (F.col("score") + F.col("weak") >= F.col("floor"))).select("qid", "doc_id", "score"))
    scored = chosen.unionByName(completed(chosen, weak)).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score"))
    return {"ranked": top_k(scored, k), "pairs": pairs, "open": chosen}


def bm25_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 100,
    text: Column | str = "text",
    k1: float = tx.K1,
    b: float = tx.B,
) -> DataFrame:
    """:func:`search`, the ranking only."""
    return search(corpus, queries, k, text, k1, b)[0]


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 100,
    text: Column | str = "text",
    k1: float = tx.K1,
    b: float = tx.B,
) -> tuple[DataFrame, DataFrame]:
    """Search without a stored index: one pass over the texts, which counts the query vocabulary's
    terms where they lie. Returns the ranking and the query terms' idf.

    How the weighted query terms meet them is left to Spark's byte threshold and AQE.
    """
    placed = tx.positional_hits(corpus, query_terms(queries), text)
    return search_hits(cut_lineage(placed.select("doc_id", "dl", "term", "tf")), queries, k, k1, b)


def search_hits(hits: DataFrame, queries: DataFrame, k: int = 100, k1: float = tx.K1, b: float = tx.B) -> tuple[DataFrame, DataFrame]:
    """:func:`search` over rows (doc_id, dl, term, tf) that were made before.

    Besides the terms every document has one row with a NULL term; :func:`text.positional_hits`
    gives such rows.
    """
    totals = hits.filter(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    n_docs, avgdl = totals.select("n_docs").scalar(), totals.select("avgdl").scalar()
    weight = tx.doc_weight(F.col("tf"), F.col("dl"), avgdl, k1, b)
    weighted = hits.filter(F.col("term").isNotNull()).select("doc_id", "term", weight.alias("w"))
    known = cut_lineage(term_bounds(weighted).withColumn("idf", tx.idf(n_docs, F.col("df"))))
    return best_k(weighted, query_terms(queries).join(known, "term"), k), known.select("term", "idf")


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best k per query. ``rank <= k`` is pushed below the shuffle as a group limit."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def query_terms_present(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct query terms known to the index (a ``term`` column), in alphabetical order."""
    return (
        query_terms(queries)
        .join(vocabulary.select("term").distinct(), "term", "left_semi")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_set("term")).alias("terms"))
    )


def query_weights(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(qid, term, weight): a query's distinct terms with their idf (1.0 without an index)."""
    asked = query_terms(queries).select("qid", "term")
    if terms is None:
        return asked.withColumn("weight", F.lit(1.0))
    return asked.join(terms.select("term", F.col("idf").alias("weight")), "term")


def with_signature_recall(
    pairs: DataFrame, corpus: DataFrame, queries: DataFrame, sig: str = "signature", index: DataFrame | None = None
) -> DataFrame:
    """Add ``recall`` to (qid, doc_id, signature) rows: :func:`text.signature_recall` as a job.

    Which query terms a document holds is read from ``index`` (rows (doc_id, term), as a search
    makes them); without one the documents named are tokenised once. Per pair only the query's
    own terms found in the document are kept (a list no longer than the query).
    """
    keys = pairs.select("qid", "doc_id").distinct()
    terms = query_terms(queries).select("qid", "term")
    if index is None:
        named = corpus.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
        found = named.select("doc_id", F.explode(F.array_distinct(tx.raw_tokens("text"))).alias("term"))
        index = found.join(terms.select("term").distinct(), "term", "left_semi")  # only the queries' words travel
    in_doc = (
        index.filter("term IS NOT NULL").select("doc_id", "term").join(terms.join(keys, "qid"), ["doc_id", "term"])
        .groupBy("qid", "doc_id")
        .agg(F.collect_set("term").alias("_in"))
    )
    kept = F.size(F.array_intersect("_in", tx.raw_tokens(sig))).cast("double")
    return (
        pairs.join(in_doc, ["qid", "doc_id"], "left")
        .withColumn("recall", F.coalesce(F.try_divide(kept, F.size("_in")), F.lit(1.0)))
        .drop("_in")
    )


def candidate_pools(
    ranked: DataFrame, qrels: DataFrame, corpus: DataFrame, k: int = 100, threshold: int = 1, chars: int = 2000
) -> DataFrame:
    """First-stage pools with grades and the documents' opening text.

    Queries with fewer than k candidates or without a candidate graded at or above the
    threshold are left out as a whole. Pools hold at most k rows, so the per-query window
    is bounded.
    """
    graded = ranked.join(qrels.select("qid", "doc_id", "grade"), ["qid", "doc_id"], "left").withColumn(
        "grade", F.coalesce("grade", F.lit(0))
    )
    w = Window.partitionBy("qid")
    kept = (
        graded.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_top", F.max("grade").over(w))
        .filter((F.col("_n") >= k) & (F.col("_top") >= threshold))
        .drop("_n", "_top")
    )
    kept = cut_lineage(kept)
    wanted = few(kept.select("doc_id").distinct())  # only the pools' documents give a passage
    docs = corpus.join(wanted, "doc_id", "left_semi").select("doc_id", F.substring(full_text(), 1, chars).alias("passage"))
    return kept.join(docs, "doc_id")


def balanced_probes(
    pool: DataFrame, per_grade: int = 12, min_grades: int = 2, min_probes: int = 8, rank: str = "rank"
) -> DataFrame:
    """First n candidates of every (query, grade) in first-stage order."""
    w = Window.partitionBy("qid", "grade").orderBy(rank)
    picked = pool.withColumn("probe", F.row_number().over(w).cast("bigint")).filter(F.col("probe") <= per_grade)
    fit = picked.groupBy("qid").agg(
        F.count_distinct("grade").alias("_g"), F.count(F.lit(1)).alias("_n")
    ).filter((F.col("_g") >= min_grades) & (F.col("_n") >= min_probes))
    return picked.join(fit.select("qid"), "qid", "left_semi")


# fixed values: published BM25 nDCG@10 of public test collections
PUBLISHED = {"trec-covid": 0.656, "nfcorpus": 0.325, "scifact": 0.665}


def published_figures(spark: SparkSession, figures: dict[str, float] | None = None) -> DataFrame:
    """(dataset, published): the figures that a first stage is held against."""
    rows = ex.inline_rows([{"dataset": d, "published": v} for d, v in (figures or PUBLISHED).items()], {"dataset": "string", "published": "double"})
    return spark.range(1).select(F.inline(rows))


def first_stage_check(ranked: DataFrame, qrels: DataFrame, datasets: DataFrame, published: DataFrame, k: int = 10) -> DataFrame:
    """Per data set: mean nDCG@k next to its published figure; the ideal uses every judged document.

    ``datasets`` is (qid, dataset). A data set without a figure has NULL in its place.
    """
    per_query = ndcg(ranked, qrels, k=k).join(datasets, "qid")
    got = per_query.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("ndcg").alias("ndcg"))
    return got.join(published, "dataset", "left").withColumn("delta", F.col("ndcg") - F.col("published"))
