"""Registered queries: sources, text, retrieval and evidence."""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.lineage import cut_lineage
from ..operators import evaluation, evidence, retrieval, text as tx
from ..sources import collections as col, ledger, typed_json
from . import sql as q
from .metric_queries import weights_sql
from .registry import cte, query
from .slate_queries import design_cte


@query("typed_examples_parse", """SELECT ex_id, CASE kind WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS qtype,
CASE kind WHEN 1 THEN '{"text":"'||body||'","turn":'||turn||'}' ELSE body END AS state,
CASE kind WHEN 0 THEN 'user,assistant,system' WHEN 1 THEN CASE WHEN bad THEN '0,1,2,3,4,5,6,7,8,9,10' ELSE 'tiny,short,medium,long' END ELSE 'false,true' END AS option_keys,
CASE kind WHEN 0 THEN CASE WHEN bad THEN 'moderator' ELSE role END
 WHEN 1 THEN CASE WHEN length(body)<50 THEN '0' WHEN length(body)<200 THEN '1' WHEN length(body)<600 THEN '2' ELSE '3' END
 ELSE CASE WHEN bad THEN NULL WHEN role='assistant' THEN 'true' ELSE 'false' END END AS label_text,
CASE WHEN kind=2 AND bad THEN NULL WHEN kind=0 THEN 'name' WHEN kind=1 THEN 'index' ELSE 'flag' END AS label_kind,
CASE kind WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, CASE kind WHEN 1 THEN conv_id::VARCHAR END AS conv FROM typed_src""")
def typed_examples_parse(t):
    p = typed_json.parse_typed_lines(t.typed_lines)
    return p.select(
        "ex_id", "qtype", "state", F.array_join("option_keys", ",").alias("option_keys"), "label_text", "label_kind", "weight",
        F.element_at("meta", F.lit("conv")).alias("conv"),
    )


@query("corpus_parse", "SELECT doc_id::VARCHAR AS doc_id, title, text, CASE WHEN title='' THEN text ELSE title||chr(10)||text END AS passage FROM corpus")
def corpus_parse(t):
    title = F.when(F.col("title") != "", F.col("title"))  # an absent title is absent from the line
    lines = t.corpus.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), title.alias("title"), "text")).alias("line"))
    return col.parse_corpus_lines(lines).withColumn("passage", col.full_text())


cte("qrels_lines", """SELECT qid, doc_id, grade, 1 AS seq FROM qrels_raw
UNION ALL SELECT qid, doc_id, grade-1, 2 FROM qrels_raw WHERE (qid*3+doc_id)%5=0""")


@query("qrels_parse", """SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, greatest(g,0) AS grade, g<0 AS clamped
FROM (SELECT qid, doc_id, arg_max(grade, seq) AS g FROM qrels_lines GROUP BY 1,2)""")
def qrels_parse(t):
    line = F.concat_ws("\t", F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.col("g").cast("string"))
    again = F.when((F.col("qid") * 3 + F.col("doc_id")) % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = t.qrels_raw.withColumn("seq", F.explode(again)).withColumn("g", F.col("grade") - F.col("seq") + 1)
    header = F.array(F.struct(line.alias("line"), F.col("seq")), F.struct(F.lit("query-id\tcorpus-id\tscore").alias("line"), F.lit(0).alias("seq")),
                     F.struct(F.concat(F.col("qid").cast("string"), F.lit(" short")).alias("line"), F.lit(0).alias("seq")))
    return col.parse_qrels_lines(rows.select(F.inline(header)))


@query("corpus_subsample", f"""SELECT doc_id, judged FROM (SELECT *, row_number() OVER (ORDER BY judged DESC, {q.u(0, 'doc_id')}, doc_id) AS place FROM (
SELECT doc_id, doc_id IN (SELECT doc_id FROM qrels) AS judged FROM corpus)) WHERE judged OR place<=(SELECT count(*)//2 FROM corpus)""")
def corpus_subsample(t):
    half = t.corpus.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    return col.subsample_corpus(t.corpus.select("doc_id"), t.qrels, half).select("doc_id", "judged")


@query("corpus_audit", """SELECT sum(n)::BIGINT AS n_judgements, count(*) AS judged_docs, sum((known IS NULL)::INT)::BIGINT AS missing_docs, sum(c)::BIGINT AS clamped_negatives
FROM (SELECT CASE WHEN doc_id%11=0 THEN -1-doc_id ELSE doc_id END AS doc_id, count(*) AS n, sum((grade<0)::INT) AS c FROM qrels_raw GROUP BY 1) LEFT JOIN (SELECT doc_id, 1 AS known FROM corpus) USING (doc_id)""")
def corpus_audit(t):
    return col.corpus_audit(t.corpus, t.stray_qrels.withColumn("clamped", F.col("grade") < 0))


@query("judged_queries", "SELECT qid, text FROM bench_queries WHERE qid IN (SELECT qid FROM qrels WHERE grade>=2)")
def judged_queries(t):
    return col.judged_queries(t.queries, t.qrels.filter(F.col("grade") >= 2))


@query("hash_split", f"""SELECT doc_id, CASE WHEN {q.u(7, 'doc_id')}<0.7 THEN 'train' WHEN {q.u(7, 'doc_id')}<0.85 THEN 'val' ELSE 'test' END AS split FROM documents""")
def hash_split(t):
    return col.hash_split(t.raw("documents").select("doc_id"), "doc_id", seed=7)


@query("query_halves", """SELECT qid, CASE WHEN row_number() OVER (ORDER BY qid)-1<(SELECT count(DISTINCT qid)//2 FROM pool) THEN 'fit' ELSE 'report' END AS half FROM (SELECT DISTINCT qid FROM pool)""")
def query_halves(t):
    return col.query_halves(t.pool)


cte("run_src", """SELECT user_id, event_type, count(*) AS n, round(avg(value),6) AS m FROM events GROUP BY 1,2""")


def _run_lines(t):
    per = t.raw("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("m"))
    runs = per.groupBy("user_id").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "m")))).alias("means"),
    )
    manifest = F.to_json(F.struct(
        F.concat(F.lit("run of "), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("user_id") % 9 == 0, "failed").otherwise("done").alias("status"),
        (F.col("n") * 0.5).alias("wall_seconds"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("config"),
    ))
    deep = F.struct(F.struct(F.array(F.col("n"), F.col("n") + 1).alias("l"), F.struct(F.col("n").alias("d")).alias("c")).alias("b"))
    metrics = F.to_json(F.struct(F.col("n").alias("events"), F.col("means").alias("mean"), deep.alias("a")))
    return runs.select(F.col("user_id").cast("string").alias("run"), manifest.alias("manifest"), metrics.alias("metrics"))


@query("run_ledger", """SELECT user_id::VARCHAR AS run, CASE WHEN user_id%9=0 THEN 'failed' ELSE 'done' END AS status, sum(n)*0.5::DOUBLE AS wall_seconds, user_id::VARCHAR AS config_user FROM run_src GROUP BY user_id""")
def run_ledger(t):
    return ledger.parse_runs(_run_lines(t)).select("run", "status", "wall_seconds", F.element_at("config", F.lit("user")).alias("config_user"))


@query("run_metrics", """SELECT user_id::VARCHAR AS run, 'events' AS path, sum(n)::DOUBLE AS value FROM run_src GROUP BY user_id
UNION ALL SELECT user_id::VARCHAR, 'mean.'||event_type, m FROM run_src
UNION ALL SELECT user_id::VARCHAR, unnest(['a.b.l.0','a.b.l.1','a.b.c.d']), unnest([sum(n),sum(n)+1,sum(n)])::DOUBLE FROM run_src GROUP BY user_id""")
def run_metrics(t):
    return ledger.run_metrics(ledger.parse_runs(_run_lines(t)))


@query("run_stage_deltas", f"""SELECT run, metric, step, value, {q.r6('value-lag(value) OVER w')} AS change, {q.r6('value-first_value(value) OVER w')} AS since_start FROM (
SELECT user_id::VARCHAR AS run, event_type AS metric, day(ts) AS step, round(avg(value),6) AS value FROM events GROUP BY 1,2,3) WINDOW w AS (PARTITION BY run, metric ORDER BY step)""")
def run_stage_deltas(t):
    h = t.raw("events").groupBy(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("metric"), F.dayofmonth("ts").cast("bigint").alias("step")).agg(F.round(F.avg("value"), 6).alias("value"))
    d = ledger.stage_deltas(h)
    return d.select("run", "metric", "step", "value", ex.r6("change").alias("change"), ex.r6("since_start").alias("since_start"))


# ------------------------------------------------------------------------ text
@query("tokens", "SELECT c.doc_id, coalesce(n,0) AS n_tokens, coalesce(d,0) AS n_distinct, coalesce(first,'') AS first_token FROM corpus c LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS d, min(term) AS first FROM doc_tokens GROUP BY 1) USING (doc_id)")
def tokens(t):
    k = t.corpus.select("doc_id", tx.tokens("text").alias("tk"))
    return k.select("doc_id", ex.big(F.size("tk")).alias("n_tokens"), ex.big(F.size(F.array_distinct("tk"))).alias("n_distinct"), F.coalesce(F.array_min("tk"), F.lit("")).alias("first_token"))


def _plural(term: str) -> str:
    """A caller's stemmer for the registered query: drops a plural s."""
    return term[:-1] if len(term) > 3 and term.endswith("s") and not term.endswith("ss") else term


@query("stemmed_terms", """SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, CASE WHEN length(term)>3 AND term LIKE '%s' AND term NOT LIKE '%ss' THEN left(term, length(term)-1) ELSE term END AS term, sum(tf) AS tf FROM doc_tf GROUP BY 1,2) GROUP BY 1""")
def stemmed_terms(t):
    counted = cut_lineage(tx.counted_terms(t.corpus).select("doc_id", "term", "tf"))  # read for the vocabulary and for the counts
    stems = tx.stem_vocabulary(counted, _plural)
    s = tx.apply_stems(counted, stems, ["doc_id"], "tf")
    return s.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("bm25_postings", f"SELECT term, doc_id, tf, {q.r6('w')} AS w FROM postings")
def bm25_postings(t):
    return tx.build_postings(t.corpus).select("term", "doc_id", "tf", ex.r6("w").alias("w"))


@query("term_statistics", f"SELECT term, df, {q.r6('idf')} AS idf FROM term_df")
def term_statistics(t):
    n = t.corpus.agg(F.count(F.lit(1))).scalar()
    return tx.term_statistics(tx.document_frequencies(t.corpus), n).select("term", "df", ex.r6("idf").alias("idf"))


@query("corpus_totals", f"SELECT n_docs, {q.r6('avgdl')} AS avgdl FROM totals")
def corpus_totals(t):
    c = tx.corpus_totals(tx.document_lengths(t.corpus))
    return c.select("n_docs", ex.r6("avgdl").alias("avgdl"))


@query("bm25_topk", "SELECT qid, doc_id, score, rank FROM bm25_ranked")
def bm25_topk(t):
    return t.ranked


@query("bm25_topk_indexed", "SELECT qid, doc_id, score, rank FROM bm25_ranked")
def bm25_topk_indexed(t):
    """The index and its terms' bounds are stored by term and read back; both tables go when the ranking is written."""
    name = f"postings_{uuid.uuid4().hex}"
    try:
        postings = tx.store_postings(tx.build_postings(t.corpus), name)
        n = t.corpus.agg(F.count(F.lit(1))).scalar()
        bounds = tx.store_postings(retrieval.term_bounds(postings).withColumn("idf", tx.idf(n, F.col("df"))), f"{name}_terms")
        return cut_lineage(retrieval.bm25_topk(postings, bounds, t.queries, k=100))
    finally:
        for table in (name, f"{name}_terms"):
            t.spark.sql(f"DROP TABLE IF EXISTS {table}")


@query("query_terms_present", "SELECT qid, string_agg(term, ' ' ORDER BY term) AS terms FROM query_tf WHERE term IN (SELECT term FROM term_df) GROUP BY 1")
def query_terms_present(t):
    p = retrieval.query_terms_present(t.queries, tx.document_frequencies(t.corpus))
    return p.select("qid", F.array_join("terms", " ").alias("terms"))


@query("token_cut", f"SELECT doc_id, {q.strip('substr(text,1,64)')} AS kept FROM corpus")
def token_cut(t):
    return t.corpus.select("doc_id", tx.cut("text", 16).alias("kept"))


@query("token_cut_exact", r"""SELECT doc_id, regexp_extract(text, '^\s*(\S+\s+){0,15}\S+') AS kept FROM corpus""")
def token_cut_exact(t):
    by_words = tx.cut_exact(lambda s: len(s.split()))
    out = by_words("text", F.lit(16))
    # the prefix may carry the next blank; the longest one without it is compared
    return t.corpus.select("doc_id", F.regexp_replace(out, r"\s+$", "").alias("kept"))


HEAD = r"regexp_replace(coalesce(title,'')||'. '||text, '^[. ]+|[. ]+$', '', 'g')"


@query("signature_title", f"SELECT doc_id, {q.strip('''substr(coalesce(nullif(title,''),text),1,64)''')} AS signature FROM corpus")
def signature_title(t):
    return t.corpus.select("doc_id", tx.signature("title", 16).alias("signature"))


@query("signature_head", f"SELECT doc_id, {q.strip(f'substr({HEAD},1,148)')} AS signature FROM corpus")
def signature_head(t):
    return t.corpus.select("doc_id", tx.signature("head", 37).alias("signature"))


cte("pair_words", r"""SELECT qid, doc_id, title, text, regexp_extract_all(text,'\S+') AS ws FROM bm25_ranked JOIN corpus USING (doc_id)""")
cte("query_map", "SELECT qid, map_from_entries(list((term, idf))) AS wt FROM query_tf JOIN term_df USING (term) GROUP BY 1")
cte("pair_hits", """SELECT qid, doc_id, title, text, ws, list_transform(ws, lambda w: coalesce(list_max(list_transform(regexp_extract_all(lower(w),'[a-z0-9]+'), lambda s: coalesce(wt[s],0.0))),0.0)) AS hit
FROM pair_words JOIN query_map USING (qid)""")
cte("pair_best", """SELECT qid, doc_id, title, text, ws, CASE WHEN len(ws)>40 THEN list_max(list_transform(range(0, len(ws)-40+1, 10), lambda i: {'v': round(list_sum(hit[i+1:i+40]),9), 'neg': -i})) END AS best FROM pair_hits""")
cte("pair_window", """SELECT qid, doc_id, title, text, array_to_string(ws[(CASE WHEN best.v>0 THEN -best.neg ELSE 0 END)+1 : (CASE WHEN best.v>0 THEN -best.neg ELSE 0 END)+40], ' ') AS win FROM pair_best""")


def _windows(t, keep=("title",)):
    weights = retrieval.query_weights(t.queries, t.query_idf)
    return tx.best_windows(t.ranked_once.select("qid", "doc_id"), t.corpus, weights, keep=keep, index=t.positions)


@query("signature_lexical", f"SELECT qid, doc_id, {q.strip('substr(win,1,148)')} AS signature FROM pair_window")
def signature_lexical(t):
    return _windows(t).select("qid", "doc_id", tx.signature("lexical", 37).alias("signature"))


cte("pair_title", f"""SELECT *, {q.strip('substr(title,1,72)')} AS head FROM pair_window""")


@query("signature_title_lexical", f"""SELECT qid, doc_id, CASE WHEN head<>'' THEN {q.strip("head||' '||tail")} ELSE tail END AS signature FROM (
SELECT *, CASE WHEN greatest(36-length(head)//4,0)<=0 THEN '' ELSE {q.strip('substr(win,1,greatest(36-length(head)//4,0)*4)')} END AS tail FROM pair_title)""")
def signature_title_lexical(t):
    return _windows(t).select("qid", "doc_id", tx.signature("title+lexical", 37).alias("signature"))


@query("signature_recall", f"""SELECT qid, doc_id, {q.r6('coalesce(len(list_intersect(in_doc, sg))::DOUBLE/nullif(len(in_doc),0),1.0)')} AS recall FROM (
SELECT qid, doc_id, list_intersect(qt, regexp_extract_all(lower(text),'[a-z0-9]+')) AS in_doc, regexp_extract_all(lower({q.strip(f'substr({HEAD},1,148)')}),'[a-z0-9]+') AS sg
FROM bm25_ranked JOIN corpus USING (doc_id) JOIN (SELECT qid, list(DISTINCT term) AS qt FROM query_tf GROUP BY 1) USING (qid))""")
def signature_recall(t):
    heads = t.corpus.select("doc_id", tx.signature("head", 37).alias("signature"))  # the cut travels, not the text
    pairs = t.ranked_once.select("qid", "doc_id").join(heads, "doc_id")
    out = retrieval.with_signature_recall(pairs, t.corpus, t.queries, index=t.positions)
    return out.select("qid", "doc_id", ex.r6("recall").alias("recall"))


@query("candidate_pools", """SELECT qid, doc_id, score, rank, grade, substr(CASE WHEN title='' THEN text ELSE title||chr(10)||text END,1,2000) AS passage FROM (
SELECT *, count(*) OVER (PARTITION BY qid) AS n, max(grade) OVER (PARTITION BY qid) AS top FROM (
SELECT r.qid, r.doc_id, score, rank, coalesce(g.grade,0) AS grade FROM bm25_ranked r LEFT JOIN qrels g ON g.qid=r.qid AND g.doc_id=r.doc_id)) JOIN corpus USING (doc_id) WHERE n>=100 AND top>=1""")
def candidate_pools(t):
    p = retrieval.candidate_pools(t.ranked, t.qrels, t.corpus, k=100)
    return p.select("qid", "doc_id", "score", "rank", "grade", "passage")


cte("probes", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, grade ORDER BY first_rank) AS probe FROM pool) WHERE probe<=6""")


@query("balanced_probes", """SELECT qid, doc_id, grade, first_rank, probe FROM probes WHERE qid IN (SELECT qid FROM probes GROUP BY 1 HAVING count(DISTINCT grade)>=4 AND count(*)>=20)""")
def balanced_probes(t):
    p = retrieval.balanced_probes(t.pool, 6, 4, 20, rank="first_rank")
    return p.select("qid", "doc_id", "grade", "first_rank", "probe")


cte("bm25_ndcg", """SELECT qid, coalesce(CASE WHEN idcg>0 THEN dcg/idcg END,0.0) AS ndcg FROM (
SELECT r.qid, sum((2.0**coalesce(grade,0)-1)/log2(rank+1)) AS dcg FROM bm25_ranked r LEFT JOIN qrels g ON g.qid=r.qid AND g.doc_id=r.doc_id WHERE rank<=10 GROUP BY 1)
LEFT JOIN (SELECT qid, sum((2.0**grade-1)/log2(r+1)) AS idcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS r FROM qrels) WHERE r<=10 GROUP BY 1) USING (qid)""")


@query("bm25_ndcg", f"SELECT qid, {q.r6('ndcg')} AS ndcg FROM bm25_ndcg")
def bm25_ndcg(t):
    return evaluation.ndcg(t.ranked, t.qrels).select("qid", ex.r6("ndcg").alias("ndcg"))


_SETS = [*retrieval.PUBLISHED, "own"]
_SET = "CASE qid%4 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_SETS)) + " END"


@query("first_stage_check", f"SELECT d.dataset, n_queries, {q.r6('ndcg')} AS ndcg, published, {q.r6('ndcg-published')} AS delta FROM (SELECT {_SET} AS dataset, count(*) AS n_queries, avg(ndcg) AS ndcg FROM bm25_ndcg GROUP BY 1) d LEFT JOIN (VALUES "
       + ",".join(f"('{d}',{v!r}::DOUBLE)" for d, v in retrieval.PUBLISHED.items()) + ") p(dataset, published) ON p.dataset=d.dataset")
def first_stage_check(t):
    """The queries as four test collections, one of which nobody has published a figure for."""
    name = F.get(F.array(*map(F.lit, _SETS)), (F.col("qid") % 4).cast("int"))
    c = retrieval.first_stage_check(t.ranked, t.qrels, t.queries.select("qid", name.alias("dataset")), retrieval.published_figures(t.spark))
    return c.select("dataset", "n_queries", ex.r6("ndcg").alias("ndcg"), "published", ex.r6("delta").alias("delta"))


# layouts and signatures against each other, on balanced probes of the first stage
SLATE, SLATES = 10, 30
SHARE = {"options": 16, "state": 37}  # tokens that each of ten candidates keeps, for the twin
cte("ev_probes", """SELECT qid, doc_id, grade, score AS first_score FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n, max(grade) OVER (PARTITION BY qid)>min(grade) OVER (PARTITION BY qid) AS mixed FROM (
SELECT r.qid, r.doc_id, r.score, coalesce(g.grade,0) AS grade, row_number() OVER (PARTITION BY r.qid, coalesce(g.grade,0) ORDER BY r.rank) AS probe FROM bm25_ranked r LEFT JOIN qrels g ON g.qid=r.qid AND g.doc_id=r.doc_id)
WHERE probe<=12) WHERE mixed AND n>=12""")
cte("ev_sizes", "SELECT qid, grade, count(*) AS n, row_number() OVER (PARTITION BY qid ORDER BY grade) AS no, count(*) OVER (PARTITION BY qid) AS k FROM ev_probes GROUP BY 1,2")
design_cte("ev_design", SLATE, SLATES, 0.5, 95, "ev_probes", "ev_sizes")


def _sig_sql(kind: str, tokens: int) -> str:
    if kind == "title":
        return q.strip(f"substr(coalesce(nullif(title,''),text),1,{tokens * 4})")
    if kind == "lexical":
        return q.strip(f"substr(win,1,{tokens * 4})")
    lead = q.strip(f"substr(title,1,{int(tokens * 0.5) * 4})")
    room = f"greatest({tokens - 1}-length({lead})//4,0)"
    tail = f"CASE WHEN {room}<=0 THEN '' ELSE {q.strip(f'substr(win,1,{room}*4)')} END"
    joined = q.strip(f"{lead}||' '||{tail}")
    return f"CASE WHEN {lead}<>'' THEN {joined} ELSE {tail} END"


_EV = [(layout, kind) for layout in SHARE for kind in evidence.KINDS]
cte("ev_cuts", " UNION ALL ".join(f"SELECT '{layout}/{kind}' AS config, {SHARE[layout]} AS tokens, qid, doc_id, grade, first_score, text, {_sig_sql(kind, SHARE[layout])} AS sig FROM ev_probes JOIN pair_window USING (qid, doc_id)" for layout, kind in _EV))
cte("ev_counts", """SELECT c.*, len(list_intersect(qraw, regexp_extract_all(lower(substr(sig,1,tokens*4)),'[a-z0-9]+'))) AS n, coalesce(len(list_intersect(list_intersect(qt, regexp_extract_all(lower(text),'[a-z0-9]+')), regexp_extract_all(lower(sig),'[a-z0-9]+')))::DOUBLE/nullif(len(list_intersect(qt, regexp_extract_all(lower(text),'[a-z0-9]+'))),0),1.0) AS recall
FROM ev_cuts c JOIN (SELECT qid, list(DISTINCT term) AS qraw FROM query_raw_tokens GROUP BY 1) USING (qid) JOIN (SELECT qid, list(term) AS qt FROM query_tf GROUP BY 1) USING (qid)""")
# the scores are additive as they are made: a candidate's count less what its slate holds
cte("ev_slates", "SELECT config, d.qid, slate, ln(sum(exp(n))) AS c FROM ev_design d JOIN ev_counts k ON k.qid=d.qid AND k.doc_id=d.item_id GROUP BY 1,2,3")
cte("ev_drawn", "SELECT DISTINCT qid, item_id AS doc_id FROM ev_design")
cte("ev_shift", """SELECT config, qid, (si+sc)/(ni+nc) AS t FROM (SELECT config, qid, sum(n) AS si, count(*) AS ni FROM ev_counts JOIN ev_drawn USING (qid, doc_id) GROUP BY 1,2)
JOIN (SELECT config, qid, sum(c) AS sc, count(*) AS nc FROM ev_slates GROUP BY 1,2) USING (config, qid)""")
cte("ev_latent", "SELECT k.*, CASE WHEN d.doc_id IS NOT NULL THEN round(n-t,6) ELSE 0.0 END+0.0 AS latent FROM ev_counts k JOIN ev_shift USING (config, qid) LEFT JOIN ev_drawn d ON d.qid=k.qid AND d.doc_id=k.doc_id")
cte("ev_placed", """SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY latent DESC, doc_id) AS rl, row_number() OVER (PARTITION BY config, qid ORDER BY first_score DESC, doc_id) AS rf,
row_number() OVER (PARTITION BY config, qid ORDER BY grade DESC, doc_id) AS rg FROM ev_latent""")
_DCG = "sum(CASE WHEN {r}<=10 THEN (2.0**grade-1)/log2({r}+1) ELSE 0.0 END)"
cte("ev_rows", f"""SELECT config, qid, any_value(tokens) AS tokens, avg(recall) AS recall, count(*) AS n_probes, CASE WHEN stddev_pop(latent)>1e-9 AND stddev_pop(grade)>1e-9 THEN covar_pop(latent,grade::DOUBLE)/(stddev_pop(latent)*stddev_pop(grade)) END AS corr,
coalesce({_DCG.format(r='rl')}/nullif({_DCG.format(r='rg')},0),0.0) AS ndcg, coalesce({_DCG.format(r='rf')}/nullif({_DCG.format(r='rg')},0),0.0) AS ndcg_first FROM ev_placed GROUP BY 1,2""")
cte("ev_sweep", """SELECT config, tokens, sum(recall*n_probes)/sum(n_probes) AS signature_recall, avg(corr) AS corr, stddev_pop(corr)/greatest(1.0,sqrt(count(corr))) AS corr_se, avg(ndcg) AS ndcg, avg(ndcg_first) AS ndcg_first, count(*) AS n_queries FROM ev_rows GROUP BY 1,2""")


def _count_scorer(batch):
    """A stand-in for the caller's model: log-softmax of how many of the query's words a candidate's text holds."""
    out = []
    for options, state in zip(batch["options"], batch["state"]):
        asked, texts = state, list(options)
        if state.startswith("{"):
            told = json.loads(state)
            asked, texts = told["query"], [told["candidates"][o] for o in options]
        words = set(re.findall(tx.TOKEN, asked.lower()))
        counts = np.array([len(words & set(re.findall(tx.TOKEN, x.lower()))) for x in texts], float)
        out.append((counts - np.log(np.exp(counts).sum())).tolist())
    return out


def _evidence(t):
    graded = t.ranked_once.join(t.qrels, ["qid", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    probes = retrieval.balanced_probes(graded, 12, 2, 12).select("qid", "doc_id", "grade", F.col("score").alias("first_score"))
    weights = retrieval.query_weights(t.queries, t.query_idf)
    probes = cut_lineage(tx.best_windows(probes, t.corpus, weights, keep=("title", "text"), index=t.positions))
    return cut_lineage(evidence.evidence_rows(probes, t.queries, t.corpus, _count_scorer, slate_size=SLATE, n_slates=SLATES, seed=95, index=t.positions))


_EV_COLUMNS = ("recall", "corr", "ndcg", "ndcg_first")


@query("evidence_rows", "SELECT config, qid, tokens AS tokens_per_candidate, n_probes, " + ", ".join(f"{q.r6(c)} AS {c}" for c in _EV_COLUMNS) + " FROM ev_rows")
def evidence_rows(t):
    return _evidence(t).select("config", "qid", "tokens_per_candidate", "n_probes", *[ex.r6(c).alias(c) for c in _EV_COLUMNS])


_EV_MEANS = ("signature_recall", "corr", "corr_se", "ndcg", "ndcg_first")


@query("evidence_sweep", "SELECT config, tokens AS tokens_per_candidate, n_queries, " + ", ".join(f"{q.r6(c)} AS {c}" for c in _EV_MEANS) + " FROM ev_sweep")
def evidence_sweep(t):
    s = evidence.evidence_sweep(_evidence(t))
    return s.select("config", "tokens_per_candidate", "n_queries", *[ex.r6(c).alias(c) for c in _EV_MEANS])


cte("ev_best", "SELECT arg_max(config, {'m': round(m,9), 'c': config}) AS config FROM (SELECT config, avg(ndcg) AS m FROM ev_rows GROUP BY 1)")
cte("ev_diffs", """SELECT config, 'first stage' AS versus, qid, ndcg-ndcg_first AS diff FROM ev_rows
UNION ALL SELECT r.config, 'best', r.qid, r.ndcg-b.ndcg FROM ev_rows r JOIN ev_rows b ON b.qid=r.qid AND b.config=(SELECT config FROM ev_best)""")
weights_sql("ev_weights", "ev_diffs", 97)
cte("ev_boot", "SELECT config, versus, r, sum(w*diff)/nullif(sum(w),0) AS m FROM ev_diffs JOIN ev_weights USING (qid) GROUP BY 1,2,3")


@query("evidence_pairs", f"""SELECT config, versus, n, {q.r6('mean_diff')} AS mean_diff, {q.r6('lo')} AS lo, {q.r6('hi')} AS hi FROM (SELECT config, versus, count(*) AS n, avg(diff) AS mean_diff FROM ev_diffs GROUP BY 1,2)
JOIN (SELECT config, versus, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM ev_boot GROUP BY 1,2) USING (config, versus)""")
def evidence_pairs(t):
    p = evidence.evidence_pairs(_evidence(t), seed=97)
    return p.select("config", "versus", "n", *[ex.r6(c).alias(c) for c in ("mean_diff", "lo", "hi")])


@query("evidence_verdict", f"""SELECT arg_max(config, {{'m': corr, 'c': config}}) AS best, arg_min(config, {{'m': corr, 'c': config}}) AS worst, {q.r6('max(corr)')} AS best_corr, {q.r6('max(corr)-min(corr)')} AS spread,
CASE WHEN max(corr)<0.25 THEN 'no_signal' WHEN max(corr)-min(corr)>0.10 THEN 'starved' ELSE 'signal_present' END AS verdict FROM (SELECT config, round(corr,9) AS corr FROM ev_sweep)""")
def evidence_verdict(t):
    s = evidence.evidence_sweep(_evidence(t)).withColumn("corr", F.round("corr", 9))
    return evidence.evidence_verdict(s).withColumns({c: ex.r6(c) for c in ("best_corr", "spread")})
