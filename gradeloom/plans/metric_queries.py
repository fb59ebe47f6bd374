"""Registered queries: ranking metrics, probability metrics, calibration, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.draws import DRAW, MIX, SHIFTS
from ..operators import calibration as cal, evaluation as ev, losses as ls, scale, typed
from . import sql as q
from .registry import cte, query

# ------------------------------------------------------------ ranking metrics
cte("sys_top", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, doc_id) AS rank FROM system_scores) WHERE rank<=10")
cte("pool_ideal", "SELECT qid, sum((2.0**grade-1)/log2(r+1)) AS idcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS r FROM candidates) WHERE r<=10 GROUP BY 1")
cte("sys_metrics", """SELECT system, qid, coalesce(CASE WHEN idcg>0 THEN dcg/idcg END,0.0) AS ndcg, coalesce(hits::DOUBLE/nullif(total,0),0.0) AS recall, coalesce(1.0/first,0.0) AS mrr FROM (
SELECT system, qid, sum((2.0**grade-1)/log2(rank+1)) AS dcg, sum((grade>=1)::INT) AS hits, min(CASE WHEN grade>=2 THEN rank END) AS first FROM sys_top GROUP BY 1,2)
JOIN pool_ideal USING (qid) JOIN (SELECT qid, sum((grade>=1)::INT) AS total FROM candidates GROUP BY 1) USING (qid)""")


def _one(t, system="first"):
    return t.system_scores.filter(F.col("system") == system).select("qid", "doc_id", "score")


@query("ndcg_at_10", f"SELECT qid, {q.r6('ndcg')} AS ndcg FROM sys_metrics WHERE system='first'")
def ndcg_at_10(t):
    return ev.ndcg(_one(t), t.pool_qrels).select("qid", ex.r6("ndcg").alias("ndcg"))


@query("recall_at_10", f"SELECT qid, {q.r6('recall')} AS recall FROM sys_metrics WHERE system='first'")
def recall_at_10(t):
    return ev.recall_at_k(_one(t), t.pool_qrels).select("qid", ex.r6("recall").alias("recall"))


@query("mrr_at_10", f"SELECT qid, {q.r6('mrr')} AS mrr FROM sys_metrics WHERE system='chance'")
def mrr_at_10(t):
    return ev.mrr_at_k(_one(t, "chance"), t.pool_qrels).select("qid", ex.r6("mrr").alias("mrr"))


@query("judged_fraction", f"""SELECT r.qid, {q.r6('avg((g.grade IS NOT NULL)::INT)')} AS judged_fraction, {q.r6('avg((coalesce(g.grade,0)>=1)::INT)')} AS relevant_fraction, count(*) AS n
FROM bm25_ranked r LEFT JOIN qrels g ON g.qid=r.qid AND g.doc_id=r.doc_id WHERE rank<=10 GROUP BY 1""")
def judged_fraction(t):
    j = ev.judged_fraction(t.ranked.drop("rank"), t.qrels)
    return j.withColumns({c: ex.r6(c) for c in ("judged_fraction", "relevant_fraction")})


@query("grade_histogram", "SELECT grade, count(*) AS n FROM qrels GROUP BY 1")
def grade_histogram(t):
    return ev.grade_histogram(t.qrels)


@query("query_grade_lists", "SELECT qid, count(*) AS n_judged, sum((grade>=1)::INT)::BIGINT AS n_relevant, max(grade) AS top_grade FROM qrels GROUP BY 1")
def query_grade_lists(t):
    return ev.query_grade_lists(t.qrels)


# --------------------------------------------------------- probability metrics
_BRIER = "list_sum(list_transform(probs, lambda x, i: (x-(CASE WHEN i-1=label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))**2))"
cte("pred", f"""SELECT ex_id, source, qtype, k, label, list_max(probs) AS conf, ({q.argmax0('probs')}=label)::INT AS correct, {_BRIER} AS brier,
CASE WHEN k<2 THEN 1.0::DOUBLE ELSE 1.0-{q.entropy('probs')}/ln(k) END AS confidence, {q.bucket('qtype', 'k')} AS bucket FROM labelled""")


def _pred(t):
    return ev.prediction_columns(t.labelled).withColumn("bucket", ex.size_bucket("qtype", "k"))


@query("accuracy_and_majority", f"""SELECT source, n, {q.r6('ok::DOUBLE/n')} AS accuracy, {q.r6('top::DOUBLE/n')} AS majority FROM (SELECT source, sum(n)::BIGINT AS n, sum(ok) AS ok, max(n) AS top FROM (
SELECT source, label, count(*) AS n, sum(correct) AS ok FROM pred GROUP BY 1,2) GROUP BY 1)""")
def accuracy_and_majority(t):
    a = ev.accuracy_and_majority(_pred(t), ["source"])
    return a.withColumns({c: ex.r6(c) for c in ("accuracy", "majority")})


@query("brier_and_confidence", f"SELECT ex_id, {q.r6('brier')} AS brier, {q.r6('confidence')} AS confidence, correct FROM pred")
def brier_and_confidence(t):
    return _pred(t).select("ex_id", ex.r6("brier").alias("brier"), ex.r6("confidence").alias("confidence"), "correct")


@query("binary_brier", f"SELECT system, {q.r6('avg((prob-relevant)**2)')} AS brier, count(*) AS n FROM system_scores GROUP BY 1")
def binary_brier(t):
    return t.system_scores.groupBy("system").agg(ex.r6(F.avg(F.pow(F.col("prob") - F.col("relevant"), F.lit(2.0)))).alias("brier"), F.count(F.lit(1)).alias("n"))


_AURC = "SELECT {by}, avg(e/r) AS aurc FROM (SELECT {by}, row_number() OVER w AS r, sum(1-correct) OVER w AS e FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY conf DESC, ex_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1"
cte("pred_twice", "SELECT bucket AS slice, ex_id, label, conf, correct, brier FROM pred UNION ALL SELECT '__aggregate__', ex_id, label, conf, correct, brier FROM pred")


@query("aurc_by_bucket", f"SELECT slice, {q.r6('aurc')} AS aurc FROM ({_AURC.format(by='slice', src='pred_twice')})")
def aurc_by_bucket(t):
    rows = _pred(t).withColumn("slice", F.explode(F.array("bucket", F.lit(ev.ALL))))
    return ev.aurc(rows, ["slice"]).select("slice", ex.r6("aurc").alias("aurc"))


def _ece_sql(by: str, src: str, p: str = "conf", y: str = "correct") -> str:
    return f"SELECT {by}, sum(abs(sy-sp))/sum(n) AS ece, sum(n)::BIGINT AS n FROM (SELECT {by}, {q.ece_bin(p)} AS bin, count(*) AS n, sum({p}) AS sp, sum({y}) AS sy FROM {src} GROUP BY 1,2) GROUP BY 1"


@query("ece_by_source", f"SELECT source, {q.r6('ece')} AS ece, n FROM ({_ece_sql('source', 'pred')})")
def ece_by_source(t):
    e = ev.ece(_pred(t), ["source"])
    return e.select("source", ex.r6("ece").alias("ece"), "n")


@query("reliability_curve", f"SELECT bucket, bin, {q.r6('(bin-0.5)/15')} AS centre, {q.r6('avg(conf)')} AS mean_conf, {q.r6('avg(correct)')} AS accuracy, count(*) AS n FROM (SELECT *, {q.ece_bin('conf')} AS bin FROM pred) GROUP BY 1,2")
def reliability_curve(t):
    c = ev.reliability_curve(_pred(t), ["bucket"])
    return c.withColumns({x: ex.r6(x) for x in ("centre", "mean_conf", "accuracy")})


cte("slice_heads", "SELECT slice, sum(n)::BIGINT AS n, sum(ok)::DOUBLE/sum(n) AS accuracy, max(n)::DOUBLE/sum(n) AS majority FROM (SELECT slice, label, count(*) AS n, sum(correct) AS ok FROM pred_twice GROUP BY 1,2) GROUP BY 1")
cte("slice_rows", f"""SELECT slice, h.n, round(accuracy,4) AS accuracy, round(majority,4) AS majority, round(ece,4) AS ece, round(brier,4) AS brier, round(aurc,4) AS aurc, round(mean_conf,4) AS mean_conf FROM slice_heads h
JOIN (SELECT slice, avg(brier) AS brier, avg(conf) AS mean_conf FROM pred_twice GROUP BY 1) USING (slice) JOIN (SELECT slice, ece FROM ({_ece_sql('slice', 'pred_twice')})) USING (slice) JOIN ({_AURC.format(by='slice', src='pred_twice')}) USING (slice)""")


@query("slice_report", """SELECT *, CASE WHEN slice='__aggregate__' THEN (SELECT max(ece) FROM slice_rows WHERE slice<>'__aggregate__') END AS worst_slice_ece,
CASE WHEN slice='__aggregate__' THEN round((SELECT max(ece) FROM slice_rows WHERE slice<>'__aggregate__')/greatest(ece,1e-9),2) END AS hiding_ratio FROM slice_rows""")
def slice_report(t):
    return ev.slice_report(t.predictions, typed.slice_key("options"))


RESAMPLES = 10_000
# cumulative Poisson(1) probabilities: a draw is the number of them at or below a uniform
_DRAW = "(" + "+".join(f"({{u}}>={c!r}::DOUBLE)::INT" for c in ev.POISSON) + ")"
cte("paired", "SELECT a.qid, a.ndcg-b.ndcg AS diff FROM sys_metrics a JOIN sys_metrics b ON a.qid=b.qid AND a.system='latent' AND b.system='first'")


def weights_sql(name: str, source: str, seed: int) -> None:
    """(qid, r, w): how often a query counts in each resample."""
    x = f"SELECT qid, r, (w0+r*{DRAW[0]})&4294967295 AS x FROM (SELECT qid, {q.word(seed, ('qid',), 1)} AS w0 FROM (SELECT DISTINCT qid FROM {source})), (SELECT unnest(range({RESAMPLES})) AS r)"
    for shift, factor in zip(SHIFTS, MIX):
        x = f"SELECT * REPLACE ((xor(x, x>>{shift})*{factor})&4294967295 AS x) FROM ({x})"
    cte(name, f"SELECT qid, r, {_DRAW.format(u='u')} AS w FROM (SELECT qid, r, (xor(x, x>>16)+0.5::DOUBLE)/4294967296.0::DOUBLE AS u FROM ({x}))")


weights_sql("boot_weights", "paired", 91)
cte("boot", "SELECT r, sum(w*diff)/nullif(sum(w),0) AS m FROM paired JOIN boot_weights USING (qid) GROUP BY 1")


@query("paired_bootstrap", f"""SELECT 'latent' AS system, (SELECT count(*) FROM paired) AS n, (SELECT {q.r6('avg(diff)')} FROM paired) AS mean_diff, {q.r6('quantile_cont(m,0.025)')} AS lo, {q.r6('quantile_cont(m,0.975)')} AS hi,
{q.r6('least(2.0*least(avg((m<=0)::INT),avg((m>=0)::INT)),1.0)')} AS p_value FROM boot""")
def paired_bootstrap(t):
    d = ev.paired_differences(ev.ndcg(_one(t, "latent"), t.pool_qrels), ev.ndcg(_one(t), t.pool_qrels))
    b = ev.paired_bootstrap(d.withColumn("system", F.lit("latent")), ["system"], resamples=RESAMPLES, seed=91)
    return b.withColumns({c: ex.r6(c) for c in ("mean_diff", "lo", "hi", "p_value")})


GRID = [round(0.05 * (20 / 0.05) ** (i / 15), 6) for i in range(16)]
_GRID = "(SELECT unnest([" + ",".join(f"{g!r}::DOUBLE" for g in GRID) + "]) AS t)"
cte("halves", "SELECT qid, CASE WHEN row_number() OVER (ORDER BY qid)-1<(SELECT count(DISTINCT qid)//2 FROM pool) THEN 'fit' ELSE 'report' END AS half FROM (SELECT DISTINCT qid FROM pool)")
_LOGIT = "ln(least(greatest(prob,1e-6),1.0-1e-6)/(1.0-least(greatest(prob,1e-6),1.0-1e-6)))"
cte("sys_temp", f"""SELECT system, t FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY round(nll,12), t) AS r FROM (
SELECT system, t, avg(greatest(z/t,0.0)+ln(1+exp(-abs(z/t)))-relevant*z/t) AS nll FROM (SELECT system, relevant, {_LOGIT} AS z FROM system_scores JOIN halves USING (qid) WHERE half='fit'), {_GRID} GROUP BY 1,2)) WHERE r=1""")
cte("sys_report_rows", f"SELECT system, qid, prob, relevant, round(1.0/(1.0+exp(-({_LOGIT})/t)),9) AS cal FROM system_scores JOIN halves USING (qid) JOIN sys_temp USING (system) WHERE half='report'")


@query("binary_temperature", "SELECT system, t FROM sys_temp")
def binary_temperature(t):
    from ..sources.collections import query_halves

    rows = t.system_scores.join(query_halves(t.pool).filter(F.col("half") == "fit"), "qid")
    return cal.fit_binary_temperature(rows, ["system"], grid=GRID).select("system", "t")


def _search_sql(rows: str, by: str, loss: str, lo: float, hi: float, columns: str) -> str:
    """The narrowing grid, pass by pass: 24 candidates, six passes."""
    out = [f"b0 AS (SELECT DISTINCT {by}, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM {rows})"]
    for k in range(6):
        out.append(f"g{k} AS (SELECT {by}, lo, hi, lo*pow(hi/lo, i/23.0::DOUBLE) AS t FROM b{k}, (SELECT unnest(range(24)) AS i))")
        out.append(f"l{k} AS (SELECT g.{by}, lo, hi, t, avg({loss}) AS nll, count(*) AS n FROM {rows} x JOIN g{k} g ON g.{by}=x.{by} GROUP BY 1,2,3,4)")
        out.append(f"""b{k + 1} AS (SELECT {by}, greatest(t/pow(hi/lo,1/23.0::DOUBLE),lo) AS lo, least(t*pow(hi/lo,1/23.0::DOUBLE),hi) AS hi, nll, n FROM (
SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(nll,12), t) AS r FROM l{k}) WHERE r=1)""")
    return "WITH " + ",\n".join(out) + f"\nSELECT {by}, {q.r6('sqrt(lo*hi)', 3)} AS t, {columns} FROM b6"


cte("logit_rows", f"SELECT system, relevant, {_LOGIT} AS z FROM system_scores")


@query("binary_temperature_search", _search_sql("logit_rows", "system", "greatest(z/t,0.0)+ln(1+exp(-abs(z/t)))-relevant*z/t", 0.05, 20.0, "n"))
def binary_temperature_search(t):
    f = cal.fit_binary_temperature(t.system_scores, ["system"])
    return f.select("system", ex.r6("t", 3).alias("t"), "n")


def _comparison(t):
    """Rank metrics over all queries; temperature on one half of them, ECE and Brier on the other."""
    from ..sources.collections import query_halves

    s = t.system_scores
    halves = query_halves(t.pool)
    qrels = t.pool_qrels.select("qid", "doc_id", "grade").withColumn("system", F.explode(F.array(F.lit("first"), F.lit("latent"), F.lit("chance"))))
    rank = ev.ranking_report(s, qrels, 10, ["system", "qid"]).groupBy("system").agg(*[F.avg(c).alias(c) for c in ("ndcg", "recall", "mrr")])
    temp = cal.fit_binary_temperature(s.join(halves.filter(F.col("half") == "fit"), "qid"), ["system"], grid=GRID).select("system", "t")
    report = s.join(halves.filter(F.col("half") == "report"), "qid").join(temp, "system")
    report = report.withColumn("cal", F.round(cal.apply_binary_temperature("prob", "t"), 9))
    brier = report.groupBy("system").agg(F.avg(F.pow(F.col("cal") - F.col("relevant"), F.lit(2.0))).alias("brier"), F.avg("prob").alias("mean_p"), F.max("t").alias("t"))
    raw = ev.ece(report, ["system"], "prob", "relevant").select("system", F.col("ece").alias("ece_raw"))
    done = ev.ece(report, ["system"], "cal", "relevant").select("system", F.col("ece").alias("ece_cal"))
    return rank.join(brier, "system").join(raw, "system").join(done, "system")


@query("system_comparison", f"""SELECT system, {q.r6('ndcg')} AS ndcg, {q.r6('recall')} AS recall, {q.r6('mrr')} AS mrr, {q.r6('brier')} AS brier, {q.r6('mean_p')} AS mean_p, t, {q.r6('a.ece')} AS ece_raw, {q.r6('b.ece')} AS ece_cal FROM
(SELECT system, avg(ndcg) AS ndcg, avg(recall) AS recall, avg(mrr) AS mrr FROM sys_metrics GROUP BY 1) JOIN (SELECT system, avg((cal-relevant)**2) AS brier, avg(prob) AS mean_p FROM sys_report_rows GROUP BY 1) USING (system) JOIN sys_temp USING (system)
JOIN ({_ece_sql('system', 'sys_report_rows', 'prob', 'relevant')}) a USING (system) JOIN ({_ece_sql('system', 'sys_report_rows', 'cal', 'relevant')}) b USING (system)""")
def system_comparison(t):
    c = _comparison(t)
    return c.select("system", *[ex.r6(x).alias(x) for x in ("ndcg", "recall", "mrr", "brier", "mean_p")], "t", ex.r6("ece_raw").alias("ece_raw"), ex.r6("ece_cal").alias("ece_cal"))


cte("best_system", "SELECT system FROM sys_metrics GROUP BY 1 ORDER BY avg(ndcg) DESC, system DESC LIMIT 1")
cte("grid_rows", """SELECT s.system, 'baseline' AS versus, s.qid, s.ndcg-b.ndcg AS diff FROM sys_metrics s JOIN sys_metrics b ON b.qid=s.qid AND b.system='first'
UNION ALL SELECT s.system, 'best', s.qid, s.ndcg-b.ndcg FROM sys_metrics s JOIN sys_metrics b ON b.qid=s.qid AND b.system=(SELECT system FROM best_system)""")
weights_sql("grid_weights", "grid_rows", 92)
cte("grid_boot", "SELECT system, versus, r, sum(w*diff)/nullif(sum(w),0) AS m FROM grid_rows JOIN grid_weights USING (qid) GROUP BY 1,2,3")


@query("comparison_grid", f"""SELECT system, versus, n, {q.r6('mean_diff')} AS mean_diff, {q.r6('lo')} AS lo, {q.r6('hi')} AS hi, {q.r6('p')} AS p_value FROM (SELECT system, versus, count(*) AS n, avg(diff) AS mean_diff FROM grid_rows GROUP BY 1,2)
JOIN (SELECT system, versus, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi, least(2.0*least(avg((m<=0)::INT),avg((m>=0)::INT)),1.0) AS p FROM grid_boot GROUP BY 1,2) USING (system, versus)""")
def comparison_grid(t):
    s = t.system_scores
    qrels = t.pool_qrels.withColumn("system", F.explode(F.array(F.lit("first"), F.lit("latent"), F.lit("chance"))))
    scores = ev.ndcg(s, qrels, by=["system", "qid"])
    d = ev.comparison_grid(scores, "first")
    b = ev.paired_bootstrap(d, ["system", "versus"], resamples=RESAMPLES, seed=92)
    return b.withColumns({c: ex.r6(c) for c in ("mean_diff", "lo", "hi", "p_value")})


def _pool_ndcg(score: str, src: str) -> str:
    return f"""SELECT qid, coalesce(CASE WHEN idcg>0 THEN dcg/idcg END,0.0) AS v FROM (SELECT qid, sum((2.0**grade-1)/log2(r+1)) AS dcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, item_id) AS r FROM {src}) WHERE r<=10 GROUP BY 1) JOIN pool_ideal USING (qid)"""


@query("frozen_pool_evaluation", f"""SELECT 'anchored' AS arm, count(*) AS n_queries, {q.r6('avg(v)')} AS ndcg FROM ({_pool_ndcg('utility', 'scored_blocked')}) WHERE qid IN (SELECT qid FROM pool GROUP BY 1 HAVING count(*)>=60)
UNION ALL SELECT 'naive', count(*), {q.r6('avg(v)')} FROM ({_pool_ndcg('round(lp,6)', 'scored_blocked')}) WHERE qid IN (SELECT qid FROM pool GROUP BY 1 HAVING count(*)>=60)
UNION ALL SELECT 'first_stage', count(*), {q.r6('avg(v)')} FROM ({_pool_ndcg('first_score', '(SELECT qid, doc_id AS item_id, grade, first_score FROM pool)')}) WHERE qid IN (SELECT qid FROM pool GROUP BY 1 HAVING count(*)>=60)""")
def frozen_pool_evaluation(t):
    """Three orders of the same pools; pools with fewer than 60 candidates are skipped."""
    big = t.pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 60).select("qid")
    c = scale.calibrate(t.slate_logits(False)).join(t.pool.select("qid", F.col("doc_id").alias("item_id"), "first_score"), ["qid", "item_id"])
    arms = ex.variants(
        ("arm", "score"),
        ("anchored", ex.r6("utility")),
        ("naive", F.round("lp", 6)),
        ("first_stage", F.col("first_score")),
    )
    run = c.join(big, "qid", "left_semi").select("qid", F.col("item_id").alias("doc_id"), "grade", F.inline(arms))
    scores = ev.ndcg(run, run.select("arm", "qid", "doc_id", "grade"), by=["arm", "qid"])
    return scores.groupBy("arm").agg(F.count(F.lit(1)).alias("n_queries"), ex.r6(F.avg("ndcg")).alias("ndcg"))


cte("arm_rows", f"""SELECT 'hard' AS arm, ex_id, label, probs FROM labelled UNION ALL SELECT 'soft', ex_id, label, list_transform({q.softmax('logits', '1.5::DOUBLE')}, lambda z: round(z,9)) FROM labelled UNION ALL SELECT 'sharp', ex_id, label, list_transform({q.softmax('logits', '0.7::DOUBLE')}, lambda z: round(z,9)) FROM labelled""")
cte("arm_pred", f"SELECT arm, ex_id, list_max(probs) AS conf, ({q.argmax0('probs')}=label)::INT AS correct, {_BRIER} AS brier FROM arm_rows")
cte("arm_metrics", f"""SELECT arm, round(avg(correct),4) AS accuracy, round(any_value(ece),4) AS ece, round(avg(brier),4) AS brier, round(any_value(aurc),4) AS aurc, round(avg(conf),4) AS mean_conf FROM arm_pred JOIN (SELECT arm, ece FROM ({_ece_sql('arm', 'arm_pred')})) USING (arm) JOIN ({_AURC.format(by='arm', src='arm_pred')}) USING (arm) GROUP BY 1""")
cte("arm_long", "SELECT arm, metric, value FROM arm_metrics UNPIVOT (value FOR metric IN (accuracy, ece, brier, aurc, mean_conf))")


@query("arm_comparison", """SELECT metric, min(value) AS lowest, max(value) AS highest, CASE WHEN metric='mean_conf' THEN '-' WHEN (max(value)-min(value))/(CASE WHEN max(abs(value))=0 THEN 1.0 ELSE max(abs(value)) END)<0.05 THEN 'tie'
WHEN metric='accuracy' THEN (SELECT arm FROM arm_long b WHERE b.metric=a.metric ORDER BY value DESC, arm DESC LIMIT 1) ELSE (SELECT arm FROM arm_long b WHERE b.metric=a.metric ORDER BY value, arm LIMIT 1) END AS best FROM arm_long a GROUP BY metric""")
def arm_comparison(t):
    arms = ex.variants(
        ("arm", "p"),
        ("hard", F.col("probs")),
        ("soft", F.transform(ex.softmax("logits", 1.5), lambda x: F.round(x, 9))),
        ("sharp", F.transform(ex.softmax("logits", 0.7), lambda x: F.round(x, 9))),
    )
    rows = ev.prediction_columns(t.labelled.select("ex_id", "label", F.inline(arms)).withColumnRenamed("p", "probs"))
    m = (
        rows.groupBy("arm").agg(F.round(F.avg("correct"), 4).alias("accuracy"), F.round(F.avg("brier"), 4).alias("brier"), F.round(F.avg("conf"), 4).alias("mean_conf"))
        .join(ev.ece(rows, ["arm"]).select("arm", F.round("ece", 4).alias("ece")), "arm")
        .join(ev.aurc(rows, ["arm"]).select("arm", F.round("aurc", 4).alias("aurc")), "arm")
    )
    return ev.arm_comparison(m)


# ----------------------------------------------------------------- temperature
TGRID = [round(0.02 * (10 / 0.02) ** (i / 31), 6) for i in range(32)]
_TGRID = "(SELECT unnest([" + ",".join(f"{g!r}::DOUBLE" for g in TGRID) + "]) AS t)"
cte("bucket_rows", f"SELECT {q.bucket('qtype', 'k')} AS bucket, logits, label FROM labelled UNION ALL SELECT '(global)', logits, label FROM labelled")
cte("temp_fit", f"""SELECT bucket, t, nll, n FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(nll,12), t) AS r FROM (
SELECT bucket, t, avg({q.lse('logits', 't')}-(logits[label+1]-list_max(logits))/t) AS nll, count(*) AS n FROM bucket_rows, {_TGRID} GROUP BY 1,2)) WHERE r=1""")
cte("temps", "SELECT bucket, n, CASE WHEN n>=1000 OR bucket='(global)' THEN t ELSE (SELECT t FROM temp_fit WHERE bucket='(global)') END AS t, CASE WHEN n>=1000 OR bucket='(global)' THEN 'fitted' ELSE 'global' END AS source FROM temp_fit")


def _temps(t):
    return cal.fit_temperature_map(t.predictions, min_samples=1000, grid=TGRID)


@query("temperature_grid_fit", f"SELECT bucket, t, {q.r6('nll')} AS nll, n FROM temp_fit")
def temperature_grid_fit(t):
    g = cal.temperature_grid(cal.bucketed(t.predictions), TGRID, ["bucket"], total=cal.GLOBAL)
    return g.select("bucket", "t", ex.r6("nll").alias("nll"), "n")


@query("temperature_search", _search_sql("bucket_rows", "bucket", f"{q.lse('logits', 't')}-(logits[label+1]-list_max(logits))/t", 0.02, 10.0, f"{q.r6('nll')} AS nll, n"))
def temperature_search(t):
    f = cal.fit_temperature(cal.bucketed(t.predictions), ["bucket"], total=cal.GLOBAL)
    return f.select("bucket", "n", ex.r6("t", 3).alias("t"), ex.r6("nll").alias("nll"))


@query("temperature_map", "SELECT bucket, n, t, source FROM temps")
def temperature_map(t):
    return _temps(t)


cte("tempered", f"SELECT ex_id, label, qtype, k, bucket, list_transform({q.softmax('logits', 't')}, lambda z: round(z,9)) AS probs FROM (SELECT p.*, {q.bucket('qtype', 'k')} AS bucket, coalesce(s.t,(SELECT t FROM temps WHERE bucket='(global)')) AS t FROM labelled p LEFT JOIN temps s ON s.bucket={q.bucket('p.qtype', 'p.k')})")


@query("apply_temperature", f"SELECT ex_id, {q.r6('list_max(probs)', 9)} AS conf, {q.argmax0('probs')}::INT AS pick FROM tempered")
def apply_temperature(t):
    a = cal.apply_temperature(t.labelled, _temps(t)).withColumn("probs", F.transform("probs", lambda x: F.round(x, 9)))
    return a.select("ex_id", ex.r6(F.array_max("probs"), 9).alias("conf"), ex.argmax0("probs").alias("pick"))


def _bucket_ece(src: str) -> str:
    return f"""WITH rows_ AS (SELECT bucket, list_max(probs) AS conf, ({q.argmax0('probs')}=label)::INT AS correct FROM {src} UNION ALL SELECT '__aggregate__', list_max(probs), ({q.argmax0('probs')}=label)::INT FROM {src}),
e AS ({_ece_sql('bucket', 'rows_')}), o AS (SELECT bucket, e.n, round(e.ece,4) AS ece, round(a,4) AS accuracy, round(c,4) AS mean_conf FROM e JOIN (SELECT bucket, avg(correct) AS a, avg(conf) AS c FROM rows_ GROUP BY 1) USING (bucket))
SELECT *, CASE WHEN bucket='__aggregate__' THEN (SELECT max(ece) FROM o WHERE bucket<>'__aggregate__') END AS worst_bucket_ece, CASE WHEN bucket='__aggregate__' THEN round((SELECT max(ece) FROM o WHERE bucket<>'__aggregate__')/greatest(ece,1e-9),2) END AS hiding_ratio FROM o"""


@query("ece_by_bucket_raw", _bucket_ece(f"(SELECT *, {q.bucket('qtype', 'k')} AS bucket FROM labelled)"))
def ece_by_bucket_raw(t):
    return cal.ece_by_bucket(t.labelled)


@query("ece_by_bucket_tempered", _bucket_ece("tempered"))
def ece_by_bucket_tempered(t):
    a = cal.apply_temperature(t.labelled, _temps(t))
    return cal.ece_by_bucket(a.withColumn("probs", F.transform("probs", lambda x: F.round(x, 9))))


# ------------------------------------------------------------------- conformal
cte("miss", "SELECT *, abs(u_true-u_hat)/greatest(sigma,1e-6) AS s FROM intervals")
cte("conf_q", "SELECT 0.1::DOUBLE AS alpha, n, level, quantile_cont(s, level) AS q FROM (SELECT count(*) AS n, least(1.0::DOUBLE, ceil(round((count(*)+1)*0.9::DOUBLE,9))/count(*)) AS level FROM miss), miss GROUP BY n, level")
cte("conf_qq", "SELECT 0.1::DOUBLE AS alpha, n, level, list_sort(ss)[floor(level*(n-1))::INT+1]+(level*(n-1)-floor(level*(n-1)))*(list_sort(ss)[least(ceil(level*(n-1))::INT+1,n)]-list_sort(ss)[floor(level*(n-1))::INT+1]) AS q FROM (SELECT count(*) AS n, list(s) AS ss, least(1.0::DOUBLE, ceil(round((count(*)+1)*0.9::DOUBLE,9))/count(*)) AS level FROM miss)")


@query("conformal_fit", f"SELECT alpha, n, {q.r6('level')} AS level, {q.r6('q')} AS q FROM conf_qq")
def conformal_fit(t):
    f = cal.conformal_fit(t.intervals)
    return f.select("alpha", "n", ex.r6("level").alias("level"), ex.r6("q").alias("q"))


cte("covered", f"SELECT i.*, u_hat-q*sigma AS lo, u_hat+q*sigma AS hi, u_true>=u_hat-q*sigma AND u_true<=u_hat+q*sigma AS covered, sigma*q/{cal.z_two_sided(0.9)!r}::DOUBLE AS sigma_calibrated FROM intervals i, (SELECT round(q,6) AS q FROM conf_qq)")


def _covered(t):
    fit = cal.conformal_fit(t.intervals).withColumn("q", F.round("q", 6))
    return cal.with_intervals(t.intervals, fit)


@query("conformal_intervals", f"SELECT id, {q.r6('lo')} AS lo, {q.r6('hi')} AS hi, covered, {q.r6('sigma_calibrated')} AS sigma_calibrated FROM covered")
def conformal_intervals(t):
    return _covered(t).select("id", ex.r6("lo").alias("lo"), ex.r6("hi").alias("hi"), "covered", ex.r6("sigma_calibrated").alias("sigma_calibrated"))


@query("coverage_by_group", """SELECT grp, count(*) AS n, round(avg(covered::INT),4) AS coverage, NULL::DOUBLE AS target, NULL::DOUBLE AS worst_group_coverage FROM covered GROUP BY 1
UNION ALL SELECT '__overall__', count(*), round(avg(covered::INT),4), 0.9, (SELECT min(c) FROM (SELECT round(avg(covered::INT),4) AS c FROM covered GROUP BY grp)) FROM covered""")
def coverage_by_group(t):
    return cal.coverage_by_group(_covered(t))


@query("rolling_coverage", f"""SELECT grp, id, seen, {q.r6('c')} AS coverage, c<0.9::DOUBLE-0.05::DOUBLE AS drifted FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY ts, id) AS seen, avg(covered::INT) OVER (PARTITION BY grp ORDER BY ts, id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS c FROM covered)""")
def rolling_coverage(t):
    r = cal.rolling_coverage(_covered(t), ["ts", "id"], window=500)
    return r.select("grp", "id", "seen", ex.r6("coverage").alias("coverage"), "drifted")


@query("coverage_windows", f"SELECT grp, date_trunc('day', ts) AS day, count(*) AS n, {q.r6('avg(covered::INT)')} AS coverage, avg(covered::INT)<0.9::DOUBLE-0.05::DOUBLE AS drifted FROM covered GROUP BY 1,2")
def coverage_windows(t):
    from ..streaming.coverage import windowed_coverage

    w = windowed_coverage(_covered(t).withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return w.select("grp", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", ex.r6("coverage").alias("coverage"), "drifted")


cte("coral", "SELECT ex_id, rel, cum, [greatest(1.0-s[1],1e-6), greatest(s[1]-s[2],1e-6), greatest(s[2]-s[3],1e-6), greatest(s[3]-0.0,1e-6)] AS p FROM (SELECT *, list_transform(cum, lambda z: 1.0/(1.0+exp(-z))) AS s FROM cumlogits)")


def _covered_stream(t):
    fit = cal.conformal_fit(t.intervals).withColumn("q", F.round("q", 6))
    return cal.with_intervals(t.intervals_stream, fit)


@query("coverage_windows_stream", f"SELECT grp, date_trunc('day', ts) AS day, count(*) AS n, {q.r6('avg(covered::INT)')} AS coverage, avg(covered::INT)<0.9::DOUBLE-0.05::DOUBLE AS drifted FROM covered GROUP BY 1,2")
def coverage_windows_stream(t):
    """The windows of a stream over the table's files; the last state of a window counts."""
    from ..streaming.coverage import drain, windowed_coverage

    w = windowed_coverage(_covered_stream(t).withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    put = drain(w.select("grp", F.col("window.start").alias("day"), "n", "coverage", "drifted"))
    last = put.groupBy("grp", "day").agg(F.max_by(F.struct("n", "coverage", "drifted"), "batch").alias("s")).select("grp", "day", "s.*")
    return last.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("coverage", ex.r6("coverage"))


@query("coverage_last_n_stream", f"""SELECT grp, seen, {q.r6('c')} AS coverage, c<0.9::DOUBLE-0.05::DOUBLE AS drifted FROM (
SELECT grp, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY ts, id) AS seen, avg(covered::INT) OVER (PARTITION BY grp ORDER BY ts, id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS c FROM covered) WHERE seen=n""")
def coverage_last_n_stream(t):
    """Each group's coverage when the stream has read all files: the last row of rolling_coverage."""
    from ..streaming.coverage import drain, last_n_coverage

    put = drain(last_n_coverage(_covered_stream(t), window=500))
    last = put.groupBy("grp").agg(F.max_by(F.struct("seen", "coverage", "drifted"), "seen").alias("s"))
    return last.select("grp", "s.seen", ex.r6("s.coverage").alias("coverage"), "s.drifted")


@query("level_probabilities", f"SELECT ex_id, {', '.join(q.r6(f'p[{i + 1}]') + f' AS p{i}' for i in range(4))}, {q.r6('p[3]+p[4]')} AS at_least_2 FROM coral")
def level_probabilities(t):
    p = t.cumlogits.select("ex_id", cal.level_probs("cum").alias("p"))
    return p.select("ex_id", *[ex.r6(F.col("p")[i]).alias(f"p{i}") for i in range(4)], ex.r6(cal.tail_mass("p", 2)).alias("at_least_2"))


@query("decision_features", f"SELECT ex_id, {q.r6('b[1]', 9)} AS top1, {q.r6('b[1]-b[2]', 9)} AS margin, {q.r6(q.entropy('probs', '1e-9') + '/ln(k)')} AS entropy, {q.r6('k/255.0')} AS size FROM (SELECT *, list_sort(probs,'DESC') AS b FROM predictions)")
def decision_features(t):
    d = t.predictions.select("ex_id", cal.decision_features("probs").alias("f"))
    return d.select("ex_id", *[ex.r6(f"f.{c}", 9 if c in ("top1", "margin") else 6).alias(c) for c in ("top1", "margin", "entropy", "size")])


# ---------------------------------------------------------------------- losses
cte("loss_items", """SELECT qid, slate, item_id, l AS score, coalesce(grade,0) AS rel, is_anchor, is_anchor AS masked, utility FROM items""")


def _loss_items(t):
    return t.items().select("qid", "slate", "item_id", F.col("l").alias("score"), F.coalesce("grade", F.lit(0)).alias("rel"), "is_anchor", F.col("is_anchor").alias("masked"), "utility")


cte("pair_rows", """SELECT *, 2.0**rel-1 AS g, 1.0/log2(row_number() OVER (PARTITION BY qid, slate ORDER BY score DESC, item_id)+1) AS d, row_number() OVER (PARTITION BY qid, slate ORDER BY rel DESC, item_id) AS ideal FROM loss_items""")
cte("pair_sums", """SELECT qid, slate, sum(CASE WHEN ok THEN ln(1+exp(-(s)))*w ELSE 0.0 END) AS pair_loss, sum(ok::INT)::BIGINT AS pairs FROM (
SELECT a.qid, a.slate, a.score-b.score AS s, a.rel>b.rel AND NOT a.masked AND NOT b.masked AS ok, abs((a.g-b.g)*(a.d-b.d))/greatest(i.idcg,1e-9) AS w FROM pair_rows a JOIN pair_rows b ON a.qid=b.qid AND a.slate=b.slate
JOIN (SELECT qid, slate, sum(g/log2(ideal+1)) AS idcg FROM pair_rows GROUP BY 1,2) i ON i.qid=a.qid AND i.slate=a.slate) GROUP BY 1,2""")


@query("lambda_ranknet", f"SELECT qid, slate, {q.r6('pair_loss')} AS pair_loss, pairs FROM pair_sums")
def lambda_ranknet(t):
    return ls.lambda_ranknet(_loss_items(t)).withColumn("pair_loss", ex.r6("pair_loss"))


cte("list_rows", "SELECT qid, slate, -sum(exp(gain-gm)/gs*(score-sm-ln(ss))) AS list_loss FROM (SELECT *, sum(exp(gain-gm)) OVER w AS gs, sum(exp(score-sm)) OVER w AS ss FROM (SELECT *, 2.0**rel-1 AS gain, max(2.0**rel-1) OVER w AS gm, max(score) OVER w AS sm FROM loss_items WHERE NOT masked WINDOW w AS (PARTITION BY qid, slate)) WINDOW w AS (PARTITION BY qid, slate)) GROUP BY 1,2")


@query("listnet", f"SELECT qid, slate, {q.r6('list_loss')} AS list_loss FROM list_rows")
def listnet(t):
    return ls.listnet(_loss_items(t)).withColumn("list_loss", ex.r6("list_loss"))


@query("distill_kl", f"""SELECT ex_id, {q.r6('4.0*list_sum(list_transform(range(1, k+1), lambda i: probs[i]*(ln(probs[i])-((logits[i]-list_max(logits))/2.0-' + q.lse('logits', '2.0::DOUBLE') + '))))')} AS kd FROM (SELECT ex_id, k, logits, list_transform(list_transform(probs, lambda x: greatest(x,1e-8)), lambda y: y/list_sum(list_transform(probs, lambda x: greatest(x,1e-8)))) AS probs FROM predictions)""")
def distill_kl(t):
    return t.predictions.select("ex_id", ex.r6(ls.distill_kl("logits", "probs", 2.0)).alias("kd"))


cte("kl_rows", """SELECT qid, slate, sum(tt*(ln(tt)-(score-sm-ln(ss)))) AS kd_loss FROM (SELECT *, tr/sum(tr) OVER w AS tt, sum(exp(score-sm)) OVER w AS ss FROM (SELECT i.qid, i.slate, score, greatest(expected_grade,1e-8) AS tr, max(score) OVER (PARTITION BY i.qid, i.slate) AS sm
FROM loss_items i JOIN verdicts v ON v.qid=i.qid AND v.item_id=i.item_id WHERE NOT masked) WINDOW w AS (PARTITION BY qid, slate)) GROUP BY 1,2""")


@query("slate_distill_kl", f"SELECT qid, slate, {q.r6('kd_loss')} AS kd_loss FROM kl_rows")
def slate_distill_kl(t):
    rows = _loss_items(t).join(t.verdicts.select("qid", "item_id", F.col("expected_grade").alias("teacher")), ["qid", "item_id"])
    return ls.slate_kl(rows).withColumn("kd_loss", ex.r6("kd_loss"))


@query("coral_loss", f"SELECT {q.r6('sum(b)/(count(*)*3)')} AS ord FROM (SELECT list_sum(list_transform(cum, lambda z, i: greatest(z,0)+ln(1+exp(-abs(z)))-CASE WHEN rel>i-1 THEN z ELSE 0.0 END)) AS b FROM cumlogits WHERE rel IS NOT NULL)")
def coral_loss(t):
    return ls.coral_loss(t.cumlogits).withColumn("ord", ex.r6("ord"))


@query("rps_loss", f"""SELECT {q.r6('avg(x)')} AS cal FROM (SELECT ((p[1]-(rel<=0)::INT)**2+(p[1]+p[2]-(rel<=1)::INT)**2+(p[1]+p[2]+p[3]-(rel<=2)::INT)**2+(p[1]+p[2]+p[3]+p[4]-1)**2)/3 AS x FROM coral WHERE rel IS NOT NULL)""")
def rps_loss(t):
    return ls.rps_loss(t.cumlogits.select("rel", cal.level_probs("cum").alias("p"))).withColumn("cal", ex.r6("cal"))


cte("typed_rows", f"SELECT *, list_transform(logits, lambda x: (x-list_max(logits))-{q.lse('logits')}) AS lp, {q.softmax('logits')} AS sm FROM labelled")


def _typed_rows(t):
    return t.labelled.withColumn("target", ex.one_hot("label", "k")).withColumn("ordinal", F.col("qtype") == "score").withColumn("w", (F.col("ex_id") % 3 + 1).cast("double"))


_GAP = "list_sum(list_transform(range(1,k+1), lambda i: (list_sum(sm[1:i])-(CASE WHEN label<i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))**2))/(greatest(k,2)-1)"


@query("typed_losses", f"""SELECT {q.r6("sum((ex_id%3+1)*-lp[label+1])/sum(ex_id%3+1)")} AS ce, {q.r6(f"sum(CASE WHEN qtype='score' THEN (ex_id%3+1)*{_GAP} ELSE 0.0 END)/sum((qtype='score')::INT)")} AS rps,
{q.r6("avg(greatest(0.5-" + q.entropy('sm', '1e-9') + "/ln(greatest(k,2)),0.0))")} AS conf FROM typed_rows""")
def typed_losses(t):
    r = ls.typed_losses(_typed_rows(t), entropy_floor=0.5, weight="w")
    return r.withColumns({c: ex.r6(c) for c in ("ce", "rps", "conf")})


cte("mono_rows", "SELECT a.qid, a.slate, greatest(0.5-(a.l-b.l),0.0) AS v FROM items a JOIN items b ON a.qid=b.qid AND a.slate=b.slate AND a.is_anchor AND b.is_anchor AND a.utility>b.utility")


@query("anchor_monotone", f"SELECT qid, slate, {q.r6('sum(v)')} AS mono_loss, count(*) AS pairs FROM mono_rows GROUP BY 1,2")
def anchor_monotone(t):
    return ls.anchor_monotone(_loss_items(t)).withColumn("mono_loss", ex.r6("mono_loss"))


cte("affine_rows", """SELECT qid, slate, n, greatest(vu-2.0*sl*cv+sl*sl*vx,0.0)/greatest(vu,1e-6) AS affine_loss FROM (SELECT *, n*cv/greatest(n*vx,1e-6) AS sl FROM (SELECT qid, slate, count(*) AS n, covar_pop(l,utility) AS cv, var_pop(l) AS vx, var_pop(utility) AS vu FROM items WHERE is_anchor GROUP BY 1,2)) WHERE n>=2""")


@query("anchor_affine", f"SELECT qid, slate, n, {q.r6('affine_loss')} AS affine_loss FROM affine_rows")
def anchor_affine(t):
    return ls.anchor_affine(_loss_items(t)).withColumn("affine_loss", ex.r6("affine_loss"))


@query("ranking_loss_composite", f"""SELECT {q.r6('p')} AS pair, {q.r6('li')} AS list, {q.r6('an')} AS anchor, {q.r6('mo')} AS anchor_mono, {q.r6('p+li+an+0.5*mo')} AS total FROM (
SELECT (SELECT sum(pair_loss)/sum(pairs) FROM pair_sums) AS p, (SELECT avg(list_loss) FROM list_rows) AS li, (SELECT avg(affine_loss) FROM affine_rows) AS an, (SELECT avg(v) FROM mono_rows) AS mo)""")
def ranking_loss_composite(t):
    i = _loss_items(t)
    parts = {"pair": ls.lambda_ranknet_loss(i), "list": ls.listnet_loss(i), "anchor": ls.anchor_affine_loss(i), "anchor_mono": ls.anchor_monotone_loss(i)}
    c = ls.composite(parts, ls.RANKING_WEIGHTS)
    return c.select(*[ex.r6(x).alias(x) for x in c.columns])


@query("typed_loss_composite", f"""SELECT {q.r6('ce')} AS ce, {q.r6('rps')} AS rps, {q.r6('ce+rps')} AS total FROM (SELECT avg(-lp[label+1]) AS ce, sum(CASE WHEN qtype='score' THEN {_GAP} ELSE 0.0 END)/sum((qtype='score')::INT) AS rps FROM typed_rows)""")
def typed_loss_composite(t):
    r = ls.typed_losses(_typed_rows(t))
    c = ls.composite({"ce": r.select("ce"), "rps": r.select("rps")}, ls.TYPED_WEIGHTS)
    return c.select(*[ex.r6(x).alias(x) for x in ("ce", "rps", "total")])
