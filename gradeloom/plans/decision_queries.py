"""Registered queries: typed decision data and judgement data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.lineage import cut_lineage
from ..operators import budget, judgements as jd, typed
from ..sources import collections as col, typed_json
from . import sql as q
from .registry import cte, query
from .tables import RUBRIC

# ----------------------------------------------------------------- typed data
_K = "CASE kind WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN bad THEN 11 ELSE 4 END ELSE 2 END"
_LEVEL = "CASE WHEN length(body)<50 THEN 0 WHEN length(body)<200 THEN 1 WHEN length(body)<600 THEN 2 ELSE 3 END"
cte("typed_all", f"""SELECT ex_id, kind, bad, turn, conv_id, body, CASE kind WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS qtype, {_K} AS k,
CASE kind WHEN 0 THEN CASE WHEN bad THEN NULL WHEN role='user' THEN 0 WHEN role='assistant' THEN 1 ELSE 2 END WHEN 1 THEN {_LEVEL} ELSE CASE WHEN bad THEN NULL ELSE (role='assistant')::INT END END AS label,
CASE WHEN kind=2 AND NOT bad AND turn%2=0 THEN [0.2::DOUBLE,0.6::DOUBLE] END AS soft_label,
CASE kind WHEN 0 THEN ['user: asks','assistant: answers','system'] WHEN 1 THEN CASE WHEN bad THEN list_transform(range(11), lambda i: 'level '||i||': '||i) ELSE ['level 0: tiny','level 1: short','level 2: medium','level 3: long'] END
ELSE ['false: {typed.NOUL_FALSE}','true: {typed.NOUL_TRUE}'] END AS options,
CASE kind WHEN 1 THEN '{{"text":"'||body||'","turn":'||turn||'}}' ELSE body END AS state,
CASE kind WHEN 0 THEN 'who wrote this' WHEN 1 THEN 'how long is it' ELSE 'did the assistant write this' END AS instructions,
CASE WHEN NOT bad THEN '' WHEN kind=0 THEN 'unknown label name' WHEN kind=1 THEN 'score needs an ordered list of 2 to 10' ELSE 'no label' END AS errors FROM typed_src""")
cte("typed_ok", "SELECT * FROM typed_all WHERE NOT bad")
cte("typed_target", "SELECT *, CASE WHEN soft_label IS NOT NULL THEN list_transform(soft_label, lambda x: x/list_sum(soft_label)) ELSE list_transform(range(k), lambda i: CASE WHEN i=label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS target FROM typed_ok")


def _checked(t):
    return typed.prepare(typed_json.parse_typed_lines(t.typed_lines))


def _ok(t):
    return typed.valid(_checked(t))


@query("validate_examples", "SELECT ex_id, errors FROM typed_all")
def validate_examples(t):
    return _checked(t).select("ex_id", F.array_join("errors", "; ").alias("errors"))


@query("quarantined_examples", "SELECT ex_id, qtype, errors FROM typed_all WHERE bad")
def quarantined_examples(t):
    return typed.quarantine(_checked(t)).select("ex_id", "qtype", F.array_join("errors", "; ").alias("errors"))


@query("render_options", "SELECT ex_id, array_to_string(options,'|') AS options, k FROM typed_ok")
def render_options(t):
    return _ok(t).select("ex_id", F.array_join("options", "|").alias("options"), "k")


@query("resolve_labels", "SELECT ex_id, label FROM typed_all")
def resolve_labels(t):
    return typed.resolve_labels(typed_json.parse_typed_lines(t.typed_lines)).select("ex_id", "label")


@query("target_distribution", f"SELECT ex_id, list_transform(target, lambda x: round(x,6)) AS target FROM typed_target")
def target_distribution(t):
    return typed.with_targets(_ok(t)).select("ex_id", F.transform("target", lambda x: F.round(x, 6)).alias("target"))


cte("typed_order", f"""SELECT *, CASE WHEN kind=1 THEN range(k) ELSE list_transform(list_sort(list_transform(range(k), lambda i: {{'u': {q.u(101, "'3'", 'ex_id', 'i')}, 'i': i}})), lambda x: x.i) END AS ord FROM typed_ok""")


@query("permute_options", "SELECT ex_id, array_to_string(list_transform(ord, lambda i: options[i+1]),'|') AS options, (list_position(ord, label)-1)::INT AS label, CASE WHEN soft_label IS NOT NULL THEN list_transform(ord, lambda i: soft_label[i+1]) END AS soft_label FROM typed_order")
def permute_options(t):
    return typed.permute_options(_ok(t), epoch=3, seed=101).select("ex_id", F.array_join("options", "|").alias("options"), "label", "soft_label")


cte("label_counts", """SELECT section, key, count(*) AS n FROM (SELECT 'type' AS section, qtype AS key FROM typed_ok UNION ALL SELECT 'options', k::VARCHAR FROM typed_ok UNION ALL SELECT 'label', label::VARCHAR FROM typed_ok
UNION ALL SELECT 'soft', (soft_label IS NOT NULL)::VARCHAR FROM typed_ok UNION ALL SELECT 'examples', 'all' FROM typed_ok) WHERE key IS NOT NULL GROUP BY 1,2""")


@query("label_report", """SELECT *, round(n::DOUBLE/(SELECT n FROM label_counts WHERE section='examples'),4) AS share FROM (SELECT * FROM label_counts UNION ALL SELECT 'majority', 'baseline', max(n) FROM label_counts WHERE section='label')""")
def label_report(t):
    return typed.label_report(_ok(t))


cte("fit_counts", r"""SELECT ex_id, k, list_transform(options, lambda o: len(regexp_extract_all(o,'\S+'))) AS opt, len(regexp_extract_all(qtype||' question: '||instructions,'\S+')) AS ins, len(regexp_extract_all(state,'\S+')) AS st FROM typed_ok""")
cte("fit_capped", "SELECT *, list_transform(opt, lambda t: least(t,48)+1) AS capped FROM fit_counts")
cte("fit_shrunk", "SELECT *, 192-list_sum(capped)<16 AS shrink, CASE WHEN 192-list_sum(capped)<16 THEN list_transform(capped, lambda t: least(t,greatest(4,176//k))) ELSE capped END AS kept FROM fit_capped")
cte("fit_head", "SELECT *, least(ins, greatest(8, 192-list_sum(kept))) AS head FROM fit_shrunk")
cte("fit_rows", "SELECT *, greatest(0, 512-(head+list_sum(kept)+3)-1) AS room, least(st, greatest(0, 512-(head+list_sum(kept)+3)-1)) AS st_kept FROM fit_head")


def _fit(t):
    c = _ok(t).select(
        "ex_id",
        F.transform("options", budget.word_count).alias("opt"),
        budget.word_count(F.concat(F.col("qtype"), F.lit(" question: "), F.col("instructions"))).alias("ins"),
        budget.word_count("state").alias("st"),
    )
    return budget.sequence_fit(c, "opt", "ins", "st")


@query("sequence_fit", "SELECT ex_id, array_to_string(list_transform(kept, lambda t: t-1),',') AS kept, shrink AS shrink_fired, head::INT AS head_tokens, st_kept::INT AS state_kept, st>st_kept AS state_truncated, least(512, head+list_sum(kept)+4+st_kept)::INT AS total_tokens FROM fit_rows")
def sequence_fit(t):
    return _fit(t).select("ex_id", F.array_join("option_tokens_kept", ",").alias("kept"), "shrink_fired", "head_tokens", "state_kept", "state_truncated", "total_tokens")


cte("fit_report", """SELECT count(*) AS examples, round(sum(list_sum(kept)-k)/sum(k),1) AS option_tokens_kept_mean, round(sum(list_sum(capped)-k)/sum(k),1) AS option_tokens_wanted_mean,
round(sum(len(list_filter(list_zip(kept,capped), lambda x: x[1]<x[2])))/sum(k),3) AS option_text_lost_frac, round(avg(shrink::INT),3) AS option_shrink_fired_frac, round(avg(head),1) AS instruction_tokens_mean, round(avg(st_kept),1) AS state_tokens_mean, round(avg((st>st_kept)::INT),3) AS state_truncated_frac FROM fit_rows""")


@query("budget_report", "SELECT * FROM fit_report")
def budget_report(t):
    return budget.budget_report(_fit(t))


@query("preflight", "SELECT *, CASE WHEN state_truncated_frac>0.25 THEN 'FAIL' WHEN option_text_lost_frac>0.5 THEN 'WARN' ELSE 'PASS' END AS status FROM fit_report")
def preflight(t):
    return budget.preflight(budget.budget_report(_fit(t)))


@query("attach_soft_labels", """SELECT ex_id, CASE WHEN ex_id%7=0 THEN NULL WHEN k=3 THEN [0.5::DOUBLE,0.25::DOUBLE,0.25::DOUBLE] END AS soft_label, CASE WHEN ex_id%7=0 THEN 'missing' WHEN k=3 THEN 'attached' ELSE 'length mismatch' END AS teacher_status FROM typed_ok""")
def attach_soft_labels(t):
    rows = _ok(t)
    said = rows.filter(F.col("ex_id") % 7 != 0).select("ex_id", F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("probs"))
    return typed.attach_soft_labels(rows, said).select("ex_id", "soft_label", "teacher_status")


@query("sharpen", f"SELECT ex_id, list_transform(list_transform(p, lambda x: x/list_sum(p)), lambda y: round(y,6)+0.0) AS p FROM (SELECT ex_id, list_transform(probs, lambda x: pow(greatest(x,1e-9),1.0/0.7::DOUBLE)) AS p FROM predictions)")
def sharpen(t):
    return t.predictions.select("ex_id", F.transform(typed.sharpen("probs", 0.7), lambda x: ex.r6(x)).alias("p"))


@query("slice_keys", f"SELECT ex_id, qtype AS by_type, {q.bucket('qtype', 'k')} AS by_options, CASE WHEN kind=1 THEN conv_id::VARCHAR ELSE 'unknown' END AS by_conv FROM typed_ok")
def slice_keys(t):
    return _ok(t).select("ex_id", typed.slice_key("type").alias("by_type"), typed.slice_key("options").alias("by_options"), typed.slice_key("conv").alias("by_conv"))


@query("serialise_state", "SELECT ex_id, state FROM typed_all")
def serialise_state(t):
    return typed_json.parse_typed_lines(t.typed_lines).select("ex_id", "state")


@query("typed_split_counts", f"SELECT CASE WHEN {q.u(0, 'ex_id')}<0.7 THEN 'train' WHEN {q.u(0, 'ex_id')}<0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM typed_ok GROUP BY 1")
def typed_split_counts(t):
    return col.hash_split(_ok(t), "ex_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- judgement data
_US = "chr(31)"
cte("req_items", "SELECT p.qid, p.doc_id, p.first_rank, (p.first_rank-1)//30 AS batch, p.text FROM candidates p")
cte("requests", f"""SELECT qid, batch, 'panel' AS backend, n, substr(sha256('panel'||{_US}||'user '||qid||{_US}||sigs||{_US}||'{chr(31).join(RUBRIC)}'||{_US}),1,20) AS digest FROM (
SELECT qid, batch, count(*) AS n, string_agg(text, {_US} ORDER BY first_rank) AS sigs FROM req_items GROUP BY 1,2)""")


def _requests(t):
    rows = t.candidates.select("qid", F.concat(F.lit("user "), F.col("qid").cast("string")).alias("query"), F.col("doc_id").alias("item_id"), "first_rank", "text")
    return jd.build_requests(rows, RUBRIC, "panel", rank="first_rank")


@query("request_digest", "SELECT qid, batch, digest FROM requests")
def request_digest(t):
    return _requests(t).select("qid", "batch", "digest")


_Q = "'{\"type\":\"score\",\"instructions\":{\"question\":\"How well does candidate c'||i||' answer the query?\",\"candidate_id\":\"c'||i||'\"},\"criteria\":[" + ",".join(f'\"{r}\"' for r in RUBRIC) + "]}'"


@query("request_payloads", f"""SELECT qid, batch, '{{"state":{{"query":"user '||qid||'","candidates":{{'||string_agg('"c'||i||'":'||to_json(text)::VARCHAR, ',' ORDER BY i)||'}}}},"questions":{{'||string_agg('"c'||i||'":'||{_Q}, ',' ORDER BY i)||'}}}}' AS payload
FROM (SELECT *, (first_rank-1)%30 AS i FROM req_items) GROUP BY 1,2""")
def request_payloads(t):
    return _requests(t).select("qid", "batch", "payload")


# a fifth of the stored verdicts names no cost, a third is stored twice
cte("cached", f"""SELECT DISTINCT backend, digest, CASE WHEN {q.u(112, 'digest')}>=0.2 THEN n*0.00001::DOUBLE END AS cost_usd FROM requests WHERE {q.u(111, 'digest')}<0.6""")


def _cache(t, requests):
    cost = F.when(ex.uniform(112, "digest") >= 0.2, F.size("item_ids") * 0.00001)
    once = requests.filter(ex.uniform(111, "digest") < 0.6).select("backend", "digest", cost.alias("cost_usd"))
    return once.union(once.filter(ex.uniform(113, "digest") < 0.33))


@query("verdict_cache_hits", f"SELECT qid, digest, {q.r6('cost_usd', 9)} AS cost_usd FROM requests JOIN cached USING (backend, digest)")
def verdict_cache_hits(t):
    r = _requests(t)
    hits, _ = jd.cache_lookup(r, _cache(t, r))
    return hits.select("qid", "digest", ex.r6("cost_usd", 9).alias("cost_usd"))


@query("verdict_cache_table", f"SELECT qid, digest, {q.r6('cost_usd', 9)} AS cost_usd FROM requests JOIN cached USING (backend, digest)")
def verdict_cache_table(t):
    """The hits of a bucketed cache table that two jobs filled at once; the table goes when the hits are written."""
    r, name = _requests(t), f"verdicts_{uuid.uuid4().hex}"
    cache = cut_lineage(_cache(t, r))
    try:
        for _ in range(2):
            cache.write.mode("append").bucketBy(8, *jd.CACHE_KEY).sortBy(*jd.CACHE_KEY).saveAsTable(name)
        jd.append_verdicts(cache, name, 8)
        hits, _ = jd.cache_lookup(r, jd.cached_verdicts(t.spark, name))
        return cut_lineage(hits.select("qid", "digest", ex.r6("cost_usd", 9).alias("cost_usd")))
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("verdict_cache_misses", "SELECT qid, digest FROM requests WHERE digest NOT IN (SELECT digest FROM cached)")
def verdict_cache_misses(t):
    r = _requests(t)
    return jd.cache_lookup(r, _cache(t, r))[1].select("qid", "digest")


@query("verdict_cache_stats", f"SELECT r.backend, count(c.digest) AS hits, count(*)-count(c.digest) AS misses, {q.r6('count(c.digest)::DOUBLE/count(*)')} AS hit_rate, {q.r6('coalesce(sum(cost_usd),0.0)', 9)} AS saved_usd FROM requests r LEFT JOIN cached c ON c.digest=r.digest AND c.backend=r.backend GROUP BY 1")
def verdict_cache_stats(t):
    r = _requests(t)
    s = jd.cache_stats(r, _cache(t, r))
    return s.withColumn("hit_rate", ex.r6("hit_rate")).withColumn("saved_usd", ex.r6("saved_usd", 9))


# stored responses: some miss a candidate, some carry an empty map, some name no cost
cte("resp_items", """SELECT v.qid, v.item_id, level_probs, first_rank-1 AS pos, qid%5=1 AND first_rank=3 AS gone, qid%5=2 AND first_rank=2 AS hollow, count(*) OVER (PARTITION BY qid) AS n FROM verdicts v""")


def _responses(t):
    v = t.verdicts.withColumn("pos", F.col("first_rank") - 1)
    gone = (F.col("qid") % 5 == 1) & (F.col("first_rank") == 3)
    hollow = (F.col("qid") % 5 == 2) & (F.col("first_rank") == 2)
    dist = F.concat_ws(",", F.transform("level_probs", lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), x.cast("decimal(8,6)").cast("string"))))
    ans = F.concat(F.lit('"c'), F.col("pos").cast("string"), F.lit('":{"probabilities":{'), F.when(hollow, "").otherwise(dist), F.lit('},"confidence":0.75}'))
    v = v.withColumn("ans", F.when(~gone, ans))
    per = v.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("o"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(~gone, F.struct("pos", "ans")))), lambda x: x["ans"])).alias("body"),
    )
    cost = F.when(F.col("qid") % 4 == 0, ',"cost":0.0005').otherwise("")
    tokens = (F.size("o") * 250 + 500).cast("string")
    response = F.when(F.col("qid") % 11 == 3, '{"error":"overloaded"}').otherwise(
        F.concat(F.lit('{"answers":{'), F.col("body"), F.lit('},"usage":{"input_tokens":'), tokens, cost, F.lit("}}"))
    )
    return per.select("qid", F.transform("o", lambda x: x["item_id"]).alias("item_ids"), response.alias("response"))


@query("verdict_parse", f"""SELECT qid, item_id, CASE WHEN qid%11=3 THEN 'no answers' WHEN gone THEN 'missing answer' WHEN hollow THEN 'no distribution' END AS problem,
CASE WHEN NOT (qid%11=3 OR gone OR hollow) THEN {q.r6('list_sum(list_transform(level_probs, lambda x, i: x/list_sum(level_probs)*(i-1)))')} END AS expected_grade,
CASE WHEN qid%11=3 OR gone THEN NULL ELSE 0.75::DOUBLE END AS confidence, CASE WHEN qid%11=3 THEN 0 ELSE n*250+500 END AS input_tokens, {q.r6('CASE WHEN qid%11=3 THEN 0.0 WHEN qid%4=0 THEN 0.0005::DOUBLE ELSE (n*250+500)/1e6*0.042::DOUBLE END', 9)} AS request_cost_usd FROM resp_items""")
def verdict_parse(t):
    p = jd.parse_verdicts(_responses(t))
    return p.select("qid", "item_id", "problem", ex.r6(jd.expected_grade("level_probs")).alias("expected_grade"), "confidence", "input_tokens", ex.r6("request_cost_usd", 9).alias("request_cost_usd"))


# generic answers to the typed questions
@query("answer_parse", """SELECT ex_id, CASE WHEN ex_id%13=0 THEN 'no answer' WHEN kind<>2 AND ex_id%13=1 THEN 'no distribution' END AS problem,
CASE WHEN ex_id%13=0 OR (kind<>2 AND ex_id%13=1) THEN NULL WHEN kind=2 AND ex_id%13=1 THEN [0.5::DOUBLE,0.5::DOUBLE] WHEN kind=2 THEN [0.75::DOUBLE,0.25::DOUBLE] WHEN ex_id%13=2 THEN list_transform(range(k), lambda i: round(1.0/k,6))
WHEN kind=0 THEN [0.25::DOUBLE,0.75::DOUBLE,0.0::DOUBLE] ELSE [0.5::DOUBLE,0.0::DOUBLE,0.0::DOUBLE,0.5::DOUBLE] END AS probs FROM typed_ok""")
def answer_parse(t):
    m = F.col("ex_id") % 13
    body = F.when(F.col("qtype") == "choice", '"user":0.2,"assistant":0.6').otherwise('"0":0.3,"3":0.3')
    zero = F.when(F.col("qtype") == "choice", '"user":0.0').otherwise('"0":0.0')
    dist = F.concat(F.lit('{"probabilities":{'), F.when(m == 1, "").when(m == 2, zero).otherwise(body), F.lit("}}"))
    noul = F.when(m == 1, "{}").otherwise('{"noul":0.25}')
    answer = F.when(m != 0, F.when(F.col("qtype") == "noul", noul).otherwise(dist))
    p = jd.parse_answers(_ok(t).select("ex_id", "qtype", "option_keys", answer.alias("answer")))
    return p.select("ex_id", "problem", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"))


def _hand(t):
    """Requests answered by hand: by grades, by level rows, wrongly, or not at all."""
    rows = t.candidates.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("first_rank", "doc_id", "grade"))).alias("c")
    )
    req = rows.select(F.col("qid").alias("digest"), F.transform("c", lambda x: x["doc_id"]).alias("item_ids"))
    kind = F.col("qid") % 6
    grades = F.transform("c", lambda x: F.when((F.col("qid") % 6 == 3) & (x["first_rank"] == 1), 7).otherwise(x["grade"]))
    wide = F.transform("c", lambda x: F.transform(F.array(*[F.lit(float(i)) for i in range(4)]), lambda i: F.when(i == x["grade"], 3.0).otherwise(1.0)))
    resp = rows.filter(kind != 0).select(
        F.col("qid").alias("digest"),
        F.when(kind.isin(1, 3), grades).when(kind == 4, F.slice(grades, 1, 2)).alias("grades"),
        F.when(kind == 2, wide).alias("level_probs"),
    )
    return req, resp


cte("hand_items", "SELECT qid, doc_id AS item_id, grade, first_rank, qid%6 AS kind FROM candidates")


@query("hand_verdicts", f"""SELECT qid AS digest, item_id, kind=0 AS pending, CASE kind WHEN 3 THEN 'grade off the rubric' WHEN 4 THEN 'count mismatch' WHEN 5 THEN 'neither grades nor level_probs' END AS problem,
CASE WHEN kind>=3 THEN NULL WHEN kind=0 THEN [0.25::DOUBLE,0.25::DOUBLE,0.25::DOUBLE,0.25::DOUBLE] WHEN kind=2 THEN list_transform(range(4), lambda i: round(CASE WHEN i=grade THEN 0.5::DOUBLE ELSE 1.0/6 END,6))
ELSE list_transform(range(4), lambda i: round(CASE WHEN i=grade THEN 0.9::DOUBLE ELSE 0.1::DOUBLE*exp(-abs(i-grade))/list_sum(list_transform(range(4), lambda j: CASE WHEN j=grade THEN 0.0::DOUBLE ELSE exp(-abs(j-grade)) END)) END,6)) END AS level_probs FROM hand_items""")
def hand_verdicts(t):
    v = jd.hand_verdicts(*_hand(t))
    return v.select("digest", "item_id", "pending", "problem", F.transform("level_probs", lambda x: F.round(x, 6)).alias("level_probs"))


@query("outstanding_requests", "SELECT DISTINCT qid AS digest FROM hand_items WHERE kind=0")
def outstanding_requests(t):
    return jd.outstanding(*_hand(t)).select("digest")


@query("expected_grade", f"SELECT qid, item_id, {q.r6('level_probs[2]+2*level_probs[3]+3*level_probs[4]')} AS expected_grade FROM verdicts")
def expected_grade(t):
    return t.verdicts.select("qid", "item_id", ex.r6(jd.expected_grade("level_probs")).alias("expected_grade"))


@query("verdict_problems", "SELECT qid, item_id, CASE item_id%9 WHEN 1 THEN 'mass' WHEN 2 THEN 'count' END AS problem FROM verdicts")
def verdict_problems(t):
    bent = F.when(F.col("item_id") % 9 == 1, F.transform("level_probs", lambda x: x * 1.5)).when(
        F.col("item_id") % 9 == 2, F.slice("level_probs", 1, 3)
    ).otherwise(F.col("level_probs"))
    return jd.check_verdicts(t.verdicts.withColumn("level_probs", bent)).select("qid", "item_id", "problem")


@query("smooth_grades", f"""SELECT qid, item_id, list_transform(range(4), lambda i: round(CASE WHEN i=grade THEN 0.9::DOUBLE ELSE 0.1::DOUBLE*exp(-abs(i-grade))/list_sum(list_transform(range(4), lambda j: CASE WHEN j=grade THEN 0.0::DOUBLE ELSE exp(-abs(j-grade)) END)) END,6)) AS p FROM verdicts""")
def smooth_grades(t):
    return t.verdicts.select("qid", "item_id", F.transform(jd.smooth_grade("grade"), lambda x: F.round(x, 6)).alias("p"))


@query("spend_ledger", f"""SELECT backend, count(*) AS requests, sum(hit::INT)::BIGINT AS hits, {q.r6('avg(hit::INT)')} AS hit_rate, sum(CASE WHEN NOT hit THEN tokens ELSE 0 END)::BIGINT AS tokens_paid, {q.r6('sum(CASE WHEN NOT hit THEN c ELSE 0.0 END)', 9)} AS spend_usd, {q.r6('sum(CASE WHEN hit THEN c ELSE 0.0 END)', 9)} AS saved_usd
FROM (SELECT 'judge '||(qid%3) AS backend, item_id%3=0 AS hit, tokens, coalesce(cost_usd, tokens/1e6*0.042::DOUBLE) AS c FROM verdicts) GROUP BY 1""")
def spend_ledger(t):
    v = t.verdicts.select(
        F.concat(F.lit("judge "), (F.col("qid") % 3).cast("string")).alias("backend"), (F.col("item_id") % 3 == 0).alias("hit"),
        F.col("tokens").alias("input_tokens"), F.coalesce("cost_usd", F.col("tokens") / 1e6 * jd.PRICE_PER_MILLION).alias("cost_usd"),
    )
    s = jd.spend_ledger(v)
    return s.withColumns({"hit_rate": ex.r6("hit_rate"), "spend_usd": ex.r6("spend_usd", 9), "saved_usd": ex.r6("saved_usd", 9)})


cte("student_probs", """SELECT qid, item_id, list_transform(w, lambda x: round(x/list_sum(w),6)) AS student, level_probs AS teacher FROM (SELECT *, list_transform(range(4), lambda i: exp(-2.0*abs(i-(l+1.0)))) AS w FROM verdicts)""")
cte("disagree", f"SELECT *, least(list_max(student),list_max(teacher)) AS s, {q.argmax0('student')}::INT AS sp, {q.argmax0('teacher')}::INT AS tp FROM student_probs")


@query("confident_disagreements", "SELECT qid, item_id, place, s AS sureness, sp AS student_pick, tp AS teacher_pick FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS place FROM disagree WHERE s>=0.4 AND sp<>tp) WHERE place<=10")
def confident_disagreements(t):
    w = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.exp(-2.0 * F.abs(i - (F.col("l") + 1.0))))
    v = t.verdicts.withColumn("w", w).withColumn("student", F.transform(ex.normalise("w"), lambda x: F.round(x, 6)))
    return jd.confident_disagreements(
        v.select("qid", "item_id", F.col("student").alias("probs")), v.select("qid", "item_id", F.col("level_probs").alias("probs")), 0.4
    )


@query("throughput", f"SELECT event_type AS system, sum(event_id%10+1)::BIGINT AS items, {q.r6('sum(value)')} AS total_ms, {q.r6('sum(value)/sum(event_id%10+1)')} AS ms_per_item, {q.r6('sum(event_id%10+1)/sum(value)*1000.0')} AS items_per_second FROM events GROUP BY 1")
def throughput(t):
    e = t.raw("events").select(F.col("event_type").alias("system"), (F.col("event_id") % 10 + 1).alias("items"), F.col("value").alias("ms"))
    r = jd.throughput(e)
    return r.select("system", "items", *[ex.r6(c).alias(c) for c in ("total_ms", "ms_per_item", "items_per_second")])
