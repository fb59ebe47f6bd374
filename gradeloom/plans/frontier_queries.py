"""Registered queries: frontier, regret, decisions, the cascade, quality against cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.draws import DRAW, MIX, SHIFTS
from ..functions.lineage import scratch_folder
from ..operators import frontier as fr, pricing
from ..streaming.escalations import stream_log
from . import sql as q
from .registry import cte, query

K, SAMPLES = 10, 256

cte("front0", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY utility DESC, item_id) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM scored")


def _front_ctes(name: str, ranked: str, k: int) -> None:
    cte(f"{name}_kth", f"SELECT qid, utility AS ku, sigma AS ks FROM {ranked} WHERE rank={k}")
    d = "sqrt(greatest(sigma*sigma+ks*ks,1e-12))"
    cte(f"{name}_p", f"SELECT f.*, ku, ks, abs(utility-ku)/{d} AS m, CASE WHEN rank={k} THEN 0.5::DOUBLE ELSE {q.phi(f'(-abs(utility-ku)/{d})')} END AS p FROM {ranked} f LEFT JOIN {name}_kth USING (qid)")
    cte(name, f"""SELECT qid, item_id, utility, sigma, rank, CASE WHEN n<={k} THEN 0.0 ELSE p END AS swap_probability, CASE WHEN n<={k} THEN 0.5 ELSE p END AS p_swap, CASE WHEN n<={k} THEN 0.0 ELSE m END AS margin,
n<={k} OR (utility+1.64::DOUBLE*sigma>=ku-1.64::DOUBLE*ks AND utility-1.64::DOUBLE*sigma<=ku+1.64::DOUBLE*ks) OR p>=0.02 AS on_frontier FROM {name}_p""")


_front_ctes("front", "front0", K)
_front_ctes("front_whole", "front0", 1000)


def _front(t, k=K):
    return fr.frontier(t.scored, k)


def _front_out(f):
    return f.select("qid", "item_id", "rank", *[ex.r6(c).alias(c) for c in ("swap_probability", "p_swap", "margin")], "on_frontier")


_FRONT_SQL = "SELECT qid, item_id, rank, " + ", ".join(f"{q.r6(c)} AS {c}" for c in ("swap_probability", "p_swap", "margin")) + ", on_frontier FROM "


@query("frontier", _FRONT_SQL + "front")
def frontier(t):
    return _front_out(_front(t))


@query("frontier_k_covers_pool", _FRONT_SQL + "front_whole")
def frontier_k_covers_pool(t):
    return _front_out(_front(t, 1000))


cte("contested", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p9 DESC, item_id) AS contest_rank FROM (SELECT *, round(p_swap,9) AS p9 FROM front) WHERE on_frontier) WHERE contest_rank<=30")


def _contested(t):
    return fr.most_contested(_front(t).withColumn("p_swap", F.round("p_swap", 9)), 30)


@query("most_contested", "SELECT qid, item_id, contest_rank FROM contested")
def most_contested(t):
    return _contested(t).select("qid", "item_id", "contest_rank")


def _regret_ctes(name: str, src: str, seed: int, clip: bool) -> None:
    rel = "greatest(drawn,0.0)" if clip else "lo+(drawn-ulo)/greatest(uhi-ulo,1e-9)*greatest(hi-lo,1e-9)"
    words = f"""SELECT s.qid, item_id, utility, sigma, row_number() OVER (PARTITION BY s.qid ORDER BY utility DESC, item_id) AS shipped, {q.word(seed, ('s.qid', 'item_id'), 1)} AS w0, {q.word(seed, ('s.qid', 'item_id'), 9)} AS w1, lo, hi, ulo, uhi
FROM {src} s JOIN (SELECT qid, greatest(min(utility),0) AS lo, greatest(max(utility),0) AS hi, min(utility) AS ulo, max(utility) AS uhi FROM {src} GROUP BY 1) r ON r.qid=s.qid"""
    mixed = f"SELECT * EXCLUDE (w0, w1), (w0+d*{DRAW[0]})&4294967295 AS x, (w1+d*{DRAW[1]})&4294967295 AS y FROM ({words}), (SELECT unnest(range({SAMPLES})) AS d)"
    for shift, factor in zip(SHIFTS, MIX):
        mixed = f"SELECT * REPLACE ((xor(x, x>>{shift})*{factor})&4294967295 AS x, (xor(y, y>>{shift})*{factor})&4294967295 AS y) FROM ({mixed})"
    drawn = f"SELECT *, utility+sigma*sqrt(-2.0*ln((xor(x, x>>16)+0.5)/4294967296.0))*cos(2.0*pi()*(xor(y, y>>16)+0.5)/4294967296.0) AS drawn FROM ({mixed})"
    cte(f"{name}_draw", f"SELECT *, 2.0::DOUBLE**({rel})-1.0 AS gain FROM ({drawn})")
    cte(name, f"""SELECT qid, avg(greatest(CASE WHEN idcg>0 THEN (idcg-dcg)/idcg ELSE 0.0 END,0.0)) AS regret FROM (
SELECT qid, d, sum(CASE WHEN best<={K} THEN gain/log2(best+1) ELSE 0.0 END) AS idcg, sum(CASE WHEN shipped<={K} THEN gain/log2(shipped+1) ELSE 0.0 END) AS dcg FROM (
SELECT *, row_number() OVER (PARTITION BY qid, d ORDER BY gain DESC, item_id) AS best FROM {name}_draw) GROUP BY 1,2) GROUP BY 1""")


_regret_ctes("regret_all", "scored", 5, False)
_regret_ctes("regret_clipped", "scored", 5, True)


def _regret(t, scale="utility"):
    return fr.expected_regret(t.scored, K, SAMPLES, seed=5, scale=scale).withColumn("regret", ex.r6("regret"))


@query("expected_regret", f"SELECT qid, {q.r6('regret')} AS regret FROM regret_all")
def expected_regret(t):
    return _regret(t)


@query("expected_regret_clipped", f"SELECT qid, {q.r6('regret')} AS regret FROM regret_clipped")
def expected_regret_clipped(t):
    return _regret(t, None)


cte("qstate", f"SELECT qid, sum(on_frontier::INT)::BIGINT AS frontier_size, max(utility) AS pool_quality, count(*) AS n_candidates, any_value(r) AS regret FROM front JOIN (SELECT qid, {q.r6('regret')} AS r FROM regret_all) USING (qid) GROUP BY 1")
cte("action_list", "SELECT * FROM (VALUES " + ",".join(f"({i},'{a['action']}',{a['cost_usd']!r}::DOUBLE,{a['latency_ms']}::DOUBLE,{a['resolves']}::DOUBLE,{a['min_frontier']})" for i, a in enumerate(fr.ACTIONS)) + ") v(no, action, cost_usd, latency_ms, resolves, min_frontier)")


def _decision_ctes(name: str, lam: str, llat: float, keys: str, src: str = "qstate") -> None:
    cte(f"{name}_values", f"""SELECT s.*, a.no, a.action, a.cost_usd, a.resolves, a.resolves*regret-{lam}*a.cost_usd-{llat}*a.latency_ms AS value FROM {src} s, action_list a
WHERE frontier_size>=min_frontier AND (a.action<>'widen_retrieval' OR pool_quality<=0.35)""")
    cte(name, f"""SELECT {keys}, regret, frontier_size, CASE WHEN value>0 THEN action ELSE 'stop' END AS action, CASE WHEN value>0 THEN value ELSE 0.0 END AS value, CASE WHEN value>0 THEN cost_usd ELSE 0.0 END AS cost, CASE WHEN value>0 THEN resolves*regret ELSE 0.0 END AS gain FROM (
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value DESC, no) AS r FROM {name}_values) WHERE r=1""")


_decision_ctes("decision", "60.0::DOUBLE", 1e-6, "qid")


@query("decide", f"SELECT d.qid, regret, frontier_size, d.action, {q.r6('d.value')} AS value, n_open FROM decision d JOIN (SELECT qid, count(*) AS n_open FROM decision_values GROUP BY 1) USING (qid)")
def decide(t):
    s = fr.query_state(_front(t), _regret(t))
    d = fr.decide(s, 60.0, 1e-6)
    return d.select("qid", "regret", "frontier_size", "action", ex.r6("value").alias("value"), ex.big(F.size("action_values")).alias("n_open"))


@query("break_even_lambda", f"SELECT qid, {q.r6('max(resolves*r/greatest(cost_usd,1e-12))', 3)} AS break_even_lambda FROM (SELECT qid, {q.r6('regret')} AS r FROM regret_all), action_list GROUP BY 1")
def break_even_lambda(t):
    b = fr.break_even_lambda(_regret(t))
    return b.select("qid", ex.r6("break_even_lambda", 3).alias("break_even_lambda"))


cte("fused_all", """SELECT s.qid, s.item_id, CASE WHEN e IS NOT NULL THEN 0.3::DOUBLE*utility+0.7::DOUBLE*(e*2.0-3.0) ELSE utility END AS utility, CASE WHEN e IS NOT NULL THEN least(sigma,0.12::DOUBLE) ELSE sigma END AS sigma, e IS NOT NULL AS judged
FROM scored s LEFT JOIN (SELECT c.qid, c.item_id, expected_grade AS e FROM contested c JOIN verdicts v ON v.qid=c.qid AND v.item_id=c.item_id) x ON x.qid=s.qid AND x.item_id=s.item_id""")


@query("fuse_verdicts", f"SELECT qid, item_id, {q.r6('utility', 8)} AS utility, {q.r6('sigma', 8)} AS sigma, judged FROM fused_all")
def fuse_verdicts(t):
    grades = _contested(t).select("qid", "item_id").join(t.verdicts, ["qid", "item_id"])
    f = fr.fuse(t.scored, grades)
    return f.select("qid", "item_id", ex.r6("utility", 8).alias("utility"), ex.r6("sigma", 8).alias("sigma"), "judged")


# the cascade: common random numbers before and after, targets only where a judge is bought
_decision_ctes("cas_decision", "60.0::DOUBLE", 0.0, "qid", "cas_state")
cte("cas_state", "SELECT qid, sum(on_frontier::INT)::BIGINT AS frontier_size, max(utility) AS pool_quality, count(*) AS n_candidates, any_value(g.regret) AS regret FROM front JOIN regret_all g USING (qid) GROUP BY 1")
cte("cas_asked", f"""SELECT c.qid, c.item_id, c.cr, c.utility, c.sigma, v.expected_grade, coalesce(v.cost_usd, v.tokens/1e6*0.042::DOUBLE) AS cost_usd, v.level_probs, v.qid IS NOT NULL AS answered FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p_swap DESC, item_id) AS cr FROM front WHERE on_frontier) WHERE cr<=30) c
LEFT JOIN (SELECT * FROM verdicts WHERE {q.u(93, 'qid', 'item_id')}>=0.1) v ON v.qid=c.qid AND v.item_id=c.item_id JOIN cas_decision d ON d.qid=c.qid WHERE d.action IN ('teacher_rubric','teacher_choice')""")
cte("cas_bought", "SELECT * FROM cas_asked WHERE answered")
cte("cas_fused", """SELECT s.qid, s.item_id, CASE WHEN e IS NOT NULL THEN 0.3::DOUBLE*s.utility+0.7::DOUBLE*(e*2.0-3.0) ELSE s.utility END AS utility, CASE WHEN e IS NOT NULL THEN least(s.sigma,0.12::DOUBLE) ELSE s.sigma END AS sigma
FROM scored s LEFT JOIN (SELECT qid, item_id, expected_grade AS e FROM cas_bought) x ON x.qid=s.qid AND x.item_id=s.item_id""")
_regret_ctes("cas_after", "cas_fused", 5, False)


def _cascade(t):
    v = t.late_verdicts.select("qid", "item_id", "expected_grade", "level_probs", "cost_usd", "tokens")
    return fr.cascade(t.scored, v, K, SAMPLES, lambda_cost=60.0, seed=5)


@query("cascade_summary", f"""SELECT d.qid, d.frontier_size, d.action, {q.r6('d.regret')} AS regret_before, {q.r6('a.regret')} AS regret_after, {q.r6('d.regret-a.regret')} AS regret_resolved, coalesce(n,0) AS n_judged, {q.r6('coalesce(c,0.0)', 9)} AS cost_usd, coalesce(n,0)>0 AS escalated,
coalesce(u,0) AS n_unanswered, coalesce((SELECT latency_ms FROM action_list l WHERE l.action=d.action),0.0) AS latency_ms
FROM cas_decision d JOIN cas_after a ON a.qid=d.qid LEFT JOIN (SELECT qid, count_if(answered) AS n, count_if(NOT answered) AS u, sum(cost_usd) AS c FROM cas_asked GROUP BY 1) b ON b.qid=d.qid""")
def cascade_summary(t):
    s = _cascade(t)["summary"]
    return s.select("qid", "frontier_size", "action", *[ex.r6(c).alias(c) for c in ("regret_before", "regret_after", "regret_resolved")], "n_judged", ex.r6("cost_usd", 9).alias("cost_usd"), "escalated", "n_unanswered", "latency_ms")


@query("cascade_order", f"SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY utility DESC, item_id) AS rank FROM cas_fused")
def cascade_order(t):
    return _cascade(t)["order"].select("qid", "item_id", "rank")


@query("unanswered_targets", "SELECT qid, item_id, cr AS contest_rank FROM cas_asked WHERE NOT answered")
def unanswered_targets(t):
    return _cascade(t)["unanswered"]


@query("escalation_log", "SELECT qid, item_id, level_probs, utility AS student_utility, sigma AS student_sigma FROM cas_bought")
def escalation_log(t):
    return _cascade(t)["log"]


@query("escalation_log_stream", "SELECT qid, item_id, level_probs, utility AS student_utility, sigma AS student_sigma FROM cas_bought")
def escalation_log_stream(t):
    """The log as a stream over what cascades wrote: every micro-batch becomes a round, read back as a table."""
    at = scratch_folder(t.spark, "escalations")
    _cascade(t)["log"].write.parquet(f"{at}/bought")
    schema = t.spark.read.parquet(f"{at}/bought").schema
    stream_log(t.spark.readStream.schema(schema).parquet(f"{at}/bought"), f"{at}/log", f"{at}/progress").awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{at}/log").drop("round")


LAMBDAS = [0.0, 10.0, 30.0, 60.0, 100.0, 300.0, 1000.0]
cte("lam_state", f"""SELECT s.*, "lambda" FROM qstate s, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LAMBDAS)}]) AS "lambda")""")
_decision_ctes("lam_decision", '"lambda"', 0.0, 'qid, "lambda"', "lam_state")


@query("lambda_sweep", f"""SELECT "lambda", count(*) AS n_queries, {q.r6('avg(cost)*1000.0')} AS cost_per_1k, {q.r6('avg(gain)')} AS quality, {q.r6("avg((action IN ('teacher_rubric','teacher_choice'))::INT)")} AS escalation_rate, {q.r6("avg((action<>'stop')::INT)")} AS acted_rate FROM lam_decision GROUP BY 1""")
def lambda_sweep(t):
    s = fr.lambda_sweep(fr.query_state(_front(t), _regret(t)), LAMBDAS)
    return s.withColumns({c: ex.r6(c) for c in ("cost_per_1k", "quality", "escalation_rate", "acted_rate")})


# --------------------------------------------------------------------- prices
cte("pareto_points", """SELECT *, NOT EXISTS (SELECT 1 FROM points b WHERE b.cost_per_1k<=a.cost_per_1k AND b.quality>=a.quality AND (b.cost_per_1k<a.cost_per_1k OR b.quality>a.quality)) AS on_front FROM points a""")


@query("pareto_front", "SELECT name, cost_per_1k, quality FROM pareto_points WHERE on_front")
def pareto_front(t):
    return pricing.pareto(t.points).filter("on_front").select("name", "cost_per_1k", "quality")


@query("front_table", f"SELECT name, family, cost_per_1k, quality, on_front, {q.r6('cost_per_1k*1000.0')} AS cost_per_million FROM pareto_points")
def front_table(t):
    return pricing.front_table(t.points).select("name", "family", "cost_per_1k", "quality", "on_front", ex.r6("cost_per_million").alias("cost_per_million"))


@query("improvement_over", """SELECT b.name AS baseline, b.cost_per_1k AS baseline_cost, b.quality AS baseline_quality, p.quality AS quality_at_price, p.quality-b.quality AS quality_gain, p.name AS quality_from, c.cost_per_1k AS cost_at_quality, round(b.cost_per_1k/c.cost_per_1k,6) AS cost_ratio, c.name AS cost_from
FROM points b, LATERAL (SELECT * FROM pareto_points x WHERE on_front AND x.cost_per_1k<=b.cost_per_1k ORDER BY quality DESC, cost_per_1k, name DESC LIMIT 1) p,
LATERAL (SELECT * FROM pareto_points x WHERE on_front AND x.quality>=b.quality ORDER BY cost_per_1k, quality DESC, name LIMIT 1) c WHERE b.name='part 100'""")
def improvement_over(t):
    return pricing.improvement_over(t.points, "part 100").withColumn("cost_ratio", ex.r6("cost_ratio"))


cte("usage", "SELECT event_type AS config, ceil(value)::BIGINT AS passes, CASE WHEN event_id%20=0 THEN 8000 ELSE 0 END AS tokens FROM events")
_RATE = f"(0.35::DOUBLE/3600.0/({pricing.PASSES_PER_SECOND!r}::DOUBLE*1.0)/0.3::DOUBLE)"
cte("usage_parts", f"SELECT config, 'scoring' AS component, passes*{_RATE} AS usd FROM usage UNION ALL SELECT config, 'judgement', tokens/1e6*0.042::DOUBLE FROM usage")


def _usage(t):
    return t.raw("events").select(
        F.col("event_type").alias("config"), F.ceil("value").cast("bigint").alias("passes"),
        F.when(F.col("event_id") % 20 == 0, 8000).otherwise(0).alias("tokens"),
    )


@query("usage_cost", f"""SELECT config, component, (CASE WHEN grouping_id(config, component)=0 THEN count(*) ELSE count(*)/2 END)::BIGINT AS queries, {q.r6('sum(usd)')} AS usd, {q.r6('sum(usd)/(CASE WHEN grouping_id(config, component)=0 THEN count(*) ELSE count(*)/2 END)*1000.0')} AS usd_per_1k FROM usage_parts GROUP BY ROLLUP(config, component)""")
def usage_cost(t):
    u = pricing.usage_cost(_usage(t), "T4", 0.3)
    return u.withColumn("usd", ex.r6("usd")).withColumn("usd_per_1k", ex.r6("usd_per_1k"))


PRICES = {"judge on everything": 0.45, "listed reranker": 0.22, "large reranker": 2.51}
cte("config_cost", "SELECT config, sum(usd)/(count(*)/2)*1000.0 AS usd_per_1k FROM usage_parts GROUP BY 1")


def _config_cost(t):
    return pricing.usage_cost(_usage(t), "T4", 0.3).filter(F.col("component").isNull() & F.col("config").isNotNull()).select("config", "usd_per_1k")


@query("price_comparison", f"SELECT config, {q.r6('usd_per_1k')} AS usd_per_1k, offer, price, {q.r6('price/usd_per_1k')} AS ratio FROM config_cost, (VALUES " + ",".join(f"('{k}',{v}::DOUBLE)" for k, v in PRICES.items()) + ") v(offer, price)")
def price_comparison(t):
    return pricing.price_comparison(_config_cost(t), PRICES).withColumns({"usd_per_1k": ex.r6("usd_per_1k"), "ratio": ex.r6("ratio")})


@query("cost_annealing", f"SELECT config, {q.r6('usd_per_1k')} AS usd_per_1k, labels, escalation_rate, {q.r6('usd_per_1k+escalation_rate*1000.0*8000/1e6*0.042::DOUBLE')} AS total_per_1k FROM config_cost, (VALUES " + ",".join(f"('{k}',{v}::DOUBLE)" for k, v in pricing.SCHEDULE.items()) + ") v(labels, escalation_rate)")
def cost_annealing(t):
    return pricing.annealing(_config_cost(t)).withColumns({"usd_per_1k": ex.r6("usd_per_1k"), "total_per_1k": ex.r6("total_per_1k")})
