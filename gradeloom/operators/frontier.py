"""Which candidates are still contested, what that may cost, and what to do about it.

Input is the scored pool (qid, item_id, utility, sigma) of a first stage, whose depth bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.lineage import cut_lineage
from .judgements import PRICE_PER_MILLION
from .regret import expected_regret

Z, P_FLOOR = 1.64, 0.02
TARGET_SIGMA = 0.12
# fixed values: price, latency and share of the regret an action resolves, in listed order
ACTIONS = [
    {"action": "teacher_rubric", "cost_usd": 0.000336, "latency_ms": 300.0, "resolves": 0.70, "min_frontier": 1},
    {"action": "teacher_choice", "cost_usd": 0.000252, "latency_ms": 300.0, "resolves": 0.55, "min_frontier": 1},
    {"action": "read_more", "cost_usd": 0.0000042, "latency_ms": 45.0, "resolves": 0.30, "min_frontier": 1},
    {"action": "widen_retrieval", "cost_usd": 0.00002, "latency_ms": 120.0, "resolves": 0.25, "min_frontier": 1},
]
_ACTION_TYPES = {"action": "string", "cost_usd": "double", "latency_ms": "double", "resolves": "double", "min_frontier": "int"}
WIDEN_BELOW = 0.35


def frontier(scored: DataFrame, k: int = 10, z: float = Z, p_floor: float = P_FLOOR) -> DataFrame:
    """Add rank, p_swap (two readings), margin and on_frontier.

    ``swap_probability`` is 0 everywhere when k covers the pool, while ``p_swap`` is then 0.5
    and every candidate is on the frontier.
    """
    w = Window.partitionBy("qid")
    u, s = F.col("utility"), F.col("sigma")
    rows = (
        scored.withColumn("rank", F.row_number().over(w.orderBy(u.desc(), "item_id")).cast("bigint"))
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_u", F.max(F.when(F.col("rank") == k, u)).over(w))
        .withColumn("_s", F.max(F.when(F.col("rank") == k, s)).over(w))
    )
    whole = F.col("_n") <= k
    joint = F.sqrt(F.greatest(s * s + F.col("_s") * F.col("_s"), F.lit(1e-12)))
    d = u - F.col("_u")
    p = F.when(F.col("rank") == k, 0.5).otherwise(ex.normal_cdf(-F.abs(d) / joint))
    overlap = (u + z * s >= F.col("_u") - z * F.col("_s")) & (u - z * s <= F.col("_u") + z * F.col("_s"))
    return (
        rows.withColumn("swap_probability", F.when(whole, 0.0).otherwise(p))
        .withColumn("p_swap", F.when(whole, 0.5).otherwise(p))
        .withColumn("margin", F.when(whole, 0.0).otherwise(F.abs(d) / joint))
        .withColumn("on_frontier", whole | overlap | (p >= p_floor))
        .drop("_n", "_u", "_s")
    )


def most_contested(front: DataFrame, m: int = 30) -> DataFrame:
    """The m frontier members most likely to change sides."""
    w = Window.partitionBy("qid").orderBy(F.col("p_swap").desc(), "item_id")
    return (
        front.filter("on_frontier")
        .withColumn("contest_rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("contest_rank") <= m)
    )


def break_even_lambda(regrets: DataFrame, actions: list[dict] | None = None, action: str | None = None) -> DataFrame:
    """The price of money at which the best action stops paying for itself."""
    specs = [a for a in (actions or ACTIONS) if action in (None, a["action"])]
    ratio = [F.lit(a["resolves"] / max(a["cost_usd"], 1e-12)) * F.col("regret") for a in specs]
    best = F.greatest(*ratio) if len(ratio) > 1 else ratio[0] if ratio else F.lit(float("inf"))
    return regrets.withColumn("break_even_lambda", best)


def decide(
    state: DataFrame,
    lambda_cost: Column | float = 1.0,
    lambda_latency: float = 0.0,
    min_value: float = 0.0,
    actions: list[dict] | None = None,
) -> DataFrame:
    """(qid, regret, frontier_size, pool_quality) -> action, value, values of all actions.

    Value = resolved regret less money and time at their prices. Widening is considered only
    for a pool whose quality is known and low. The first listed action wins a tie; nothing
    above ``min_value`` means stop. The action list is a literal inside the row.
    """
    lc = F.lit(float(lambda_cost)) if isinstance(lambda_cost, (int, float)) else lambda_cost
    specs = F.transform(
        ex.inline_rows(actions or ACTIONS, _ACTION_TYPES),
        lambda a, i: F.struct(
            (a["resolves"] * F.col("regret") - lc * a["cost_usd"] - F.lit(lambda_latency) * a["latency_ms"]).alias("value"),
            (-i).alias("neg"),
            a["action"].alias("action"),
            a["min_frontier"].alias("min_frontier"),
        ),
    )
    weak_pool = F.coalesce(F.col("pool_quality") <= WIDEN_BELOW, F.lit(False))
    open_ = F.filter(
        specs,
        lambda a: (F.col("frontier_size") >= a["min_frontier"]) & ((a["action"] != "widen_retrieval") | weak_pool),
    )
    rows = state.withColumn("_open", open_).withColumn("_best", F.array_max("_open"))
    act = F.coalesce(F.col("_best.value") > F.greatest(F.lit(0.0), F.lit(min_value)), F.lit(False))
    return (
        rows.withColumn("action", F.when(act, F.col("_best.action")).otherwise("stop"))
        .withColumn("value", F.when(act, F.col("_best.value")).otherwise(0.0))
        .withColumn("action_values", F.map_from_entries(F.transform("_open", lambda a: F.struct(a["action"], a["value"]))))
        .drop("_open", "_best")
    )


def query_state(front: DataFrame, regrets: DataFrame) -> DataFrame:
    """One row per query: regret, frontier size and the best utility as pool quality."""
    sizes = front.groupBy("qid").agg(
        F.count_if("on_frontier").alias("frontier_size"),
        F.max("utility").alias("pool_quality"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    return sizes.join(regrets, "qid")


def fuse(scored: DataFrame, grades: DataFrame, weight: float = 0.7, sigma_after: float = TARGET_SIGMA) -> DataFrame:
    """Blend judged grades (qid, item_id, expected_grade) into the utilities they cover."""
    j = scored.join(grades.select("qid", "item_id", "expected_grade"), ["qid", "item_id"], "left")
    t = F.col("expected_grade") * 2.0 - 3.0
    seen = F.col("expected_grade").isNotNull()
    return (
        j.withColumn("utility", F.when(seen, (1.0 - weight) * F.col("utility") + weight * t).otherwise(F.col("utility")))
        .withColumn("sigma", F.when(seen, F.least("sigma", F.lit(sigma_after))).otherwise(F.col("sigma")))
        .withColumn("judged", seen)
        .drop("expected_grade")
    )


def cascade(
    scored: DataFrame,
    verdicts: DataFrame | None,
    k: int = 10,
    samples: int = 256,
    lambda_cost: float = 1000.0,
    batch: int = 30,
    weight: float = 0.7,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Regret, frontier, decision, judgement, fusion and the new regret for all queries.

    ``verdicts`` is (qid, item_id, expected_grade, level_probs, cost_usd and maybe tokens), one
    without a grade never arrived; without the table nothing is judged. Returns the final order, a per-query summary (with cost and
    latency of its action), the escalation log and the targets without a verdict.
    """
    scored = cut_lineage(scored)  # the pools are read by every step below; make them once
    front = frontier(scored, k)
    before = expected_regret(scored, k, samples, seed)
    decided = cut_lineage(decide(query_state(front, before), lambda_cost))  # one row per query
    escalate = decided.filter(F.col("action").isin("teacher_rubric", "teacher_choice")).select("qid")
    targets = most_contested(front, batch).join(escalate, "qid", "left_semi")
    if verdicts is None:
        verdicts = targets.select(
            "qid", "item_id", F.lit(None).cast("double").alias("expected_grade"),
            F.lit(None).cast("array<double>").alias("level_probs"), F.lit(None).cast("double").alias("cost_usd"),
        ).filter(F.lit(False))
    if "tokens" in verdicts.columns:  # a verdict that names no price costs its tokens
        price = F.col("tokens") / 1e6 * PRICE_PER_MILLION
        verdicts = verdicts.withColumn("cost_usd", F.coalesce("cost_usd", price)).drop("tokens")
    # the escalation log's rows, and the targets that nobody answered
    asked = targets.join(verdicts, ["qid", "item_id"], "left").withColumn("_answered", F.when(F.col("expected_grade").isNotNull(), True))
    asked = cut_lineage(asked.withColumn("cost_usd", F.when(F.col("_answered"), F.col("cost_usd"))))
    bought, unanswered = asked.filter("_answered").drop("_answered"), asked.filter("_answered IS NULL").select("qid", "item_id", "contest_rank")
    fused = fuse(scored, bought, weight)
    # draws are keyed, so only a query that got a verdict has another regret than before
    changed = bought.select("qid").distinct()
    after = expected_regret(fused.join(changed, "qid", "left_semi"), k, samples, seed).unionByName(
        decided.join(changed, "qid", "left_anti").select("qid", "regret")).withColumnRenamed("regret", "regret_after")
    spend = asked.groupBy("qid").agg(
        F.count("_answered").alias("n_judged"), F.count_if(F.col("_answered").isNull()).alias("n_unanswered"), F.sum("cost_usd").alias("cost_usd"))
    latency = F.coalesce(*[F.when(F.col("action") == a["action"], F.lit(a["latency_ms"])) for a in ACTIONS], F.lit(0.0))
    summary = (
        decided.withColumnRenamed("regret", "regret_before")
        .join(after, "qid")
        .join(spend, "qid", "left")
        .fillna({"n_judged": 0, "n_unanswered": 0, "cost_usd": 0.0})
        .withColumn("latency_ms", latency)
        .withColumn("escalated", F.col("n_judged") > 0)
        .withColumn("regret_resolved", F.col("regret_before") - F.col("regret_after"))
    )
    w = Window.partitionBy("qid").orderBy(F.col("utility").desc(), "item_id")
    order = fused.withColumn("rank", F.row_number().over(w).cast("bigint"))
    log = bought.select(
        "qid", "item_id", "level_probs", F.col("utility").alias("student_utility"), F.col("sigma").alias("student_sigma")
    )
    return {"order": order, "summary": summary, "log": log, "unanswered": unanswered}


def lambda_sweep(state: DataFrame, lambdas: list[float], quality: str | None = None, **kw) -> DataFrame:
    """One row per price of money: mean cost, resolved regret and escalation rate.

    ``quality`` names a per-query quality column; the resolved regret is added to it.
    """
    rows = decide(state.withColumn("lambda", F.explode(F.array(*[F.lit(float(x)) for x in lambdas]))), F.col("lambda"), **kw)
    specs = kw.get("actions") or ACTIONS
    cost = F.coalesce(*[F.when(F.col("action") == a["action"], a["cost_usd"]) for a in specs], F.lit(0.0))
    gain_ = F.coalesce(*[F.when(F.col("action") == a["action"], a["resolves"] * F.col("regret")) for a in specs], F.lit(0.0))
    base = F.col(quality) if quality else F.lit(0.0)
    teacher = F.col("action").isin("teacher_rubric", "teacher_choice")
    return rows.groupBy("lambda").agg(
        F.count(F.lit(1)).alias("n_queries"),
        (F.avg(cost) * 1000.0).alias("cost_per_1k"),
        F.avg(base + gain_).alias("quality"),
        ex.share(teacher).alias("escalation_rate"),
        ex.share(F.col("action") != "stop").alias("acted_rate"),
    )
