"""Quality against cost: fronts, improvements and usage pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.ranks import running

# fixed values: measured unit throughput and list prices
PASSES_PER_SECOND = 50 / 0.7214
MACHINE_HOUR = {"T4": 0.35, "L40S": 1.09}
MACHINE_SPEED = {"T4": 1.0, "L40S": 362 / 65}
PER_MILLION_TOKENS = 0.042
ESCALATION_TOKENS = 30 * 250 + 500
SCHEDULE = {"0": 0.30, "25k": 0.15, "100k": 0.08, "500k": 0.04, "2M": 0.02}


def pareto(points: DataFrame, cost: str = "cost_per_1k", quality: str = "quality") -> DataFrame:
    """Add ``on_front``: nothing is both as cheap and as good and better on one side.

    Equal points keep each other. The best quality per distinct cost (compared to twelve
    digits) is found first, then the best quality at any lower cost comes from a running
    maximum over range partitions, so no task sees all points.
    """
    keyed = points.withColumn("_c", F.round(cost, 12)).withColumn("_q", F.round(quality, 12))
    per_cost = keyed.groupBy("_c").agg(F.max("_q").alias("_best"))
    below = running(per_cost, [], [F.col("_c")], max_before={"_lower": "_best"}, rank="_rank")
    j = keyed.join(below.select("_c", "_best", "_lower"), "_c")
    cheaper_worse = F.col("_lower").isNull() | (F.col("_lower") < F.col("_q"))
    return j.withColumn("on_front", (F.col("_q") >= F.col("_best")) & cheaper_worse).drop("_c", "_q", "_best", "_lower")


def front_table(points: DataFrame) -> DataFrame:
    """Every point with its star and its price per million."""
    return pareto(points).withColumn("cost_per_million", F.col("cost_per_1k") * 1000.0)


def improvement_over(points: DataFrame, baseline: str) -> DataFrame:
    """At the baseline's price the best front quality; at its quality the lowest front price.

    An unknown baseline is an error when the row is read.
    """
    front = pareto(points)
    base = points.filter(F.col("name") == baseline).agg(
        F.struct(F.max("cost_per_1k").alias("c"), F.max("quality").alias("q"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    bc, bq, n = base["c"], base["q"], base["n"]
    rows = front.filter("on_front").select("name", "cost_per_1k", "quality", bc.alias("_bc"), bq.alias("_bq"), n.alias("_n"))
    can = F.col("cost_per_1k") <= F.col("_bc")
    good = F.col("quality") >= F.col("_bq")
    best_q = F.max_by("name", F.when(can, F.struct(F.col("quality"), -F.col("cost_per_1k"), F.col("name"))))
    cheapest = F.min_by("name", F.when(good, F.struct(F.col("cost_per_1k"), -F.col("quality"), F.col("name"))))
    out = rows.agg(
        F.max("_n").alias("_n"),
        F.max("_bc").alias("baseline_cost"),
        F.max("_bq").alias("baseline_quality"),
        F.max(F.when(can, F.col("quality"))).alias("quality_at_price"),
        best_q.alias("quality_from"),
        F.min(F.when(good, F.col("cost_per_1k"))).alias("cost_at_quality"),
        cheapest.alias("cost_from"),
    )
    named = F.when(F.col("_n") > 0, F.lit(baseline)).otherwise(
        F.raise_error(F.lit(f"no configuration named {baseline!r}")).cast("string")
    )
    return out.select(
        named.alias("baseline"),
        "baseline_cost",
        "baseline_quality",
        "quality_at_price",
        (F.col("quality_at_price") - F.col("baseline_quality")).alias("quality_gain"),
        "quality_from",
        "cost_at_quality",
        F.when(F.col("cost_at_quality") > 0, F.col("baseline_cost") / F.col("cost_at_quality")).alias("cost_ratio"),
        "cost_from",
    )


def usage_cost(
    usage: DataFrame, machine: str = "T4", utilisation: float = 1.0, per_million: float = PER_MILLION_TOKENS
) -> DataFrame:
    """(config, passes, escalations, tokens) rows -> price per 1k queries by component.

    ``rollup`` gives the components, the configuration's total and the grand total.
    """
    rate = MACHINE_HOUR[machine] / 3600.0 / (PASSES_PER_SECOND * MACHINE_SPEED[machine]) / utilisation
    parts = F.array(
        F.struct(F.lit("scoring").alias("component"), (F.col("passes") * rate).alias("usd")),
        F.struct(F.lit("judgement").alias("component"), (F.col("tokens") / 1e6 * per_million).alias("usd")),
    )
    rows = usage.select("config", F.inline(parts))
    return rows.rollup("config", "component").agg(
        (F.count(F.lit(1)) / F.lit(2)).alias("_n"), F.sum("usd").alias("usd"),
        F.grouping_id().alias("level"),
    ).withColumn("queries", F.when(F.col("level") == 0, F.col("_n") * 2).otherwise(F.col("_n")).cast("bigint")).select(
        "config", "component", "queries", "usd", (F.col("usd") / F.col("queries") * 1000.0).alias("usd_per_1k")
    )


def price_comparison(cost_per_1k: DataFrame, prices: dict[str, float]) -> DataFrame:
    """(config, usd_per_1k) against a price list: how many times dearer each offer is."""
    offers = ex.inline_rows([{"offer": k, "price": v} for k, v in prices.items()], {"offer": "string", "price": "double"})
    return cost_per_1k.select("config", "usd_per_1k", F.inline(offers)).withColumn(
        "ratio", F.try_divide("price", "usd_per_1k")
    )


def annealing(scoring_per_1k: DataFrame, schedule: dict[str, float] | None = None) -> DataFrame:
    """(config, usd_per_1k of scoring) -> total as the escalation rate falls with labels."""
    steps = ex.inline_rows(
        [{"labels": k, "escalation_rate": v} for k, v in (schedule or SCHEDULE).items()],
        {"labels": "string", "escalation_rate": "double"},
    )
    judged = F.col("escalation_rate") * 1000.0 * ESCALATION_TOKENS / 1e6 * PER_MILLION_TOKENS
    return scoring_per_1k.select("config", "usd_per_1k", F.inline(steps)).withColumn(
        "total_per_1k", F.col("usd_per_1k") + judged
    )
