"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; a component is named by its smallest node.

    Alternating stars: every node hands the smallest node it can see to its larger neighbours,
    then to its smaller ones. A chain of n links folds in about log n rounds, links never grow
    in number, and no component is ever gathered in one row or task: minima are taken by a
    grouped aggregate (combined before the shuffle) and handed out by a join that AQE may split.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    stars = links.filter(F.col(a) != F.col(b)).select(high, low).distinct()
    while True:
        stars = cut_lineage(_small_star(_large_star(stars)))
        parents = stars.groupBy("high").agg(F.count(F.lit(1)).alias("n"))
        loose = parents.filter("n > 1").select("high").union(
            stars.select("high").join(stars.select(F.col("low").alias("high")), "high", "left_semi"))
        if loose.isEmpty():
            break
    return (
        stars.select(F.col("high").alias("node"), F.col("low").alias("component"))
        .union(stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
    )


def _large_star(stars: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node among itself and its neighbours."""
    smallest = stars.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
    # the larger neighbours of u are the rows whose low is u; a node without smaller neighbours keeps them
    return (
        stars.join(smallest, F.col("low") == F.col("u"), "left")
        .select("high", F.coalesce("m", "low").alias("low")).distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these."""
    smallest = stars.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
    joined = stars.join(smallest, F.col("high") == F.col("u"))
    return (
        joined.select(F.col("low").alias("high"), F.col("m").alias("low"))
        .union(smallest.select(F.col("u").alias("high"), F.col("m").alias("low")))
        .filter("high != low").distinct()
    )
