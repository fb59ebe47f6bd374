"""Where the reference rows of a slate come from."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import expr as ex
from ..functions.whole import LOCAL, over_groups, split_wide, starts_of

# our own wording; grades and utilities are the fixed scale
TEMPLATES = [
    {"anchor_no": 0, "name": "off_topic", "grade": 0, "utility": -3.0,
     "template": "The harbour ferry leaves pier four at noon on weekdays and carries bicycles free of charge."},
    {"anchor_no": 1, "name": "background", "grade": 1, "utility": -1.0,
     "template": "An overview of {query}: how the subject came up and where it is studied. No finding is given."},
    {"anchor_no": 2, "name": "partial", "grade": 2, "utility": 1.0,
     "template": "Minutes of a meeting at which {query} came up twice. A figure was quoted; nobody drew a conclusion."},
    {"anchor_no": 3, "name": "direct", "grade": 3, "utility": 3.0,
     "template": "Settled: {query}. What holds, by how much, under which conditions and who measured it follows."},
]
_TYPES = {"anchor_no": "int", "name": "string", "grade": "int", "utility": "double", "template": "string"}


def grade_utility(grade: Column | str) -> Column:
    """Grade scale onto utility scale."""
    return ex.col(grade).cast("double") * 2.0 - 3.0


def templated_anchors(queries: DataFrame, templates: list[dict] | None = None, n: int = 4) -> DataFrame:
    """(qid, anchor_no, name, grade, utility, text): the same construction for every query."""
    rows = ex.inline_rows((templates or TEMPLATES)[:n], _TYPES)
    bare = F.regexp_replace(ex.strip("text"), r"\?+$", "")
    return queries.select("qid", bare.alias("_q"), F.inline(rows)).select(
        "qid", "anchor_no", "name", "grade", "utility", F.replace("template", F.lit("{query}"), "_q").alias("text")
    )


def judged_anchors(qrels: DataFrame, corpus: DataFrame, n: int = 4, seed: int = 0) -> DataFrame:
    """One judged document of the collection per grade, lowest grades first, at most n."""
    pick = F.min_by("doc_id", F.struct(ex.uniform(seed, "qid", "doc_id"), F.col("doc_id")))
    per_grade = (
        qrels.join(corpus.select("doc_id"), "doc_id", "left_semi")
        .groupBy("qid", "grade")
        .agg(pick.alias("doc_id"))
    )
    w = Window.partitionBy("qid").orderBy("grade")  # one row per grade
    return (
        per_grade.withColumn("anchor_no", F.row_number().over(w) - 1)
        .filter(F.col("anchor_no") < n)
        .withColumn("utility", grade_utility("grade"))
    )


def _greedy(items: Column, n: int, target) -> Column:
    """For n targets in turn the nearest unused item; ``items`` is array<struct<v, at>>."""

    def step(taken: Column, t: Column) -> Column:
        left = F.filter(items, lambda x: ~F.array_contains(taken, x["at"]))
        ranked = F.transform(left, lambda x: F.struct(F.round(F.abs(x["v"] - target(t)), 9).alias("gap"), x["at"].alias("at")))
        best = F.array_min(ranked)
        return F.when(best.isNull(), taken).otherwise(F.concat(taken, F.array(best["at"])))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<bigint>"), step)


def _pooled(pool: DataFrame, value: str, rank: str, depth: int) -> DataFrame:
    """One row per query with its first ``depth`` candidates as a list."""
    item = F.struct(F.col(value).cast("double").alias("v"), F.col(rank).cast("bigint").alias("at"), F.col("doc_id"))
    top = pool.filter(F.col(rank) <= depth)
    return top.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("_items"))


def graded_anchors(pool: DataFrame, n: int = 4, depth: int = 30, grade: str = "expected_grade", rank: str = "first_rank") -> DataFrame:
    """From the first ``depth`` candidates the n whose judged grades are spread most evenly.

    Targets run evenly from the lowest to the highest grade; each takes the nearest
    candidate not used yet (ties to nine digits: better first-stage rank).
    """
    lo = F.element_at(F.col("_items"), 1)["v"]
    hi = F.element_at(F.col("_items"), -1)["v"]
    picks = _greedy(F.col("_items"), n, lambda t: lo + (hi - lo) * t / F.lit(float(max(n - 1, 1))))
    return _chosen(_pooled(pool, grade, rank, depth), picks).withColumn("utility", F.col("v") * 2.0 - 3.0)


def spread_anchors(
    pool: DataFrame, n: int = 4, value: str = "utility", rank: str = "first_rank", keep: tuple[str, ...] = (), local_pool: int = LOCAL,
    most: int | None = None,
) -> DataFrame:
    """The n candidates nearest to an even grid of the 5 % to 95 % quantiles of a value.

    Targets take turns; each takes the nearest candidate not used yet (ties to nine
    digits: better rank). ``keep`` names columns of the pool that go with an anchor. Queries are
    worked on as vectors where their candidates lie; of those above ``local_pool`` candidates, a
    target can need no more than its n nearest on either side, so only these (2 n per target) are gathered.
    ``most`` is how many candidates a query has at most, where that is known.
    """
    levels = [0.05 + 0.90 * t / max(n - 1, 1) for t in range(n)]
    rows = pool.select("qid", "doc_id", F.col(value).cast("double").alias("v"), F.col(rank).cast("bigint").alias("at"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    near, wide = split_wide(rows.filter("v IS NOT NULL AND qid IS NOT NULL"), "qid", local_pool, most)
    chosen = _spread_local(near, levels)
    if wide is not None:
        chosen = chosen.unionByName(_spread_wide(wide, levels))
    return chosen.withColumnsRenamed({f"_keep_{c}": c for c in keep})


def _round9(x: np.ndarray) -> np.ndarray:
    """Nine digits as Spark rounds them: halves of the shortest decimal go up."""
    y = x * 1e9
    out = np.rint(y) / 1e9
    unsure = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) <= 1e-4 + y * 2.0**-50) | (y > 2.0**50))
    for i in unsure[np.isfinite(x[unsure])]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _spread_local(rows: DataFrame, levels: list[float]) -> DataFrame:
    own = rows.schema
    kept = [c for c in rows.columns if c.startswith("_keep_")]
    schema = StructType([
        StructField("qid", own["qid"].dataType), StructField("anchor_no", IntegerType()), StructField("doc_id", own["doc_id"].dataType),
        StructField("v", DoubleType()), StructField("rank", LongType()), *[StructField(c, own[c].dataType) for c in kept]])

    def choose(rows: pa.Table, starts: np.ndarray):
        v, n = rows["v"].to_numpy(), np.diff([*starts, len(rows)])
        query = np.repeat(np.arange(len(starts)), n)
        at = rows["at"].fill_null(0).to_numpy()
        taken = rows["at"].is_null().to_numpy().copy()  # what has no rank is not taken
        picked = np.zeros(len(rows), bool)
        last = np.iinfo(np.int64).max
        for level in levels:
            place = (n - 1) * level
            low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
            a, b = v[starts + low], v[starts + high]
            target = np.where(a == b, a, (high - place) * a + (place - low) * b)
            target = np.where(low == high, a, target)
            gap = _round9(np.abs(v - target[query]))
            gap[np.isnan(gap) | taken] = np.inf
            best = ~taken & (gap == np.minimum.reduceat(gap, starts)[query])
            pick = np.minimum.reduceat(np.where(best, at, last), starts)[query]
            now = ~taken & (at == pick) & (np.logical_or.reduceat(best, starts)[query])
            picked, taken = picked | now, taken | now
        where = np.flatnonzero(picked)
        mine = rows.take(pa.array(where))
        new = np.ones(len(where), bool)  # equal rows count once
        new[1:] = (query[where][1:] != query[where][:-1]) | (v[where][1:] != v[where][:-1]) | (at[where][1:] != at[where][:-1])
        new[starts_of(mine["doc_id"])] = True
        where, mine = where[new], mine.filter(pa.array(new))
        number = np.arange(len(where)) - np.searchsorted(query[where], query[where])
        fields = [mine["qid"], pa.array(number, pa.int32()), mine["doc_id"], mine["v"], mine["at"], *[mine[c] for c in kept]]
        yield from pa.table(fields, names=["qid", "anchor_no", "doc_id", "v", "rank", *kept]).combine_chunks().to_batches()

    return over_groups(rows, "qid", ["v", "at", "doc_id"], choose, schema)


def _spread_wide(rows: DataFrame, levels: list[float]) -> DataFrame:
    n, kept = len(levels), [c for c in rows.columns if c.startswith("_keep_")]
    targets = rows.groupBy("qid").agg(F.percentile("v", F.array(*[F.lit(x) for x in levels])).alias("_targets"))
    near = rows.join(targets, "qid").select(*rows.columns, "_targets", F.posexplode("_targets").alias("_t", "_to"))
    side = Window.partitionBy("qid", "_t", F.col("v") < F.col("_to")).orderBy(F.round(F.abs(F.col("v") - F.col("_to")), 9), "at")
    near = near.withColumn("_n", F.row_number().over(side)).filter(F.col("_n") <= n)
    item = F.struct("v", "at", "doc_id", *kept)
    gathered = near.groupBy("qid").agg(F.sort_array(F.collect_set(item)).alias("_items"), F.first("_targets").alias("_targets"))
    return _chosen(gathered, _greedy(F.col("_items"), n, lambda t: F.get("_targets", t)), kept)


def _chosen(rows: DataFrame, picks: Column, kept: list[str] | tuple[str, ...] = ()) -> DataFrame:
    held = rows.withColumn("_picks", picks)
    mine = F.filter("_items", lambda x: F.array_contains("_picks", x["at"]))
    return held.select("qid", F.posexplode(mine).alias("anchor_no", "_x")).select(
        "qid", "anchor_no", F.col("_x.doc_id").alias("doc_id"), F.col("_x.v").alias("v"), F.col("_x.at").alias("rank"), *[F.col("_x")[c].alias(c) for c in kept]
    )


def hold_out(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Remove every document that serves as an anchor for any query."""
    used = anchors.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return df.join(used, "doc_id", "left_anti")


def anchor_spread(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("qid").agg(
        F.array_sort(F.collect_list("utility")).alias("utilities"),
        (F.max("utility") - F.min("utility")).alias("spread"),
    )
