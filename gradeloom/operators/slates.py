"""Dealing candidates into small scoring groups, packing them and reading scores back.

Pools come from a top-k retrieval, so a query holds at most ``depth`` candidates and a slate
at most ``max_options`` rows: windows by query and lists by slate are bounded. Everything is
keyed by ``qid`` first, so one shuffle serves the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as ex
from ..functions.lineage import cut_lineage
from .budget import slate_budget
from .text import CHARS_PER_TOKEN, cut

INSTRUCTIONS = "Which of these passages answers the query best?"


def per_slate(max_options: int, n_anchors: int) -> int:
    room = max_options - n_anchors
    if room < 1:
        raise ValueError("the anchors leave no room for candidates")
    return room


def deal(
    pool: DataFrame, max_options: int = 10, n_anchors: int = 4, stratify: bool = True, order: str = "first_rank"
) -> DataFrame:
    """Add ``slate`` (0-based): every candidate is dealt exactly once.

    Stratified dealing goes round the slates in first-stage order; blocked dealing fills one
    slate after the other.
    """
    room = per_slate(max_options, n_anchors)
    w = Window.partitionBy("qid")
    rows = pool.withColumn(
        "_at", F.row_number().over(w.orderBy(order, "doc_id")).cast("bigint") - 1
    ).withColumn("_slates", F.ceil(F.count(F.lit(1)).over(w) / F.lit(room)).cast("bigint"))
    slate = F.col("_at") % F.col("_slates") if stratify else F.floor(F.col("_at") / F.lit(room))
    return rows.withColumn("slate", slate.cast("bigint")).drop("_at", "_slates")


def anchor_slots(dealt: DataFrame, n_anchors: int = 4, pool_size: int = 4) -> DataFrame:
    """(qid, slate, slot, anchor_no): anchors rotate through the pool from slate to slate."""
    if n_anchors > pool_size:
        raise ValueError(f"need {n_anchors} anchors, the pool holds {pool_size}")
    slots = dealt.select("qid", "slate").distinct().withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))
    )
    return slots.withColumn("anchor_no", ((F.col("slate") * n_anchors + F.col("slot")) % pool_size).cast("int"))


def passes_per_query(pool: DataFrame, max_options: int = 10, n_anchors: int = 4) -> DataFrame:
    room = per_slate(max_options, n_anchors)
    return pool.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.ceil(F.count(F.lit(1)) / F.lit(room)).cast("bigint").alias("passes")
    )


def plan_problems(items: DataFrame, max_options: int = 10, n_anchors: int = 4) -> DataFrame:
    """Slates over the cap or with a wrong number of anchors; empty for a valid plan."""
    sizes = items.groupBy("qid", "slate").agg(
        F.count(F.lit(1)).alias("n_options"), F.count_if("is_anchor").alias("n_anchors")
    )
    return sizes.filter((F.col("n_options") > max_options) | (F.col("n_anchors") != n_anchors))


def shuffle_positions(items: DataFrame, seed: int = 0) -> DataFrame:
    """Random 0-based position inside each slate; joining on the item undoes it."""
    w = Window.partitionBy("qid", "slate").orderBy(ex.uniform(seed, "qid", "slate", "item_id"), "item_id")
    return items.withColumn("pos", F.row_number().over(w).cast("bigint") - 1)


# -------------------------------------------------------------------- packing
def _packed(items: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("pos", "item_id", "text")))
    return items.groupBy("qid", "slate", "query").agg(listed.alias("_i")).withColumn("n_options", F.size("_i"))


def _budget(layout: str, n_options: Column, instructions: str) -> Column:
    return slate_budget(n_options, F.lit(layout), instruction_tokens=len(instructions) // CHARS_PER_TOKEN)


def candidate_tokens(
    layout: str, n_options: Column | str | int, instructions: str = INSTRUCTIONS, query_tokens: int = 20, scaffold: int = 6
) -> Column:
    """Tokens of text that each of ``n_options`` candidates keeps in a layout."""
    n = F.lit(n_options) if isinstance(n_options, int) else ex.col(n_options)
    if layout == "options":
        return _budget(layout, n, instructions)["option_tokens"]
    share = F.floor((_budget(layout, n, instructions)["state_tokens"] - query_tokens - scaffold * n) / F.greatest(n, F.lit(1)))
    return F.greatest(F.lit(0), share).cast("int")


def pack_options(items: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """One row per slate: candidate texts are the options, the query is the state."""
    rows = _packed(items).withColumn("option_tokens", candidate_tokens("options", "n_options", instructions))
    tokens = F.col("option_tokens")
    return rows.select(
        "qid",
        "slate",
        F.lit(instructions).alias("instructions"),
        F.transform("_i", lambda x: cut(x["text"], tokens, trim=False)).alias("options"),
        F.col("query").alias("state"),
        F.transform("_i", lambda x: F.length(x["text"]) > tokens * CHARS_PER_TOKEN).alias("truncated"),
        F.transform("_i", lambda x: x["item_id"]).alias("item_ids"),
        "option_tokens",
    )


def pack_state(
    items: DataFrame, instructions: str = INSTRUCTIONS, prefix: str = "c", query_tokens: int = 20, scaffold: int = 6
) -> DataFrame:
    """One row per slate: options are bare ids, all texts share the state evenly."""
    per = F.col("per_candidate_tokens")
    rows = _packed(items).withColumn("per_candidate_tokens", candidate_tokens("state", "n_options", instructions, query_tokens, scaffold))

    def ident(i: Column) -> Column:
        return F.concat(F.lit(prefix), i.cast("string"))

    texts = F.transform("_i", lambda x, i: F.struct(ident(i), cut(x["text"], per, trim=False)))
    return rows.select(
        "qid",
        "slate",
        F.lit(instructions).alias("instructions"),
        F.transform("_i", lambda x, i: ident(i)).alias("options"),
        F.to_json(F.struct("query", F.map_from_entries(texts).alias("candidates"))).alias("state"),
        F.transform("_i", lambda x: F.length(x["text"]) > per * CHARS_PER_TOKEN).alias("truncated"),
        F.transform("_i", lambda x: x["item_id"]).alias("item_ids"),
        "per_candidate_tokens",
    )


# -------------------------------------------------------------------- scoring
def score_slates(
    packed: DataFrame, scorer: Callable[[pd.DataFrame], list[list[float]]], batch: int | None = None
) -> DataFrame:
    """Run a caller's model over packed slates: (qid, slate, log_probs).

    The scorer gets a batch (instructions, options, state) and returns one list of
    log-probabilities per row. It is called once per Arrow batch inside the task, so a model
    can be kept in the worker process.
    """
    schema = packed.select("qid", "slate", "item_ids").schema.add("log_probs", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = batch or max(len(pdf), 1)
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                out = part[["qid", "slate", "item_ids"]].copy()
                out["log_probs"] = [list(map(float, lp)) for lp in scorer(part)]
                yield out

    return packed.mapInPandas(run, schema)


def scorer_violations(scored: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Slates whose scores break the contract: one finite value per option, mass one."""
    lp = F.col("log_probs")
    mass = F.aggregate(lp, F.lit(0.0), lambda a, x: a + F.exp(x))
    problem = (
        F.when(F.size(lp) != F.size("item_ids"), "count")
        .when(F.exists(lp, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(F.abs(mass - 1.0) > tolerance, "mass")
    )
    return scored.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def unpack_scores(scored: DataFrame) -> DataFrame:
    """Long form (qid, slate, item_id, lp); positions vanish with the key."""
    pairs = F.arrays_zip(F.col("item_ids").alias("item_id"), F.col("log_probs").alias("lp"))
    return scored.select("qid", "slate", F.inline(pairs))


def two_class_score(logits: Column | str) -> Column:
    """One logit stays, two give positive minus negative."""
    a = ex.col(logits)
    return F.when(F.size(a) == 1, F.element_at(a, 1)).otherwise(F.element_at(a, 2) - F.element_at(a, 1))


def yes_probability(no: Column | str, yes: Column | str) -> Column:
    """Softmax of a (no, yes) pair."""
    return ex.sigmoid(ex.col(yes) - ex.col(no))


# ------------------------------------------------------------ training slates
MIX = {"hard": 0.3, "mixed": 0.5, "easy": 0.2}
#: Candidates of a query that training slates are drawn from in one place.
LOCAL_POOL = 1 << 14


def training_slates(
    pool: DataFrame,
    anchors: DataFrame,
    slates_per_query: int = 8,
    max_options: int = 10,
    n_anchors: int = 4,
    mix: dict[str, float] | None = None,
    seed: int = 0,
    order: str = "first_rank",
    local_pool: int = LOCAL_POOL,
) -> DataFrame:
    """Difficulty-mixed slates with quotas of positive, weak and negative candidates.

    After the quotas the picks are put in pool order and cut to the slate's size, and short
    slates are topped up at random; so a mixed slate can lose positives to the cut. Members
    come from keyed draws. Anchors (qid, anchor_no, utility) are appended to every slate. Queries
    above ``local_pool`` candidates, which are counted first, go by windows over their rows.
    """
    n = per_slate(max_options, n_anchors)
    pool = pool.select("qid", "doc_id", "grade", F.col(order).alias("_order"))
    how = (n, slates_per_query, mix or MIX, seed)
    full = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    wide = full.filter(F.col("_n") > local_pool).select("qid")
    if wide.isEmpty():
        picked = _training_local(pool, *how)
    else:
        wide = cut_lineage(wide)
        rest, large = (pool.join(wide, pool["qid"].eqNullSafe(wide["qid"]), kind) for kind in ("left_anti", "left_semi"))
        picked = _training_local(rest, *how).unionByName(_training_wide(large, *how))
    members = picked.select(
        "qid", "slate", "difficulty", "item_id", "grade",
        F.lit(None).cast("double").alias("utility"), F.lit(False).alias("is_anchor"),
    )
    # a query that has slates has all of them
    pivots = (
        _training_slates_of(full.select("qid").join(anchors.filter(F.col("anchor_no") < n_anchors), "qid"), *how[1:])
        .select(
            "qid", "slate", "difficulty", (-F.col("anchor_no") - 1).cast("bigint").alias("item_id"),
            F.lit(None).cast("int").alias("grade"), F.col("utility").cast("double").alias("utility"),
            F.lit(True).alias("is_anchor"),
        )
    )
    return members.unionByName(pivots)


def _training_slates_of(rows: DataFrame, slates_per_query: int, mix: dict[str, float], seed: int) -> DataFrame:
    """``rows`` (qid, ...) once for every slate, with its difficulty."""
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slates_per_query - 1).cast("bigint")))
    u, edge, difficulty, total = ex.uniform(seed, "qid", "slate"), 0.0, None, sum(mix.values())
    for name, part in mix.items():
        edge += part / total
        hit = u < edge
        difficulty = F.when(hit, name) if difficulty is None else difficulty.when(hit, name)
    return rows.withColumn("slate", each).withColumn("difficulty", difficulty.otherwise(list(mix)[-1]))


def _kind(grade: Column) -> Column:
    return F.when(grade >= 2, "pos").when(grade == 1, "weak").otherwise("neg")


def _quotas(n: int, has_pos: Column) -> dict[str, Column]:
    """Candidates of each kind that a slate takes."""
    easy, hard = (F.col("difficulty") == "easy") & has_pos, F.col("difficulty") == "hard"
    sizes = {"pos": (1, 0, max(1, n // 4)), "weak": (0, n // 2, n // 3), "neg": (n - 1, n - n // 2, n)}
    return {kind: F.when(easy, a).when(hard, b).otherwise(c) for kind, (a, b, c) in sizes.items()}


def _training_local(pool: DataFrame, n: int, slates_per_query: int, mix: dict[str, float], seed: int) -> DataFrame:
    """Slates drawn where a query's candidates lie: no sort sees a candidate once for every slate."""
    held = pool.groupBy("qid").agg(F.collect_list(F.struct("doc_id", "grade", "_order")).alias("_pool")).filter(F.size("_pool") >= n)
    slates = _training_slates_of(held, slates_per_query, mix, seed)
    placed = F.sort_array(F.transform("_pool", lambda d: F.struct(
        ex.uniform(seed + 1, "qid", "slate", d["doc_id"]).alias("u"), d["doc_id"].alias("item_id"), d["grade"].alias("grade"), d["_order"].alias("at"))))
    slates = ex.settle(slates, {"_by": placed}, ["qid", "slate", "difficulty"])
    quotas = _quotas(n, F.exists("_by", lambda d: d["grade"] >= 2))

    def of_kind(kind: str) -> Column:
        return F.filter("_by", lambda d: _kind(d["grade"]) == kind)

    slates = ex.settle(slates, {f"_{k}": of_kind(k) for k in quotas} | {f"_{k}_n": q for k, q in quotas.items()}, ["qid", "slate", "difficulty"])
    sampled = F.concat(*[F.slice(f"_{k}", F.lit(1), F.col(f"_{k}_n")) for k in quotas])
    rest = F.concat(*[F.slice(f"_{k}", F.col(f"_{k}_n") + 1, F.size(f"_{k}")) for k in quotas])
    in_order = F.sort_array(F.transform(sampled, lambda d: F.struct(d["at"], d["u"], d["item_id"], d["grade"])))

    def shown(rows: Column) -> Column:
        return F.transform(rows, lambda d: F.struct(d["item_id"].alias("item_id"), d["grade"].alias("grade")))

    first = F.slice(F.concat(shown(in_order), shown(F.sort_array(rest))), 1, n)
    return slates.select("qid", "slate", "difficulty", F.inline(first))


def _training_wide(pool: DataFrame, n: int, slates_per_query: int, mix: dict[str, float], seed: int) -> DataFrame:
    """The same by windows over the candidates of every slate."""
    w = Window.partitionBy("qid")
    rows = (
        pool.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_has_pos", F.max(F.col("grade") >= 2).over(w))
        .filter(F.col("_n") >= n)
    )
    rows = _training_slates_of(rows, slates_per_query, mix, seed).withColumn("_kind", _kind(F.col("grade")))
    quotas = _quotas(n, F.col("_has_pos"))
    allowed = F.when(F.col("_kind") == "pos", quotas["pos"]).when(F.col("_kind") == "weak", quotas["weak"]).otherwise(quotas["neg"])
    rows = rows.withColumn("_u", ex.uniform(seed + 1, "qid", "slate", "doc_id"))
    by_kind = Window.partitionBy("qid", "slate", "_kind").orderBy("_u", "doc_id")
    rows = rows.withColumn("_sampled", F.row_number().over(by_kind) <= allowed)
    fill = Window.partitionBy("qid", "slate").orderBy(
        F.col("_sampled").desc(), F.when(F.col("_sampled"), F.col("_order")), "_u", "doc_id"
    )
    picked = rows.withColumn("_at", F.row_number().over(fill)).filter(F.col("_at") <= n)
    return picked.select("qid", "slate", "difficulty", F.col("doc_id").alias("item_id"), "grade")


def training_slate_stats(items: DataFrame) -> DataFrame:
    """One row: counts, grade mean, share of slates with a positive, difficulty shares."""
    slates = items.filter(~F.col("is_anchor")).groupBy("qid", "slate", "difficulty").agg(
        F.count(F.lit(1)).alias("n"), F.sum("grade").alias("g"), F.max("grade").alias("top")
    )
    return slates.agg(
        F.count(F.lit(1)).alias("slates"),
        F.count_distinct("qid").alias("queries"),
        F.max("n").alias("candidates_per_slate"),
        F.round(F.sum("g") / F.sum("n"), 3).alias("grade_mean"),
        F.round(ex.share(F.col("top") >= 2), 3).alias("slates_with_a_positive"),
        *[ex.share(F.col("difficulty") == d).alias(f"{d}_share") for d in MIX],
    )


def training_grade_histogram(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("is_anchor")).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
