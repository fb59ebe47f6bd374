"""Loss figures over prediction tables: diagnostics of scores, no gradients.

A slate holds at most ``max_options`` rows (checked by ``plan_problems``), so its rows may be
gathered into one list; pairs are summed inside that list and never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as ex

RANKING_WEIGHTS = {"pair": 1.0, "list": 1.0, "kd": 2.0, "ord": 0.5, "cal": 1.0, "anchor": 1.0, "anchor_mono": 0.5}
TYPED_WEIGHTS = {"ce": 1.0, "rps": 1.0, "conf": 0.0}


# ------------------------------------------------------------------- rankings
def lambda_ranknet(items: DataFrame, score: str = "score", rel: str = "rel", masked: str = "masked") -> DataFrame:
    """Per slate: summed pair losses weighted by the nDCG a swap would change, and pair count.

    Ranks, gains and the ideal use every row of the slate; only unmasked rows form pairs.
    """
    w = Window.partitionBy("qid", "slate")
    rows = (
        items.withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc(), "item_id")))
        .withColumn("_i", F.row_number().over(w.orderBy(F.col(rel).desc(), "item_id")))
        .withColumn("_g", ex.gain(rel))
    )
    entry = F.struct(
        F.col(score).alias("s"), F.col(rel).alias("rel"), F.col("_g").alias("g"), ex.discount("_r").alias("d"),
        (~F.col(masked)).alias("on"),
    )
    slates = rows.groupBy("qid", "slate").agg(
        F.collect_list(entry).alias("_l"),
        F.greatest(F.sum(F.col("_g") * ex.discount("_i")), F.lit(1e-9)).alias("_idcg"),
    )
    zero = F.struct(F.lit(0.0).alias("loss"), F.lit(0).cast("bigint").alias("pairs"))

    def against(a: Column):
        def add(acc: Column, b: Column) -> Column:
            weight = F.abs((a["g"] - b["g"]) * (a["d"] - b["d"])) / F.col("_idcg")
            use = a["on"] & b["on"] & (a["rel"] > b["rel"])
            return F.struct(
                (acc["loss"] + F.when(use, ex.softplus(b["s"] - a["s"]) * weight).otherwise(0.0)).alias("loss"),
                (acc["pairs"] + F.when(use, 1).otherwise(0)).cast("bigint").alias("pairs"),
            )

        return add

    per_item = F.transform("_l", lambda a: F.aggregate("_l", zero, against(a)))
    total = F.aggregate(
        per_item, zero,
        lambda acc, x: F.struct((acc["loss"] + x["loss"]).alias("loss"), (acc["pairs"] + x["pairs"]).alias("pairs")),
    )
    return slates.withColumn("_t", total).select(
        "qid", "slate", F.col("_t.loss").alias("pair_loss"), F.col("_t.pairs").alias("pairs")
    )


def lambda_ranknet_loss(items: DataFrame, **kw) -> DataFrame:
    per = lambda_ranknet(items, **kw)
    return per.agg((F.sum("pair_loss") / F.greatest(F.sum("pairs"), F.lit(1))).alias("pair"))


def listnet(items: DataFrame, score: str = "score", rel: str = "rel", masked: str = "masked", tau: float = 1.0) -> DataFrame:
    """Per slate: cross-entropy of the gain softmax against the score softmax, unmasked rows."""
    rows = items.filter(~F.col(masked)).withColumn("_s", F.col(score) / tau).withColumn(
        "_g", ex.gain(F.greatest(F.col(rel), F.lit(0))) / tau
    )
    rows = ex.log_softmax_rows(ex.log_softmax_rows(rows, "_s", ["qid", "slate"], "_lp"), "_g", ["qid", "slate"], "_lq")
    return rows.groupBy("qid", "slate").agg((-F.sum(F.exp("_lq") * F.col("_lp"))).alias("list_loss"))


def listnet_loss(items: DataFrame, **kw) -> DataFrame:
    return listnet(items, **kw).agg(F.avg("list_loss").alias("list"))


def distill_kl(student: Column | str, teacher: Column | str, tau: float = 1.0) -> Column:
    """KL(teacher || student) * tau^2 of one row's arrays; the teacher is floored at 1e-8."""
    t = ex.normalise(F.transform(ex.col(teacher), lambda x: F.greatest(x, F.lit(1e-8))))
    lp = ex.log_softmax(student, tau)
    return ex.arr_sum(F.zip_with(t, lp, lambda p, q: p * (F.ln(p) - q))) * (tau * tau)


def slate_kl(items: DataFrame, score: str = "score", teacher: str = "teacher", masked: str = "masked", tau: float = 1.0) -> DataFrame:
    """Per slate KL between the teacher's shares and the score softmax, over unmasked rows."""
    by = ["qid", "slate"]
    rows = items.filter(~F.col(masked)).withColumn("_s", F.col(score) / tau)
    rows = ex.log_softmax_rows(rows, "_s", by, "_lp")
    rows = rows.withColumn("_t", F.greatest(F.col(teacher), F.lit(1e-8)))
    rows = rows.withColumn("_t", F.col("_t") / F.sum("_t").over(Window.partitionBy(*by)))
    return rows.groupBy(*by).agg((F.sum(F.col("_t") * (F.ln("_t") - F.col("_lp"))) * (tau * tau)).alias("kd_loss"))


def coral(cumulative: Column | str, rel: Column | str) -> Column:
    """Summed binary cross-entropy of the K-1 questions 'above level k?'."""
    return ex.arr_sum(
        F.transform(
            ex.col(cumulative),
            lambda z, k: ex.softplus(z) - F.when(ex.col(rel) > k, z).otherwise(0.0),
        )
    )


def coral_loss(rows: DataFrame, cumulative: str = "cum", rel: str = "rel") -> DataFrame:
    """Mean over thresholds and graded rows."""
    graded = rows.filter(F.col(rel).isNotNull())
    return graded.agg((F.sum(coral(cumulative, rel)) / F.greatest(F.sum(F.size(cumulative)), F.lit(1))).alias("ord"))


def rps(probs: Column | str, level: Column | str) -> Column:
    """Ranked probability score of level probabilities against a grade."""
    p = ex.col(probs)
    k = F.size(p)
    at = F.least(F.greatest(ex.col(level), F.lit(0)), k - 1)
    return ex.cumulative_gap(p, ex.one_hot(at, k)) / (k - 1)


def rps_loss(rows: DataFrame, probs: str = "p", rel: str = "rel") -> DataFrame:
    return rows.filter(F.col(rel).isNotNull()).agg(F.coalesce(F.avg(rps(probs, rel)), F.lit(0.0)).alias("cal"))


# -------------------------------------------------------------------- anchors
def anchor_monotone(items: DataFrame, score: str = "score", margin: float = 0.5) -> DataFrame:
    """Per slate: hinge violations summed over anchor pairs of rising utility, and pair count."""
    lists = items.filter("is_anchor").groupBy("qid", "slate").agg(
        F.collect_list(F.struct(F.col(score).alias("s"), F.col("utility").alias("u"))).alias("_l")
    )
    zero = F.struct(F.lit(0.0).alias("loss"), F.lit(0).cast("bigint").alias("pairs"))

    def over(a: Column):
        def add(acc: Column, b: Column) -> Column:
            use = a["u"] > b["u"]
            viol = F.greatest(F.lit(margin) - (a["s"] - b["s"]), F.lit(0.0))
            return F.struct(
                (acc["loss"] + F.when(use, viol).otherwise(0.0)).alias("loss"),
                (acc["pairs"] + F.when(use, 1).otherwise(0)).cast("bigint").alias("pairs"),
            )

        return add

    total = F.aggregate(
        F.transform("_l", lambda a: F.aggregate("_l", zero, over(a))), zero,
        lambda acc, x: F.struct((acc["loss"] + x["loss"]).alias("loss"), (acc["pairs"] + x["pairs"]).alias("pairs")),
    )
    return lists.withColumn("_t", total).select("qid", "slate", F.col("_t.loss").alias("mono_loss"), F.col("_t.pairs").alias("pairs"))


def anchor_monotone_loss(items: DataFrame, **kw) -> DataFrame:
    return anchor_monotone(items, **kw).agg(
        F.coalesce(F.try_divide(F.sum("mono_loss"), F.sum("pairs")), F.lit(0.0)).alias("anchor_mono")
    )


def anchor_affine(items: DataFrame, score: str = "score", eps: float = 1e-6) -> DataFrame:
    """Per slate with two or more anchors: share of utility variance a line leaves over."""
    n = F.count(F.lit(1))
    sxx = F.greatest(n * F.var_pop(score), F.lit(eps))
    slope = n * F.covar_pop(score, "utility") / sxx
    left = F.var_pop("utility") - 2.0 * slope * F.covar_pop(score, "utility") + slope * slope * F.var_pop(score)
    return (
        items.filter("is_anchor").groupBy("qid", "slate")
        .agg(n.alias("n"), (F.greatest(left, F.lit(0.0)) / F.greatest(F.var_pop("utility"), F.lit(eps))).alias("affine_loss"))
        .filter(F.col("n") >= 2)
    )


def anchor_affine_loss(items: DataFrame, **kw) -> DataFrame:
    return anchor_affine(items, **kw).agg(F.coalesce(F.avg("affine_loss"), F.lit(0.0)).alias("anchor"))


# ------------------------------------------------------------ typed decisions
def typed_ce(logits: Column | str, target: Column | str) -> Column:
    return -ex.arr_sum(F.zip_with(ex.col(target), ex.log_softmax(logits), lambda t, lp: t * lp))


def typed_losses(rows: DataFrame, entropy_floor: float = 0.0, logits: str = "logits", target: str = "target", weight: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """One row (ce, rps, conf): cross-entropy, ordinal RPS over score rows, entropy penalty.

    RPS divides by the number of ordinal rows even when rows are weighted.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    p = ex.softmax(logits)
    k = F.greatest(F.size(logits), F.lit(2))
    is_ord = F.col(ordinal)
    gap = ex.cumulative_gap(p, F.col(target)) / (k - 1)
    ent = ex.entropy(p, 1e-9) / F.ln(k.cast("double"))
    pen = F.greatest(F.lit(entropy_floor) - ent, F.lit(0.0)) if entropy_floor > 0 else F.lit(0.0)
    return rows.agg(
        (F.sum(w * typed_ce(logits, target)) / F.greatest(F.sum(w), F.lit(1e-9))).alias("ce"),
        (F.coalesce(F.sum(F.when(is_ord, w * gap)), F.lit(0.0)) / F.greatest(F.count_if(is_ord), F.lit(1))).alias("rps"),
        F.avg(pen).alias("conf"),
    )


def composite(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted sum of one-row loss tables; each part brings the column it is named after."""
    names = list(parts)
    terms = [parts[n].select(F.lit(n).alias("part"), F.col(n).alias("value")) for n in names]
    rows = terms[0]
    for t in terms[1:]:
        rows = rows.unionByName(t)
    weight = F.coalesce(*[F.when(F.col("part") == n, F.lit(float(weights.get(n, 0.0)))) for n in names])
    cols = [F.max(F.when(F.col("part") == n, F.col("value"))).alias(n) for n in names]
    return rows.agg(*cols, F.sum(weight * F.col("value")).alias("total"))
