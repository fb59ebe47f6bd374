"""Putting slates on one scale through their reference rows, and checking that it works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as ex

METHODS = ("shift", "affine", "ridge")
BASE_SIGMA = 0.35
MAX_RESIDUAL = 0.75


def _moments(lp: str, utility: str) -> dict[str, Column]:
    """What a fit needs to know of its rows; those whose utility is NULL (candidates) take no part."""
    known = F.col(utility).isNotNull() & F.col(lp).isNotNull()
    x, u = F.when(known, F.col(lp)), F.when(known, F.col(utility))
    return {"n": F.count(x), "mx": F.avg(x), "mu": F.avg(u), "cov": F.covar_pop(x, u), "vx": F.var_pop(x), "vu": F.var_pop(u)}


def _fit_columns(moments: dict[str, Column], method: str, lam: float, prior: Column) -> dict[str, Column]:
    """Closed-form fit from moments. The residual follows from the same moments, so one pass is enough."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    n, mx, mu, cov, vx, vu = (moments[k] for k in ("n", "mx", "mu", "cov", "vx", "vu"))
    if method == "shift":
        slope, intercept = prior, mu - prior * mx
    elif method == "affine":
        flat = vx <= 0
        slope = F.when(flat, mx * mu / (mx * mx + 1.0)).otherwise(F.try_divide(cov, vx))
        intercept = F.when(flat, mu / (mx * mx + 1.0)).otherwise(mu - F.try_divide(cov, vx) * mx)
    else:
        slope = F.try_divide(n * cov + F.lit(lam) * prior, n * vx + F.lit(lam))
        intercept = mu - slope * mx
    if method != "shift":
        slope, intercept = (
            F.when(n == 1, prior).otherwise(slope),
            F.when(n == 1, mu - prior * mx).otherwise(intercept),
        )
    slope = F.when(n >= 1, slope)
    residual = F.sqrt(F.greatest(vu - 2.0 * slope * cov + slope * slope * vx, F.lit(0.0)))
    return {"slope": slope, "intercept": intercept, "residual": residual, "n_anchors": n}


def _prior(slope_prior: float | str) -> Column:
    return F.col(slope_prior) if isinstance(slope_prior, str) else F.lit(float(slope_prior))


def fit_slates(
    items: DataFrame,
    method: str = "ridge",
    lam: float = 1.0,
    slope_prior: float = 1.0,
    by: list[str] | None = None,
    lp: str = "lp",
    utility: str = "utility",
) -> DataFrame:
    """One affine map per slate from its anchors (rows with a utility)."""
    cols = _fit_columns(_moments(lp, utility), method, lam, F.lit(float(slope_prior)))
    fits = items.groupBy(*(by or ["qid", "slate"])).agg(*[c.alias(k) for k, c in cols.items()])
    return fits.withColumn("suspect", F.col("residual") > MAX_RESIDUAL)


def calibrate(
    items: DataFrame,
    method: str = "ridge",
    lam: float = 1.0,
    slope_prior: float | str = 1.0,
    by: list[str] | None = None,
    lp: str = "lp",
    base_sigma: float = BASE_SIGMA,
    least: str | None = None,
) -> DataFrame:
    """Candidates with utility and sigma on the common scale.

    The fit is a window over the slate (at most ``max_options`` rows), so candidates meet
    their map without a join and without leaving the partitioning by query. A slate without
    anchors has no map: its candidates come out with NULL, which ``unplaced`` reports. ``least``
    names a column whose smallest value over the slate's candidates is added as ``_least``.
    """
    w = Window.partitionBy(*(by or ["qid", "slate"]))
    known = items.withColumn("_u", F.when(F.col("is_anchor"), F.col("utility")))
    # as columns first: a window would work a moment out again wherever the fit mentions it
    moments = {f"_{k}": m.over(w) for k, m in _moments(lp, "_u").items()}
    if least is not None:
        moments["_least"] = F.min(F.when(~F.col("is_anchor"), F.col(least))).over(w)
    fit = _fit_columns({k: F.col(f"_{k}") for k in ("n", "mx", "mu", "cov", "vx", "vu")}, method, lam, _prior(slope_prior))
    fitted = known.withColumns(moments).withColumns(fit)
    return (
        fitted.filter(~F.col("is_anchor"))
        .withColumn("utility", F.col("slope") * F.col(lp) + F.col("intercept"))
        .withColumn("sigma", F.lit(base_sigma) * F.abs("slope") * (1.0 + F.col("residual")))
        .withColumn("suspect", F.col("residual") > MAX_RESIDUAL)
        .drop("_u", "is_anchor", "_n", "_mx", "_mu", "_cov", "_vx", "_vu")
    )


def unplaced(pool: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates that never received a utility; empty when every one was placed."""
    done = scored.filter(F.col("utility").isNotNull()).select("qid", F.col("item_id").alias("doc_id"))
    return pool.select("qid", "doc_id").join(done, ["qid", "doc_id"], "left_anti")


def orders(scored: DataFrame, lp: str = "lp") -> DataFrame:
    """Rank by calibrated utility and, for the ablation, by raw log-probability."""
    w = Window.partitionBy("qid")
    return scored.withColumn(
        "anchored_rank", F.row_number().over(w.orderBy(F.col("utility").desc(), "item_id")).cast("bigint")
    ).withColumn("naive_rank", F.row_number().over(w.orderBy(F.col(lp).desc(), "item_id")).cast("bigint"))


def slope_priors(items: DataFrame, truth: str = "truth", lp: str = "lp", by: list[str] | None = None) -> DataFrame:
    """Spread of the known values over the spread of the log-probabilities, 1 when flat."""
    spread = F.stddev_pop(lp)
    return items.groupBy(*(by or ["qid"])).agg(
        F.when(spread > 1e-9, F.stddev_pop(truth) / spread).otherwise(1.0).alias("slope_prior")
    )


def scale_report(
    items: DataFrame,
    by: list[str],
    method: str = "ridge",
    lam: float = 1.0,
    slope_prior: float | str = 1.0,
    truth: str = "truth",
) -> DataFrame:
    """Pooled agreement with the truth before and after anchoring, per group of slates.

    Slates without an anchor or without a candidate are left out.
    """
    slate = [*dict.fromkeys([*by, "qid", "slate"])]
    there, named = F.lit(True), F.lit(True)
    for c in slate:
        there = there & F.col(c).isNotNull()
    for c in by:
        named = named & F.col(c).isNotNull()
    numbered = items.filter(named).withColumn("_row", F.monotonically_increasing_id())
    cal = calibrate(numbered, method, lam, slope_prior, by=slate, least="_row").filter(F.col("slope").isNotNull())
    # one candidate speaks for its slate, so that rows are read once for slates and candidates
    one = F.col("_row") == F.col("_least")
    cal = cal.withColumns({"_s": F.when(one, F.col("slope")), "_r": F.when(one, F.col("residual")), "_there": one & there})
    report = cal.groupBy(*by).agg(
        F.count(F.when(F.col("_there"), 1)).alias("n_slates"),
        F.count(F.lit(1)).alias("n_pooled"),
        ex.safe_corr("lp", truth).alias("r_naive"),
        ex.safe_corr("utility", truth).alias("r_anchored"),
        F.sqrt(F.avg(F.pow(F.col("utility") - F.col(truth), F.lit(2.0)))).alias("rmse_anchored"),
        F.avg("_r").alias("anchor_residual_mean"),
        F.avg("_s").alias("slope_mean"),
        F.stddev_pop("_s").alias("slope_std"),
    )
    return report.withColumn("delta_r", F.col("r_anchored") - F.col("r_naive"))


SWEEP = ("r_naive", "r_anchored", "delta_r", "rmse_anchored", "anchor_residual_mean", "slope_mean", "slope_std")


def anchor_sweep(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, qid, scale report columns and ``extra``) -> one row per anchor count, means over queries."""
    return rows.groupBy("a").agg(
        *[F.avg(c).alias(c) for c in (*SWEEP, *extra)],
        F.stddev_pop("delta_r").alias("delta_r_std"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def sweep_verdict(sweep: DataFrame) -> DataFrame:
    """Best anchor count and whether the mean gain exceeds two standard errors over queries."""
    se = F.avg("delta_r_std") / F.sqrt(F.greatest(F.max("n_queries").cast("double"), F.lit(1.0)))
    return sweep.agg(
        F.max_by("a", F.struct("r_anchored", (-F.col("a")).alias("neg"))).alias("best_a"),
        F.avg("delta_r").alias("mean_delta_r"),
        se.alias("per_query_se"),
        (F.avg("delta_r") > 2.0 * se).alias("significant"),
    )


def anchor_probe(items: DataFrame) -> DataFrame:
    """Per slate: do the anchors come out in their designed order, and do they span the rest?"""
    w = Window.partitionBy("qid", "slate")
    anchor = F.col("is_anchor")
    seen = items.withColumn(
        "_r", F.when(anchor, F.row_number().over(w.orderBy(anchor.desc(), F.col("lp"), F.col("item_id"))))
    ).withColumn(
        "_d", F.when(anchor, F.row_number().over(w.orderBy(anchor.desc(), F.col("utility"), F.col("item_id"))))
    )
    spans = seen.withColumn("_lo", F.min(F.when(anchor, F.col("lp"))).over(w)).withColumn(
        "_hi", F.max(F.when(anchor, F.col("lp"))).over(w)
    )
    return spans.groupBy("qid", "slate").agg(
        ex.safe_corr(F.col("_r").cast("double"), F.col("_d").cast("double")).alias("rank_corr"),
        F.min(F.when(anchor, F.col("_r") == F.col("_d"))).alias("exact"),
        (F.max("_hi") - F.min("_lo")).alias("spread"),
        ex.share(F.when(~anchor, F.col("lp").between(F.col("_lo"), F.col("_hi")))).alias("inside"),
    )


def anchor_probe_rows(items: DataFrame) -> DataFrame:
    """Per anchor over all slates: mean and spread of its log-probability and its mean rank."""
    w = Window.partitionBy("qid", "slate").orderBy(F.col("lp").desc(), F.col("item_id"))
    only = items.filter("is_anchor").withColumn("_r", F.row_number().over(w))
    return only.groupBy("anchor_no").agg(
        F.avg("utility").alias("utility"),
        F.avg("lp").alias("mean_lp"),
        F.stddev_pop("lp").alias("std_lp"),
        F.avg("_r").alias("mean_rank"),
    )


def anchor_probe_verdict(probe: DataFrame, usable: float = 0.6, weak: float = 0.3) -> DataFrame:
    r = F.avg("rank_corr")
    return probe.agg(
        F.count(F.lit(1)).alias("n_slates"),
        r.alias("rank_corr"),
        ex.share(F.col("exact")).alias("exact_order_frac"),
        F.avg("spread").alias("spread_within_slate"),
        F.avg("inside").alias("candidates_inside"),
        F.when(r > usable, "usable").when(r > weak, "weak").otherwise("unusable").alias("verdict"),
    )


def gate_verdict(per_query: DataFrame) -> DataFrame:
    """(rmse, c_range, noise_floor per query) -> design power first, then residual over floor."""
    floor_ = F.greatest(F.avg("noise_floor"), F.lit(1e-9))
    power, ratio = F.avg("c_range") / floor_, F.avg("rmse") / floor_
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        power.alias("design_power"),
        ratio.alias("residual_over_floor"),
        F.when(power < 2.0, "INCONCLUSIVE").when(ratio < 1.5, "PASS").when(ratio < 3.0, "MARGINAL").otherwise("FAIL").alias("gate"),
    )


def order_noise(perms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., perm, item_id, lp): how far scores move when only the order changes."""
    by = by or ["qid", "slate"]
    spread = perms.groupBy(*by, "item_id").agg(
        F.stddev_samp("lp").alias("s"), (F.max("lp") - F.min("lp")).alias("range")
    )
    items = spread.groupBy(*by).agg(
        F.avg("s").alias("std_mean"), F.max("s").alias("std_max"), F.avg("range").alias("range_mean")
    )
    top = perms.groupBy(*by, "perm").agg(
        F.max_by("item_id", F.struct(F.col("lp"), (-F.col("item_id")).alias("neg"))).alias("winner")
    )
    counts = top.groupBy(*by, "winner").agg(F.count(F.lit(1)).alias("n"))
    change = counts.groupBy(*by).agg(
        (1.0 - F.max("n").cast("double") / F.sum("n")).alias("argmax_changed"), F.sum("n").alias("n_permutations")
    )
    return items.join(change, by)
