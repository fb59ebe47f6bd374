"""How much evidence about a candidate a scorer needs: layouts and signatures against each other.

Every configuration (layout, signature) packs the same probes into the same slates, has them scored by
the caller's model and fits the additive model to what comes back. The fitted latent value of a
probe is held against its grade, per query, so that configurations are compared in pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_corr
from ..functions.lineage import cut_lineage
from . import retrieval, slates, text as tx
from .budget import LAYOUTS
from .designs import block_design, fit_additive
from .evaluation import ndcg, paired_bootstrap

KINDS = ("title", "lexical", "title+lexical")
CONFIGS = tuple((layout, kind) for layout in LAYOUTS for kind in KINDS)
NO_SIGNAL, STARVED = 0.25, 0.10


def evidence_rows(
    probes: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    score: Callable[[pd.DataFrame], list[list[float]]],
    configs: tuple[tuple[str, str], ...] = CONFIGS,
    slate_size: int = 10,
    n_slates: int = 30,
    k: int = 10,
    seed: int = 0,
    index: DataFrame | None = None,
) -> DataFrame:
    """One row per (config, qid): recall, corr, ndcg and the first stage's ndcg on the same probes.

    ``probes`` is (qid, doc_id, grade, first_score, title, text, window): what
    :func:`retrieval.balanced_probes` chose, with the columns that signatures are cut from. Their number
    per query is bounded by the probe quota. ``score`` is the caller's model, as for
    :func:`slates.score_slates`. A candidate's share of a slate decides how long its signature is. A
    probe that no slate drew has the latent value 0; latent values are compared to six digits.
    """
    spark = probes.sparkSession
    share = {layout: spark.range(1).select(slates.candidate_tokens(layout, slate_size)).first()[0] for layout in LAYOUTS}
    choices = F.array(*[
        F.struct(F.lit(f"{layout}/{kind}").alias("config"), F.lit(layout).alias("layout"), F.lit(share[layout]).alias("tokens_per_candidate"),
                 tx.signature(kind, share[layout]).alias("signature"))
        for layout, kind in configs])
    cuts = cut_lineage(probes.select("qid", "doc_id", "grade", "first_score", F.inline(choices)))
    kept = retrieval.with_signature_recall(cuts.select("config", "qid", "doc_id", "signature"), corpus, queries, index=index)
    recall = kept.groupBy("config", "qid").agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n_probes"))

    design = block_design(probes.select("qid", "doc_id", "grade"), slate_size, n_slates, 0.5, seed).select("qid", "slate", "item_id")
    texts = cuts.select("qid", F.col("doc_id").alias("item_id"), "config", "layout", F.col("signature").alias("text"))
    asked = queries.select("qid", F.col("text").alias("query"))
    # every configuration is a query of its own to the packers and to the fit
    own = F.concat_ws("|", "config", F.col("qid").cast("string"))
    items = design.join(texts, ["qid", "item_id"]).join(asked, "qid").withColumn("qid", own)
    items = slates.shuffle_positions(items, seed + 3)
    packed = [pack(items.filter(F.col("layout") == layout)).select("qid", "slate", "instructions", "options", "state", "item_ids")
              for layout, pack in (("options", slates.pack_options), ("state", slates.pack_state)) if layout in {c[0] for c in configs}]
    scored = slates.score_slates(packed[0].unionByName(packed[1]) if len(packed) > 1 else packed[0], score)
    fit = fit_additive(slates.unpack_scores(scored).withColumnRenamed("lp", "y"))
    latent = fit.groupBy(F.col("qid").alias("_own"), F.col("item_id").alias("doc_id")).agg(F.round(F.first("l_hat"), 6).alias("latent"))

    rows = cuts.drop("signature").withColumn("_own", own).join(latent, ["_own", "doc_id"], "left")
    rows = cut_lineage(rows.withColumn("latent", F.coalesce("latent", F.lit(0.0)) + 0.0).drop("_own"))
    by = ["config", "qid"]
    grades = rows.select(*by, "doc_id", "grade")
    found = ndcg(rows, grades, k, by, score="latent")
    first = ndcg(rows, grades, k, by, score="first_score").withColumnRenamed("ndcg", "ndcg_first")
    corr = rows.groupBy(*by, "layout", "tokens_per_candidate").agg(safe_corr("latent", F.col("grade").cast("double"), 1e-9).alias("corr"))
    return corr.join(recall, by).join(found, by).join(first, by)


def evidence_sweep(rows: DataFrame) -> DataFrame:
    """One row per configuration; recall is the mean over probes, the rest over queries."""
    return rows.groupBy("config", "tokens_per_candidate").agg(
        (F.sum(F.col("recall") * F.col("n_probes")) / F.sum("n_probes")).alias("signature_recall"),
        F.avg("corr").alias("corr"),
        (F.stddev_pop("corr") / F.greatest(F.lit(1.0), F.sqrt(F.count("corr")))).alias("corr_se"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("ndcg_first").alias("ndcg_first"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def evidence_pairs(rows: DataFrame, resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """(config, versus, n, mean_diff, lo, hi, p_value): every configuration against the first stage
    and against the configuration of the highest mean nDCG, query by query."""
    best = rows.groupBy("config").agg(F.round(F.avg("ndcg"), 9).alias("m")).agg(F.max_by("config", F.struct("m", "config")))
    top = rows.join(F.broadcast(best.toDF("config")), "config").select("qid", F.col("ndcg").alias("_top"))  # one name
    versus = F.array(
        F.struct(F.lit("first stage").alias("versus"), (F.col("ndcg") - F.col("ndcg_first")).alias("diff")),
        F.struct(F.lit("best").alias("versus"), (F.col("ndcg") - F.col("_top")).alias("diff")))
    diffs = rows.join(top, "qid").select("config", "qid", F.inline(versus))
    return paired_bootstrap(diffs, ["config", "versus"], resamples=resamples, seed=seed)


def evidence_verdict(sweep: DataFrame, no_signal: float = NO_SIGNAL, starved: float = STARVED) -> DataFrame:
    """Best and worst configuration by correlation and what the spread means."""
    best, worst = F.max("corr"), F.min("corr")
    return sweep.agg(
        F.max_by("config", F.struct("corr", "config")).alias("best"),
        F.min_by("config", F.struct("corr", "config")).alias("worst"),
        best.alias("best_corr"),
        (best - worst).alias("spread"),
        F.when(best < no_signal, "no_signal")
        .when(best - worst > starved, "starved")
        .otherwise("signal_present")
        .alias("verdict"),
    )
