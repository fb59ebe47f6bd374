"""Ranking and probability metrics per query and per slice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import expr as ex
from ..functions.draws import uniforms, words
from ..functions.lineage import cut_lineage
from ..functions.ranks import running

BINS = 15
ALL = "__aggregate__"


# -------------------------------------------------------------------- ranking
def _place(df: DataFrame, by: list[str], order: list[Column], out: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= k)


def ranked_grades(run: DataFrame, qrels: DataFrame, k: int, by: list[str], score: str) -> DataFrame:
    """Top k of a run with their grades (unjudged = 0); a group limit runs before the shuffle."""
    top = _place(run.select(*by, "doc_id", score), by, [F.col(score).desc(), F.col("doc_id")], "rank", k)
    grades = qrels.select(*by, "doc_id", "grade")
    return top.join(grades, [*by, "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ndcg(
    run: DataFrame, qrels: DataFrame, k: int = 10, by: list[str] | None = None, score: str = "score"
) -> DataFrame:
    """nDCG@k per query of the run, gain 2^grade - 1, ideal over the rows of ``qrels``.

    Give the pool's own grades as ``qrels`` for a pool-normalised figure and all judgements
    for a corpus-normalised one. Both sides are cut to their top k before anything is
    shuffled, so a query with very many rows costs no more than any other.
    """
    by = by or ["qid"]
    got = (
        ranked_grades(run, qrels, k, by, score)
        .groupBy(*by)
        .agg(F.sum(ex.gain("grade") * ex.discount("rank")).alias("dcg"))
    )
    best = _place(qrels.select(*by, "doc_id", "grade"), by, [F.col("grade").desc(), F.col("doc_id")], "_r", k)
    ideal = best.groupBy(*by).agg(F.sum(ex.gain("grade") * ex.discount("_r")).alias("idcg"))
    return got.join(ideal, by, "left").select(
        *by, F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg")
    )


def recall_at_k(
    run: DataFrame,
    qrels: DataFrame,
    k: int = 10,
    threshold: int = 1,
    by: list[str] | None = None,
    score: str = "score",
) -> DataFrame:
    by = by or ["qid"]
    hits = (
        ranked_grades(run, qrels, k, by, score)
        .groupBy(*by)
        .agg(F.count_if(F.col("grade") >= threshold).alias("hits"))
    )
    total = qrels.groupBy(*by).agg(F.count_if(F.col("grade") >= threshold).alias("total"))
    return hits.join(total, by, "left").select(
        *by, F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("total")), F.lit(0.0)).alias("recall")
    )


def mrr_at_k(
    run: DataFrame,
    qrels: DataFrame,
    k: int = 10,
    threshold: int = 2,
    by: list[str] | None = None,
    score: str = "score",
) -> DataFrame:
    by = by or ["qid"]
    return (
        ranked_grades(run, qrels, k, by, score)
        .groupBy(*by)
        .agg(F.min(F.when(F.col("grade") >= threshold, F.col("rank"))).alias("first"))
        .select(*by, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))
    )


def ranking_report(run: DataFrame, qrels: DataFrame, k: int, by: list[str], score: str = "score") -> DataFrame:
    """nDCG, recall and MRR of a run in one pass over its top k."""
    top = (
        ranked_grades(run, qrels, k, by, score)
        .groupBy(*by)
        .agg(
            F.sum(ex.gain("grade") * ex.discount("rank")).alias("dcg"),
            F.count_if(F.col("grade") >= 1).alias("hits"),
            F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first"),
        )
    )
    best = _place(qrels.select(*by, "doc_id", "grade"), by, [F.col("grade").desc(), F.col("doc_id")], "_r", k)
    ideal = best.groupBy(*by).agg(F.sum(ex.gain("grade") * ex.discount("_r")).alias("idcg"))
    total = qrels.groupBy(*by).agg(F.count_if(F.col("grade") >= 1).alias("total"))
    zero = F.lit(0.0)
    return (
        top.join(ideal, by, "left")
        .join(total, by, "left")
        .select(
            *by,
            F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), zero).alias("ndcg"),
            F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("total")), zero).alias("recall"),
            F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"),
        )
    )


def judged_fraction(run: DataFrame, qrels: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """Share of the top k that carries a judgement, and that is relevant."""
    top = _place(run, ["qid"], [F.col("score").desc(), F.col("doc_id")], "rank", k)
    judged = qrels.select("qid", "doc_id", F.col("grade").alias("_g"))
    return (
        top.join(judged, ["qid", "doc_id"], "left")
        .groupBy("qid")
        .agg(
            ex.share(F.col("_g").isNotNull()).alias("judged_fraction"),
            ex.share(F.coalesce(F.col("_g"), F.lit(0)) >= threshold).alias("relevant_fraction"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def grade_histogram(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def query_grade_lists(qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """Per query: judged and relevant counts at a threshold."""
    return qrels.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_judged"),
        F.count_if(F.col("grade") >= threshold).alias("n_relevant"),
        F.max("grade").alias("top_grade"),
    )


# ---------------------------------------------------------------- probability
def prediction_columns(pred: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """Per-row confidence, correctness, Brier term and entropy confidence."""
    p = F.col(probs)
    k = F.size(p)
    brier = ex.arr_sum(
        F.transform(p, lambda x, i: F.pow(x - F.when(i == F.col(label), 1.0).otherwise(0.0), F.lit(2.0)))
    )
    return (
        pred.withColumn("conf", F.array_max(p))
        .withColumn("correct", (ex.argmax0(p) == F.col(label)).cast("int"))
        .withColumn("brier", brier)
        .withColumn("confidence", F.when(k < 2, F.lit(1.0)).otherwise(1.0 - ex.entropy(p) / F.ln(k.cast("double"))))
    )


def ece_bin(p: Column | str, n_bins: int = BINS) -> Column:
    """1-based bin of a probability, (lo, hi] with the first bin closed; NULL outside [0, 1]."""
    x = F.round(ex.col(p), 9)
    return F.when((x >= 0) & (x <= 1), F.greatest(F.ceil(x * n_bins), F.lit(1)).cast("bigint"))


def binned(df: DataFrame, by: list[str], p: str, y: str, n_bins: int = BINS) -> DataFrame:
    """Counts and sums per group and bin: all that ECE and the reliability curve need."""
    return (
        df.withColumn("bin", ece_bin(p, n_bins))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(p).cast("double")).alias("sum_p"),
            F.sum(F.col(y).cast("double")).alias("sum_y"),
        )
    )


def ece_from_bins(bins: DataFrame, by: list[str]) -> DataFrame:
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sum_y") - F.col("sum_p"))).otherwise(0.0)
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").cast("bigint").alias("n"))


def ece(df: DataFrame, by: list[str], p: str = "conf", y: str = "correct", n_bins: int = BINS) -> DataFrame:
    """Expected calibration error per group; values outside [0, 1] stay in the denominator."""
    return ece_from_bins(binned(df, by, p, y, n_bins), by)


def reliability_curve(df: DataFrame, by: list[str], p: str = "conf", y: str = "correct", n_bins: int = BINS) -> DataFrame:
    return binned(df, by, p, y, n_bins).filter(F.col("bin").isNotNull()).select(
        *by,
        "bin",
        ((F.col("bin") - 0.5) / n_bins).alias("centre"),
        (F.col("sum_p") / F.col("n")).alias("mean_conf"),
        (F.col("sum_y") / F.col("n")).alias("accuracy"),
        "n",
    )


def accuracy_and_majority(pred: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and the share of the commonest label, from per-label counts."""
    per_label = pred.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("ok")
    )
    return per_label.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum("ok").cast("double") / F.sum("n")).alias("accuracy"),
        (F.max("n").cast("double") / F.sum("n")).alias("majority"),
    )


def aurc(pred: DataFrame, by: list[str], conf: str = "conf", correct: str = "correct", tie: str = "ex_id") -> DataFrame:
    """Mean over ranks of the error rate so far, by falling confidence; ties by id.

    Slices may hold any share of the rows: ranks and running errors come from the
    range-partitioned prefix sums.
    """
    rows = pred.select(*by, conf, tie, (1 - F.col(correct)).cast("bigint").alias("_err"))
    order = [F.col(conf).desc(), F.col(tie)]
    run = running(rows, by, order, sums={"_errs": "_err"}, rank="_rank")
    return run.groupBy(*by).agg(F.avg(F.col("_errs") / F.col("_rank")).alias("aurc"))


def slice_report(pred: DataFrame, key: Column, n_bins: int = BINS) -> DataFrame:
    """All metrics per slice and over everything, worst slice and hiding ratio.

    Rows without a hard label are skipped. Every row enters twice, once under its slice and
    once under the aggregate key, and all sums are combined before the shuffle.
    """
    rows = prediction_columns(pred.filter(F.col("label").isNotNull())).select(
        F.explode(F.array(key, F.lit(ALL))).alias("slice"), "ex_id", "label", "conf", "correct", "brier"
    )
    # counts per (slice, label, bin) hold all that the metrics without ranks need
    cells = cut_lineage(
        rows.withColumn("bin", ece_bin("conf", n_bins))
        .groupBy("slice", "label", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("correct").alias("correct"),
            F.sum("conf").alias("sum_p"),
            F.sum("brier").alias("brier"),
        )
    )
    n = F.sum("n")
    heads = cells.groupBy("slice").agg(
        n.alias("n"),
        (F.sum("correct") / n).alias("accuracy"),
        (F.sum("brier") / n).alias("brier"),
        (F.sum("sum_p") / n).alias("mean_conf"),
    )
    labels = cells.groupBy("slice", "label").agg(n.alias("n")).groupBy("slice").agg(F.max("n").alias("top"))
    bins = cells.groupBy("slice", "bin").agg(
        n.alias("n"), F.sum("sum_p").alias("sum_p"), F.sum("correct").cast("double").alias("sum_y")
    )
    out = (
        heads.join(labels, "slice")
        .join(ece_from_bins(bins, ["slice"]).select("slice", "ece"), "slice")
        .join(aurc(rows, ["slice"]), "slice")
        .withColumn("majority", F.col("top") / F.col("n"))
        .select("slice", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "majority", "ece", "brier", "aurc", "mean_conf")])
    )
    out = cut_lineage(out)  # one row per slice
    worst = out.filter(F.col("slice") != ALL).agg(F.max("ece")).scalar()
    is_all = F.col("slice") == ALL
    return out.withColumn("worst_slice_ece", F.when(is_all, worst)).withColumn(
        "hiding_ratio", F.when(is_all, F.round(worst / F.greatest(F.col("ece"), F.lit(1e-9)), 2))
    )


# ---------------------------------------------------------------- comparisons
def paired_differences(a: DataFrame, b: DataFrame, key: str = "qid", value: str = "ndcg") -> DataFrame:
    """a - b per key; a key that only one side has raises an error when the rows are read."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    fine = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    msg = F.lit("a query is scored on one side of the comparison only")
    return j.select(key, F.when(fine, F.col("_a") - F.col("_b")).otherwise(F.raise_error(msg).cast("double")).alias("diff"))


#: Cumulative probabilities of a Poisson variable of mean one: a draw counts those at or below a uniform.
POISSON = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
#: Keys whose resample weights are made together, and comparisons whose sums a task keeps before it hands them on.
KEYS_AT_ONCE, SUMS_AT_ONCE = 128, 64


def resample_weights(word: np.ndarray, resamples: int) -> np.ndarray:
    """Keys x resamples: how often a key counts in each resample, Poisson(1) and keyed."""
    u = uniforms(word, resamples)
    weight = np.zeros(u.shape)
    for c in POISSON:
        weight += u >= c
    return weight


def paired_bootstrap(
    diffs: DataFrame, by: list[str], key: str = "qid", resamples: int = 10_000, seed: int = 0
) -> DataFrame:
    """Mean difference, 95 % interval and two-sided p per comparison.

    In every resample each row counts a keyed Poisson(1) number of times, and the resample's mean
    is the ratio of the two sums; a key counts alike in every comparison. All resamples of a row
    are one vector: a task adds up rows by one product of matrices and hands on two vectors
    of sums per comparison, which are added element by element as they stream in.
    """
    word, _ = words(seed, key)
    rows = diffs.filter("diff IS NOT NULL").select(*by, F.col("diff").cast("double").alias("diff"), word.alias("_word"))
    keys = [f for f in rows.schema.fields if f.name in by]
    sums = StructType([*keys, StructField("n", LongType()), StructField("total", DoubleType()), *[StructField(c, ArrayType(DoubleType())) for c in ("of_diff", "of_weight")]])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for group, (n, total, of_diff, of_weight) in held.items():
                values = [*group, n, total, of_diff, of_weight]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types)], names=arrow.names)
            held.clear()

        for batch in batches:
            names = list(zip(*(batch[f.name].to_pylist() for f in keys))) if keys else [()] * batch.num_rows
            code: dict[tuple, int] = {}
            group = np.array([code.setdefault(x, len(code)) for x in names])
            diff = batch["diff"].to_numpy()
            word, at = np.unique(batch["_word"].to_numpy(), return_inverse=True)
            for start in range(0, len(word), KEYS_AT_ONCE):
                weight = resample_weights(word[start:start + KEYS_AT_ONCE], resamples)
                mine = np.flatnonzero((at >= start) & (at < start + len(weight)))
                for x, g in code.items():
                    own = mine[group[mine] == g]
                    if len(own):
                        count, total = (np.bincount(at[own] - start, w, len(weight)) for w in (None, diff[own]))
                        sums = held.setdefault(x, [0, 0.0, np.zeros(resamples), np.zeros(resamples)])
                        sums[0] += len(own)
                        sums[1] += float(diff[own].sum())
                        sums[2] += total @ weight
                        sums[3] += count @ weight
                        if len(held) > SUMS_AT_ONCE:
                            yield from handed_on()
        yield from handed_on()

    def merged(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, of_diff, of_weight = 0, 0.0, np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for k in range(batch.num_rows):
                n, total = n + batch["n"][k].as_py(), total + batch["total"][k].as_py()
                of_diff += batch["of_diff"][k].values.to_numpy()
                of_weight += batch["of_weight"][k].values.to_numpy()
        some = of_weight > 0
        means = of_diff[some] / of_weight[some]
        lo, hi = np.percentile(means, [2.5, 97.5]) if some.any() else (None, None)
        p = min(2.0 * min((means <= 0).mean(), (means >= 0).mean()), 1.0) if some.any() else None
        values = [*(x.as_py() for x in group), n, total / n, lo, hi, p]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, result.types)], names=result.names)

    final = StructType([*keys, StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("mean_diff", "lo", "hi", "p_value")]])
    arrow, result = to_arrow_schema(sums), to_arrow_schema(final)
    return rows.mapInArrow(added, sums).groupBy(*[f.name for f in keys]).applyInArrow(merged, final)


def comparison_grid(scores: DataFrame, baseline: str, value: str = "ndcg") -> DataFrame:
    """(system, qid, value) -> per-query differences to the baseline and to the best system."""
    scores = cut_lineage(scores)  # one row per system and query, read four times
    mean = scores.groupBy("system").agg(F.avg(value).alias("m"))
    best = mean.agg(F.max_by("system", F.struct(F.col("m"), F.col("system")))).scalar()
    base = scores.filter(F.col("system") == baseline).select("qid", F.col(value).alias("_base"))
    top = scores.filter(F.col("system") == best).select("qid", F.col(value).alias("_best"))
    wide = scores.join(base, "qid").join(top, "qid")
    pairs = F.array(
        F.struct(F.lit("baseline").alias("versus"), (F.col(value) - F.col("_base")).alias("diff")),
        F.struct(F.lit("best").alias("versus"), (F.col(value) - F.col("_best")).alias("diff")),
    )
    return wide.select("system", "qid", F.inline(pairs))


def arm_comparison(arms: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(arm, accuracy, ece, brier, aurc, mean_conf) -> best arm per metric, or 'tie'."""
    metrics = ["accuracy", "ece", "brier", "aurc", "mean_conf"]
    long = arms.unpivot(["arm"], metrics, "metric", "value")
    hi, lo = F.max("value"), F.min("value")
    scale = F.when(F.max(F.abs("value")) == 0, 1.0).otherwise(F.max(F.abs("value")))
    return long.groupBy("metric").agg(
        lo.alias("lowest"),
        hi.alias("highest"),
        F.when(F.col("metric") == "mean_conf", "-")
        .when((hi - lo) / scale < tolerance, "tie")
        .when(F.col("metric") == "accuracy", F.max_by("arm", F.struct("value", "arm")))
        .otherwise(F.min_by("arm", F.struct("value", "arm")))
        .alias("best"),
    )
