"""Temperatures, conformal intervals, coverage and level probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import expr as ex
from ..functions.joins import few
from ..functions.lineage import cut_lineage
from ..functions.ranks import exact_quantile, running
from .evaluation import ALL, binned, ece_from_bins

GLOBAL = "(global)"
MIN_SAMPLES = 50


# ---------------------------------------------------------------- temperature
#: Groups whose sums a task keeps before it hands them on.
GROUPS_AT_ONCE = 4096


@dataclass(frozen=True)
class Loss:
    """A row's loss at a temperature: the numbers it needs, made by Spark, and what is made of them in tasks.

    ``cells`` are the row's columns ``_x`` and ``_y``; a row with a NULL among them has no loss.
    ``at`` gives a function from temperatures (one a row) to losses for the values of a batch.
    """

    cells: tuple[Column, Column]
    at: Callable[[pa.Array, pa.Array], Callable[[np.ndarray], np.ndarray]]


def _option_losses(gaps: pa.Array, mark: pa.Array) -> Callable[[np.ndarray], np.ndarray]:
    x, own, first = gaps.flatten().to_numpy(), mark.to_numpy(), gaps.offsets.to_numpy()
    first, size = first[:-1] - first[0], np.diff(first)
    return lambda t: np.log(np.add.reduceat(np.exp(x / np.repeat(t, size)), first)) - own / t


def _binary_losses(logit: pa.Array, y: pa.Array) -> Callable[[np.ndarray], np.ndarray]:
    z, wanted = logit.to_numpy(), y.to_numpy()

    def at(t: np.ndarray) -> np.ndarray:
        v = z / t
        return np.maximum(v, 0.0) + np.log1p(np.exp(-np.abs(v))) - wanted * z / t

    return at


def option_loss(logits: str = "logits", label: str = "label") -> Loss:
    """Negative log-likelihood of the labelled option; logits go to tasks less the row's largest."""
    whole = F.forall(logits, lambda x: x.isNotNull())  # of no options none can be labelled
    gaps = ex.bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: x - top))
    return Loss((F.when(whole, gaps), F.get(logits, F.col(label)) - F.array_max(logits)), _option_losses)


def binary_loss(p: str = "prob", y: str = "relevant") -> Loss:
    return Loss((logit_of(p), F.col(y).cast("double")), _binary_losses)


def bucketed(records: DataFrame) -> DataFrame:
    """Labelled records under their type and size bucket."""
    return records.filter(F.col("label").isNotNull()).select(ex.size_bucket("qtype", F.size("logits")).alias("bucket"), "logits", "label")


def _numbers(rows: DataFrame, by: list[str], loss: Loss) -> DataFrame:
    return rows.select(*by, loss.cells[0].alias("_x"), loss.cells[1].alias("_y"))


def _loss_sums(rows: DataFrame, by: list[str], loss: Loss, grid: Callable[..., np.ndarray], bounds: list[str], total: tuple | None = None) -> DataFrame:
    """(by.., i, s, n): the summed loss of every candidate of a group's grid.

    ``rows`` are those of :func:`_numbers`; ``grid`` makes a group's candidates of its row's
    ``bounds``. ``total`` (name, bounds..) is a further group that holds all rows. A task adds up
    the rows of a batch as vectors and hands on one row per group, so only these are shuffled.
    """
    keys = [rows.schema[c] for c in by]
    schema = StructType([*keys, StructField("s", ArrayType(DoubleType())), StructField("m", LongType()), StructField("n", LongType())])
    arrow, losses_of = to_arrow_schema(schema), loss.at  # the columns of a loss can't be sent to tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            if held:
                cells = [*zip(*held), *zip(*held.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, arrow.types)], names=arrow.names)
                held.clear()

        def add(group: tuple, *more) -> None:
            held[group] = [a + b for a, b in zip(held[group], more)] if group in held else list(more)

        for batch in batches:
            if not batch.num_rows:
                continue
            code: dict[tuple, int] = {}
            names = zip(*(batch[c].to_pylist() for c in by)) if by else [()] * batch.num_rows
            of = np.array([code.setdefault(x, len(code)) for x in names])
            first = np.unique(of, return_index=True)[1]
            grids = np.array([grid(*(batch[c][int(k)].as_py() for c in bounds)) for k in first])
            there = pc.and_(batch["_x"].is_valid(), batch["_y"].is_valid())
            mine, has = of[there.to_numpy(zero_copy_only=False)], batch.filter(there)
            sums, whole = np.zeros(grids.shape), np.zeros(grids.shape[1])
            if len(mine):
                at = losses_of(has["_x"], has["_y"])
                for i in range(grids.shape[1]):
                    sums[:, i] = np.bincount(mine, at(grids[mine, i]), len(code))
                whole = np.array([at(np.full(len(mine), t)).sum() for t in grid(*total[1:])]) if total else whole
            counts, losses = np.bincount(of, minlength=len(code)), np.bincount(mine, minlength=len(code))
            for group, g in code.items():
                add(group, sums[g], int(losses[g]), int(counts[g]))
            if total:
                add((total[0],), whole, len(mine), len(of))
            if len(held) > GROUPS_AT_ONCE:
                yield from handed_on()
        yield from handed_on()

    made = rows.mapInArrow(run, schema)
    some = F.when(F.sum("m") > 0, F.sum("_s"))
    return made.select(*by, "m", "n", F.posexplode("s").alias("i", "_s")).groupBy(*by, "i").agg(some.alias("s"), F.sum("n").alias("n"))


def _best(sums: DataFrame, by: list[str], t: Column) -> DataFrame:
    """The candidate with the lowest mean loss (to twelve digits, then the lowest ``t``) per group."""
    rows = sums.withColumns({"_t": t, "_m": F.col("s") / F.col("n")})
    best = F.min_by(F.struct("_t", "_m"), F.struct(F.round("_m", 12), F.col("_t")))
    return rows.groupBy(*by).agg(best.alias("_b"), F.max("n").alias("n")).select(*by, F.col("_b._t").alias("t"), F.col("_b._m").alias("nll"), "n")


def temperature_grid(rows: DataFrame, grid: list[float], by: list[str], loss: Loss | None = None, total: str | None = None) -> DataFrame:
    """Single pass: the grid temperature with the lowest mean loss per group.

    ``total`` names a further group that holds all rows (then ``by`` is one column).
    """
    ts = np.array(grid, float)
    sums = _loss_sums(_numbers(rows, by, loss or option_loss()), by, loss or option_loss(), lambda: ts, [])
    if total is not None:
        sums = cut_lineage(sums)  # a row per group and candidate, read twice
        whole = sums.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        sums = sums.unionByName(whole.withColumn(by[0], F.lit(total)))
    return _best(sums, by, F.get(F.array(*[F.lit(float(g)) for g in grid]), F.col("i")))


def fit_temperature(
    rows: DataFrame, by: list[str], lo: float = 0.02, hi: float = 10.0, points: int = 24, passes: int = 6, loss: Loss | None = None, total: str | None = None
) -> DataFrame:
    """Temperature minimising the mean loss per group, by a narrowing grid.

    The loss has one minimum in t, so the neighbours of the best of ``points`` geometric
    candidates bracket it; every pass cuts the bracket (in log t) to 2/(points-1). All
    groups, and everything together under the name ``total``, are searched in the same pass,
    one aggregate each. The numbers that losses need are read ``passes`` times and kept for that
    long; they are not shuffled, as the brackets of few groups are sent to them.
    """
    loss = loss or option_loss()
    rows = _numbers(rows, by, loss).persist()
    brackets = rows.select(*by).distinct()
    if total is not None:
        brackets = brackets.union(rows.sparkSession.createDataFrame([(total,)], brackets.schema))
    brackets = brackets.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    parts = np.arange(points) / (points - 1)
    for _ in range(passes):
        brackets = cut_lineage(brackets)  # one row per group
        known, whole = few(brackets.select(*by, "_lo", "_hi")), None
        if total is not None:
            whole = (total, *brackets.filter(F.col(by[0]) == total).select("_lo", "_hi").first())
        sums = _loss_sums(rows.join(known, by), by, loss, lambda a, b: a * (b / a) ** parts, ["_lo", "_hi"], whole)
        step = F.pow(F.col("_hi") / F.col("_lo"), F.lit(1.0 / (points - 1)))
        best = _best(sums.join(known, by), [*by, "_lo", "_hi"], F.col("_lo") * F.pow(step, F.col("i")))
        brackets = best.select(*by, F.greatest(F.col("t") / step, F.col("_lo")).alias("_lo"), F.least(F.col("t") * step, F.col("_hi")).alias("_hi"), "nll", "n")
    found = cut_lineage(brackets.select(*by, "n", F.sqrt(F.col("_lo") * F.col("_hi")).alias("t"), "nll"))
    rows.unpersist()
    return found


def fit_temperature_map(records: DataFrame, min_samples: int = MIN_SAMPLES, grid: list[float] | None = None) -> DataFrame:
    """(bucket, n, t, source): thin buckets take the global temperature and say so."""
    rows = bucketed(records)
    fits = temperature_grid(rows, grid, ["bucket"], total=GLOBAL) if grid else fit_temperature(rows, ["bucket"], total=GLOBAL)
    return with_fallback(fits, min_samples)


def with_fallback(fits: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    fits = cut_lineage(fits)  # one row per bucket
    t_all = fits.filter(F.col("bucket") == GLOBAL).agg(F.max("t")).scalar()
    fitted = (F.col("n") >= min_samples) | (F.col("bucket") == GLOBAL)
    return fits.select(
        "bucket",
        "n",
        F.when(fitted, F.col("t")).otherwise(t_all).alias("t"),
        F.when(fitted, "fitted").otherwise("global").alias("source"),
    )


def apply_temperature(records: DataFrame, temperatures: DataFrame, out: str = "probs") -> DataFrame:
    """Softmax at the bucket's temperature, or the global one for an unseen bucket."""
    t_all = temperatures.filter(F.col("bucket") == GLOBAL).agg(F.max("t")).scalar()
    tagged = records.withColumn("bucket", ex.size_bucket("qtype", F.size("logits")))
    joined = tagged.join(temperatures.select("bucket", "t"), "bucket", "left").withColumn(
        "t", F.coalesce("t", t_all, F.lit(1.0))
    )
    return joined.withColumn(out, ex.softmax("logits", F.col("t")))


def logit_of(p: Column | str, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(ex.col(p), F.lit(clip)), F.lit(1.0 - clip))
    return F.ln(q / (1.0 - q))


def fit_binary_temperature(rows: DataFrame, by: list[str], p: str = "prob", y: str = "relevant", grid: list[float] | None = None) -> DataFrame:
    """Temperature on logit(p) in [0.05, 20]."""
    loss = binary_loss(p, y)
    if grid:
        return temperature_grid(rows, grid, by, loss)
    return fit_temperature(rows, by, 0.05, 20.0, loss=loss)


def apply_binary_temperature(p: Column | str, t: Column | str) -> Column:
    return ex.sigmoid(logit_of(p) / ex.col(t))


def ece_by_bucket(pred: DataFrame, probs: str = "probs") -> DataFrame:
    """ECE per bucket and over everything, the worst bucket and how much the total hides.

    One aggregate with grouping sets serves buckets and total.
    """
    p = F.col(probs)
    rows = pred.select(
        ex.size_bucket("qtype", F.size(p)).alias("bucket"),
        F.array_max(p).alias("conf"),
        (ex.argmax0(p) == F.col("label")).cast("int").alias("correct"),
    )
    bins = cut_lineage(binned(rows, ["bucket"], "conf", "correct"))  # one row per bucket and bin
    sets = bins.rollup("bin", "bucket").agg(
        F.sum("n").alias("n"), F.sum("sum_p").alias("sum_p"), F.sum("sum_y").alias("sum_y"), F.grouping_id().alias("g")
    )
    per = sets.filter(F.col("g") <= 1).withColumn("bucket", F.when(F.col("g") == 1, ALL).otherwise(F.col("bucket")))
    out = (
        ece_from_bins(per, ["bucket"])
        .join(per.groupBy("bucket").agg((F.sum("sum_y") / F.sum("n")).alias("accuracy"), (F.sum("sum_p") / F.sum("n")).alias("mean_conf")), "bucket")
        .select("bucket", "n", *[F.round(c, 4).alias(c) for c in ("ece", "accuracy", "mean_conf")])
    )
    worst = out.filter(F.col("bucket") != ALL).agg(F.max("ece")).scalar()
    is_all = F.col("bucket") == ALL
    return out.withColumn("worst_bucket_ece", F.when(is_all, worst)).withColumn(
        "hiding_ratio", F.when(is_all, F.round(worst / F.greatest(F.col("ece"), F.lit(1e-9)), 2))
    )


# ------------------------------------------------------------------ conformal
def miss_score(u_true: str = "u_true", u_hat: str = "u_hat", sigma: str = "sigma") -> Column:
    return F.abs(F.col(u_true) - F.col(u_hat)) / F.greatest(F.col(sigma), F.lit(1e-6))


def conformal_fit(rows: DataFrame, alpha: float = 0.1, key: str = "id") -> DataFrame:
    """One row (alpha, n, level, q): the finite-sample corrected quantile of the miss scores.

    Fewer than 20 rows is an error. The quantile is picked by rank from range partitions.
    """
    n = F.col("n")
    level = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * (1 - alpha), 9)) / n)
    checked = F.when(n >= 20, level).otherwise(
        F.raise_error(F.lit("too few calibration rows for this interval")).cast("double")
    )
    fit = exact_quantile(rows.select(miss_score().alias("s")), [], "s", F.array(checked))
    return fit.select(F.lit(alpha).alias("alpha"), "n", "level", "q")


def z_two_sided(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def with_intervals(rows: DataFrame, fit: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Interval, hit flag and the sigma rescaled to mean what a Gaussian says it does."""
    q = fit.select("q").scalar()
    half = q * F.col("sigma")
    return (
        rows.withColumn("lo", F.col("u_hat") - half)
        .withColumn("hi", F.col("u_hat") + half)
        .withColumn("covered", (F.col("u_true") >= F.col("lo")) & (F.col("u_true") <= F.col("hi")))
        .withColumn("sigma_calibrated", F.col("sigma") * q / F.lit(z_two_sided(1 - alpha)))
    )


def coverage_by_group(hits: DataFrame, alpha: float = 0.1, group: str = "grp") -> DataFrame:
    """Realised coverage per group and overall, with the worst group."""
    counted = hits.rollup(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(ex.share(F.col("covered")), 4).alias("coverage"),
        F.grouping(group).alias("_all"),
    )
    r = cut_lineage(counted)  # one row per group
    worst = r.filter(F.col("_all") == 0).agg(F.min("coverage")).scalar()
    total = F.col("_all") == 1
    return r.select(
        F.when(total, "__overall__").otherwise(F.col(group).cast("string")).alias("grp"),
        "n",
        "coverage",
        F.when(total, F.lit(round(1 - alpha, 4))).alias("target"),
        F.when(total, worst).alias("worst_group_coverage"),
    )


def rolling_coverage(
    hits: DataFrame, order: list[str], group: str = "grp", window: int = 2000, target: float = 0.9, tolerance: float = 0.05
) -> DataFrame:
    """Coverage over the last ``window`` rows of the group at every row, and the drift flag.

    Running hit counts come from range partitions and the count ``window`` rows earlier by
    an equi-join on (group, rank), so a group may hold any share of the stream.
    """
    rows = hits.select(group, *order, F.col("covered").cast("bigint").alias("_hit"))
    run = running(rows, [group], [F.col(c) for c in order], sums={"_hits": "_hit"}, rank="seen")
    back = run.select(group, (F.col("seen") + window).alias("seen"), F.col("_hits").alias("_old"))
    cov = (F.col("_hits") - F.coalesce("_old", F.lit(0))) / F.least("seen", F.lit(window))
    return (
        run.join(back, [group, "seen"], "left")
        .withColumn("coverage", cov.cast("double"))
        .withColumn("drifted", F.col("coverage") < target - tolerance)
        .select(group, *order, "seen", "coverage", "drifted")
    )


# ------------------------------------------------------------- level read-outs
def level_probs(cumulative: Column | str, floor: float = 1e-6) -> Column:
    """Cumulative logits P(y > k) -> one probability per level, floored, not renormalised."""
    s = F.transform(ex.col(cumulative), ex.sigmoid)
    upper = F.concat(F.array(F.lit(1.0)), s)
    lower = F.concat(s, F.array(F.lit(0.0)))
    return F.zip_with(upper, lower, lambda a, b: F.greatest(a - b, F.lit(floor)))


def tail_mass(probs: Column | str, threshold: int) -> Column:
    """P(level >= threshold)."""
    p = ex.col(probs)
    return ex.arr_sum(F.slice(p, F.lit(threshold + 1), F.greatest(F.size(p) - threshold, F.lit(0))))


def decision_features(probs: Column | str) -> Column:
    """Struct of top probability, margin to the second, normalised entropy, k / 255."""
    p = ex.col(probs)
    k = F.size(p)
    best = F.sort_array(p, asc=False)
    return F.struct(
        best[0].alias("top1"),
        F.when(k >= 2, best[0] - F.get(best, F.lit(1))).otherwise(best[0]).alias("margin"),
        (ex.entropy(p, 1e-9) / F.ln(F.greatest(k, F.lit(2)).cast("double"))).alias("entropy"),
        (k / F.lit(255.0)).alias("size"),
    )
