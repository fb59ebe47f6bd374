"""Quality rules: counts per text, and robust multivariate outliers per language and source.

Only DataFrame functions are used. All counts of a text are made inside its row (higher-order
functions over its words), so no text and no word is shuffled. The statistics of a document are
turned into a vector (:data:`STATISTICS`); for every (lang, source) a minimum-covariance-
determinant estimate of centre and scatter is found by concentration steps: half-way distances
decide the ``SUPPORT`` share of rows with the smallest Mahalanobis distance, whose mean and
covariance are the next estimate. A document is an outlier if its squared distance from the final
estimate is above ``CUTOFF``.

Group sums are combined before the shuffle, and quantiles are exact over values on a fixed grid,
so a group of any size takes bounded state and no group meets in one task. Vector components are
multiples of 2^-12, so that sums of squares are exact and do not hang on their order.

Defined cases: a NULL text has no words and fails the base rules; NULL lang or source are values
of their own; groups below ``MIN_GROUP`` documents that pass the base rules reject nothing;
repeated rows count each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of a group's rows that an estimate rests on.
SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 40
#: 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.51
#: Variance of a normal over that of its central 75 percent ellipsoid, in four dimensions.
CONSISTENCY = 1.485
#: Name -> (transformed statistic, standard deviation that an estimate has at least). A few
#: neutral words or characters are added to each ratio, so that short texts do not scatter.
STATISTICS: dict[str, tuple[str, float]] = {
    "word_length": ("ln((word_chars + 250) / (n_words + 50))", 0.05),
    "symbols": ("sqrt(n_symbols / (word_chars + 100))", 0.05),
    "dup_lines": ("sqrt(n_dup_lines / (n_lines + 3))", 0.15),
    "repeats": ("sqrt(n_repeat_words / (n_words + 20))", 0.15),
}
NAMES = list(STATISTICS)
#: Rows meet their group's estimate in this many pieces, so that no group is one task.
SALTS = 32
GRID = 4096


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, lang, source, text) with the base counts in place of the text."""
    at = F.expr
    words = docs.select(
        "doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_text"),
    ).withColumn("_words", F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    counted = words.select(
        "doc_id", "lang", "source", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("_lines"),
        F.when(F.size("_words") >= WINDOW_WORDS, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW_WORDS - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, WINDOW_WORDS)))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # windows side by side after sorting: only texts that repeat one at all are sorted
    ordered = counted.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.filter(F.arrays_zip(F.col("_sorted").alias("a"), F.slice("_sorted", 2, F.greatest(F.size("_sorted") - 1, F.lit(0))).alias("b")),
                     lambda p: p["a"]["h"] == p["b"]["h"])
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(twins, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW_WORDS))).alias("n")),
        lambda acc: acc["n"])
    return ordered.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_sorted").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    ).withColumn("base_failed", at(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def _factor(estimate: DataFrame, mean: dict[str, Column], cov) -> DataFrame:
    """Cholesky factor of the covariances, one row per group, as columns ``l_i_j`` beside ``m_i``."""
    out = estimate.select("group", "size", *[mean[n].alias(f"m_{n}") for n in NAMES],
                          *[cov(i, j).alias(f"c_{i}_{j}") for i in range(len(NAMES)) for j in range(i + 1)])
    for j in range(len(NAMES)):
        rest = F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest, F.lit(STATISTICS[NAMES[j]][1] ** 2))))
        for i in range(j + 1, len(NAMES)):
            dot = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l_{i}_{j}", dot / F.col(f"l_{j}_{j}"))
    return out.select("group", "size", *[f"m_{n}" for n in NAMES], *[f"l_{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)])


def _spread(small: DataFrame) -> DataFrame:
    """A table of one row per group, once for every piece."""
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distances(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of every row from its group's estimate, by forward substitution."""
    out = vectors.join(_spread(estimate), ["group", "_salt"], "left")
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m_{name}") - sum((F.col(f"l_{i}_{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"_z{i}", rest / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"_z{i}") ** 2 for i in range(len(NAMES))), F.lit(0.0))).select(*vectors.columns, "size", "d2")


def robust_estimates(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """MCD centre and Cholesky factor per ``group``, one row each."""
    by_group = vectors.groupBy("group")
    # the first estimate: medians and quartile distances, component by component
    quartiles = by_group.agg(F.count(F.lit(1)).alias("size"), *[F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n in NAMES])
    spread = lambda i: ((F.col(NAMES[i])[2] - F.col(NAMES[i])[0]) / 1.349) ** 2 + STATISTICS[NAMES[i]][1] ** 2
    estimate = cut_lineage(_factor(quartiles, {n: F.col(n)[1] for n in NAMES}, lambda i, j: spread(i) if i == j else F.lit(0.0)))
    for _ in range(steps):
        # distances on a grid: their exact quantile takes a bounded number of distinct values
        near = _distances(vectors, estimate).withColumn("_step", F.round(F.log1p("d2") * 256))
        edge = near.groupBy("group").agg(F.percentile("_step", F.lit(support)).alias("_edge"))
        inner = near.join(_spread(edge), ["group", "_salt"]).filter("_step <= _edge")
        sums = inner.groupBy("group").agg(
            F.first("size").alias("size"), F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(n).alias(f"s_{n}") for n in NAMES],
            *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i in range(len(NAMES)) for j in range(i + 1)])
        mean = {n: F.col(f"s_{n}") / F.col("n") for n in NAMES}

        def cov(i: int, j: int, mean=mean) -> Column:
            raw = (F.col(f"q_{i}_{j}") / F.col("n") - mean[NAMES[i]] * mean[NAMES[j]]) * CONSISTENCY
            return raw + STATISTICS[NAMES[i]][1] ** 2 if i == j else raw

        estimate = cut_lineage(_factor(sums, mean, cov))
    return estimate


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, the squared distance ``d2`` (NULL where none) and ``kept`` per row of ``docs``."""
    counts = text_counts(docs.select("doc_id", "lang", "source", "text"))
    grid = {n: F.round(F.expr(e) * GRID) / GRID for n, (e, _) in STATISTICS.items()}
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("_salt")
    counted = cut_lineage(counts.select("*", F.struct("lang", "source").alias("group"), salt, *[c.alias(n) for n, c in grid.items()]))
    passed = counted.filter(~F.col("base_failed"))
    judged = _distances(counted, robust_estimates(passed.select("group", "_salt", *NAMES)))
    outlier = F.coalesce((F.col("size") >= MIN_GROUP) & (F.col("d2") > CUTOFF), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~outlier)


def op5(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
