"""How many tokens of each option, instruction and state a scorer can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, share

# fixed values of the sequence layout
MAX_LEN, HEAD_MAX, OPTION_CAP = 512, 192, 48
MIN_OPTION_BUDGET, MIN_PER_OPTION, MIN_HEAD = 16, 4, 8
LAYOUTS = ("options", "state")


def _shrunk(n: Column) -> Column:
    return F.greatest(F.lit(MIN_PER_OPTION), F.floor(F.lit(HEAD_MAX - MIN_OPTION_BUDGET) / n).cast("int"))


def option_tokens_available(n_options: Column | str, desired: Column | str | int = OPTION_CAP) -> Column:
    """Tokens of text every option keeps among ``n_options`` equally long ones."""
    n = col(n_options).cast("int")
    want = F.lit(desired) if isinstance(desired, int) else col(desired)
    per = F.lit(1) + F.least(want, F.lit(OPTION_CAP))
    fits = F.lit(HEAD_MAX) - n * per >= MIN_OPTION_BUDGET
    return F.when(fits, per - 1).otherwise(F.greatest(F.lit(0), F.least(_shrunk(n), per) - 1)).cast("int")


def slate_budget(
    n_options: Column | str, layout: Column | str, id_tokens: int = 3, instruction_tokens: int = 40
) -> Column:
    """Struct with what one scoring pass carries; ``layout`` is 'options' or 'state'."""
    n, lay = col(n_options).cast("int"), col(layout)
    want = F.when(lay == "options", F.lit(OPTION_CAP)).otherwise(F.lit(id_tokens))
    text = option_tokens_available(n, want)
    used = n * (text + 1)
    ins = F.greatest(F.lit(MIN_HEAD), F.least(F.lit(instruction_tokens), F.greatest(HEAD_MAX - used, F.lit(0))))
    state = F.greatest(F.lit(0), F.lit(MAX_LEN) - (ins + used + 3) - 1)
    share_ = F.floor(F.greatest(F.lit(0), state - 20) / F.greatest(F.lit(1), n)).cast("int")
    per = F.when(lay == "options", text).otherwise(share_)
    return F.struct(
        text.alias("option_tokens"),
        ins.cast("int").alias("instruction_tokens"),
        state.cast("int").alias("state_tokens"),
        per.cast("int").alias("tokens_per_candidate"),
        (text < want).alias("truncated"),
    )


def layout_report(slates: DataFrame, n_options: str = "n_options") -> DataFrame:
    """Per layout: how the slates of a table fit, and how often the layout carries more."""
    both = slates.select(
        n_options,
        slate_budget(n_options, F.lit("options")).alias("o"),
        slate_budget(n_options, F.lit("state")).alias("s"),
    ).withColumn(
        "winner",
        F.when(F.col("s.tokens_per_candidate") > F.col("o.tokens_per_candidate"), "state").otherwise("options"),
    )
    rows = both.select(
        "winner",
        F.inline(F.array(F.struct(F.lit("options").alias("layout"), F.col("o").alias("b")),
                         F.struct(F.lit("state").alias("layout"), F.col("s").alias("b")))),
    )
    return rows.groupBy("layout").agg(
        F.count(F.lit(1)).alias("slates"),
        F.avg("b.tokens_per_candidate").alias("tokens_per_candidate"),
        F.avg("b.state_tokens").alias("state_tokens"),
        share(F.col("b.truncated")).alias("truncated_share"),
        share(F.col("winner") == F.col("layout")).alias("carries_more_share"),
    )


def word_count(text: Column | str) -> Column:
    """Default token counter: runs of non-blank characters."""
    return F.size(F.regexp_extract_all(col(text), F.lit(r"\S+"), F.lit(0)))


def sequence_fit(
    df: DataFrame, option_tokens: str, instruction_tokens: str, state_tokens: str
) -> DataFrame:
    """Fit accounting per example from token counts (an array for the options).

    Order of cuts: every option to the cap, then all options alike when they overflow, the
    instruction to what is left of the head, the state to what is left of the sequence.
    """
    capped = F.transform(F.col(option_tokens), lambda t: F.least(t, F.lit(OPTION_CAP)) + 1)
    n = F.size(option_tokens)
    total = F.aggregate(capped, F.lit(0), lambda a, x: a + x)
    shrink = HEAD_MAX - total < MIN_OPTION_BUDGET
    per = _shrunk(F.greatest(n, F.lit(1)))
    kept = F.when(shrink, F.transform(capped, lambda t: F.least(t, per))).otherwise(capped)
    out = df.withColumn("shrink_fired", shrink).withColumn("_kept", kept)
    used = F.aggregate("_kept", F.lit(0), lambda a, x: a + x)
    head = F.least(F.col(instruction_tokens), F.greatest(F.lit(MIN_HEAD), HEAD_MAX - used))
    out = out.withColumn("_used", used).withColumn("head_tokens", head.cast("int"))
    ids = F.lit(1) + F.col("head_tokens") + 1 + F.col("_used") + 1
    room = F.greatest(F.lit(0), MAX_LEN - ids - 1)
    last = ids - 1 - F.element_at("_kept", -1)
    return (
        out.withColumn("option_tokens_kept", F.transform("_kept", lambda t: (t - 1).cast("int")))
        .withColumn("option_tokens_wanted", F.transform(capped, lambda t: (t - 1).cast("int")))
        .withColumn("state_kept", F.least(F.col(state_tokens), room).cast("int"))
        .withColumn("state_truncated", F.col(state_tokens) > F.col("state_kept"))
        .withColumn("total_tokens", F.least(F.lit(MAX_LEN), ids + F.col("state_kept") + 1).cast("int"))
        .withColumn("markers_fit", last < MAX_LEN)
        .drop("_kept", "_used")
    )


def budget_report(fit: DataFrame) -> DataFrame:
    """One row over all examples whose markers fit; option means are over options."""
    def total(c: str):
        return F.sum(F.aggregate(c, F.lit(0), lambda a, x: a + x))

    ok = fit.filter("markers_fit")
    options = F.sum(F.size("option_tokens_kept"))
    lost = F.sum(
        F.size(F.filter(F.arrays_zip("option_tokens_kept", "option_tokens_wanted"),
                        lambda x: x["option_tokens_kept"] < x["option_tokens_wanted"]))
    )
    return ok.agg(
        F.count(F.lit(1)).alias("examples"),
        F.round(F.try_divide(total("option_tokens_kept"), options), 1).alias("option_tokens_kept_mean"),
        F.round(F.try_divide(total("option_tokens_wanted"), options), 1).alias("option_tokens_wanted_mean"),
        F.round(F.try_divide(lost, options), 3).alias("option_text_lost_frac"),
        F.round(share(F.col("shrink_fired")), 3).alias("option_shrink_fired_frac"),
        F.round(F.avg("head_tokens"), 1).alias("instruction_tokens_mean"),
        F.round(F.avg("state_kept"), 1).alias("state_tokens_mean"),
        F.round(share(F.col("state_truncated")), 3).alias("state_truncated_frac"),
    )


def preflight(report: DataFrame, max_truncated: float = 0.25, max_lost: float = 0.5) -> DataFrame:
    """PASS / WARN / FAIL row: too many cut states fail, too much lost option text warns."""
    return report.withColumn(
        "status",
        F.when(F.col("state_truncated_frac") > max_truncated, "FAIL")
        .when(F.col("option_text_lost_frac") > max_lost, "WARN")
        .otherwise("PASS"),
    )
