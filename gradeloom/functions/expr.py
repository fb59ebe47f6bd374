"""Column -> Column helpers. Everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting; adding 0.0 turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return col(c).cast("bigint")


def share(flag: Column) -> Column:
    """Mean of a boolean as a double (NULL flags are left out)."""
    return F.avg(flag.cast("double"))


# ---------------------------------------------------------------- random draws
def _digest(seed: int, keys: tuple[Column | str, ...]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def _unit(digest: Column, start: int) -> Column:
    word = F.conv(F.substring(digest, start, 8), 16, 10).cast("double")
    return (word + F.lit(0.5)) / F.lit(4294967296.0)


def uniform(seed: int, *keys: Column | str) -> Column:
    """Draw in (0, 1) that depends only on the seed and the row's own keys.

    A keyed draw gives the same value whatever the partitioning and however often a
    task is retried, which ``rand()`` does not.
    """
    return _unit(_digest(seed, keys), 1)


def normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal draw (Box-Muller on two words of one digest)."""
    d = _digest(seed, keys)
    return F.sqrt(F.lit(-2.0) * F.ln(_unit(d, 1))) * F.cos(F.lit(2.0 * math.pi) * _unit(d, 9))


# ---------------------------------------------------------------------- arrays
def bind(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once a row, also where ``fn`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def arr_sum(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x)


def normalise(a: Column | str) -> Column:
    """Divide by the total; NULL when there is no mass."""
    def scaled(v: Column) -> Column:
        return bind(F.nullif(arr_sum(v), F.lit(0.0)), lambda total: F.transform(v, lambda x: x / total))

    return bind(col(a), scaled)


def softmax(a: Column | str, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature

    def raised(v: Column) -> Column:
        return bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))

    return normalise(bind(col(a), raised))


def log_softmax(a: Column | str, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature

    def lowered(v: Column, top: Column) -> Column:
        lse = F.ln(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / t)))
        return bind(lse, lambda m: F.transform(v, lambda x: (x - top) / t - m))

    return bind(col(a), lambda v: bind(F.array_max(v), lambda top: lowered(v, top)))


def argmax0(a: Column | str) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def one_hot(label: Column | str, k: Column | str) -> Column:
    return F.transform(
        F.sequence(F.lit(0), col(k).cast("int") - 1),
        lambda i: F.when(i == col(label), F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def entropy(a: Column | str, floor: float = 1e-12) -> Column:
    return F.aggregate(
        col(a), F.lit(0.0), lambda acc, p: acc - p * F.ln(F.greatest(p, F.lit(floor)))
    )


def expected_index(a: Column | str) -> Column:
    """Sum of position times probability."""
    return arr_sum(F.transform(col(a), lambda x, i: x * i))


def cumulative_gap(p: Column | str, t: Column | str) -> Column:
    """Sum over positions of the squared difference of the two running sums."""
    d = F.arrays_zip(col(p).alias("p"), col(t).alias("t"))
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("tot"))
    return F.aggregate(
        F.transform(d, lambda x: x["p"] - x["t"]),
        zero,
        lambda acc, x: F.struct(
            (acc["run"] + x).alias("run"),
            (acc["tot"] + (acc["run"] + x) * (acc["run"] + x)).alias("tot"),
        ),
        lambda acc: acc["tot"],
    )


# ------------------------------------------------------------------- functions
def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def normal_cdf(x: Column) -> Column:
    """Gaussian CDF by the Abramowitz-Stegun 7.1.26 polynomial (error below 1.5e-7)."""
    a = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * a)
    poly = t * (
        F.lit(0.254829592)
        + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429))))
    )
    erf = F.lit(1.0) - poly * F.exp(-a * a)
    return F.when(x >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).otherwise(F.lit(0.5) * (F.lit(1.0) - erf))


def gain(grade: Column | str) -> Column:
    return F.pow(F.lit(2.0), col(grade).cast("double")) - F.lit(1.0)


def discount(rank: Column | str) -> Column:
    """Discount of a 1-based rank."""
    return F.lit(1.0) / F.log2(col(rank).cast("double") + F.lit(1.0))


def log_softmax_over(x: Column | str, w: WindowSpec) -> Column:
    top = F.max(col(x)).over(w)
    return col(x) - top - F.ln(F.sum(F.exp(col(x) - F.max(col(x)).over(w))).over(w))


def log_softmax_rows(df, x: str, by: list[str], out: str):
    """Log-softmax of one column inside each group of rows (two windows, one shuffle)."""
    w = Window.partitionBy(*by)
    return (
        df.withColumn("_top", F.max(x).over(w))
        .withColumn("_mass", F.sum(F.exp(F.col(x) - F.col("_top"))).over(w))
        .withColumn(out, F.col(x) - F.col("_top") - F.ln("_mass"))
        .drop("_top", "_mass")
    )


def safe_corr(a: Column | str, b: Column | str, tiny: float = 1e-12) -> Column:
    """Correlation aggregate; NULL when either side is flat."""
    sa, sb = F.stddev_pop(col(a)), F.stddev_pop(col(b))
    ok = (sa > F.lit(tiny)) & (sb > F.lit(tiny))
    return F.when(ok, F.covar_pop(col(a), col(b)) / F.nullif(sa * sb, F.lit(0.0)))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def size_bucket(qtype: Column | str, k: Column | str) -> Column:
    """``type:size`` bucket of a question with k options."""
    size = (
        F.when(col(k) <= 2, F.lit("2"))
        .when(col(k) <= 5, F.lit("3-5"))
        .when(col(k) <= 10, F.lit("6-10"))
        .otherwise(F.lit("11+"))
    )
    return F.concat(col(qtype), F.lit(":"), size)


def inline_rows(rows: list[dict], types: dict[str, str]) -> Column:
    """A short constant table as one array-of-structs column, to be exploded in place.

    Used for action lists, templates and grids: no join and no broadcast is needed, and
    the expansion factor is the literal's own length.
    """
    return F.array(
        *[F.struct(*[F.lit(r[n]).cast(t).alias(n) for n, t in types.items()]) for r in rows]
    )


def variants(names: tuple[str, ...], *rows: tuple) -> Column:
    """An array of structs with the same field names, to be inlined into rows."""
    cells = [[c if isinstance(c, Column) else F.lit(c) for c in r] for r in rows]
    return F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, r)]) for r in cells])


def settle(df, cols: dict[str, Column], keep: list[str] | None = None):
    """Add columns that later steps use many times.

    The optimiser copies a projected expression into every later filter that uses it, which
    grows without end when derived columns build on one another. A one-element ``inline``
    computes the values once per row and stops the copying.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    kept = [c for c in (keep or df.columns) if c not in cols]
    return df.select(*kept, F.inline(one))
