"""Row numbers and running sums for groups of any size.

``row_number() over (partition by key ...)`` puts a whole key into one task. When a key may
hold a large share of all rows (a slice of an evaluation, a monitored stream, no key at
all), use :func:`running` instead: rows are range-partitioned by (key, order), every
partition numbers its own stretch, and the stretches of a key that crosses partitions are
shifted by the totals of the stretches before. At most one key crosses each partition
border, so the table of shifts has at most two rows per partition and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import few
from .lineage import cut_lineage


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, str] | None = None,
    max_before: dict[str, str] | None = None,
    rank: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based ``rank`` inside ``keys`` by ``order`` and inclusive running sums.

    ``order`` must make the order total (end it with an id). ``sums`` maps an output column
    to the column that is summed up to and including the row; ``max_before`` maps one to the
    column whose maximum over the earlier rows is wanted (NULL on a key's first row).
    """
    sums, max_before = sums or {}, max_before or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the piece number has to survive a recomputation, hence the reliable copy
    pieces = cut_lineage(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    totals = pieces.groupBy(*keys, "_piece").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_t_{o}") for o, c in max_before.items()],
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        totals.withColumn("_shift", F.sum("_n").over(before))
        .withColumns({f"_s_{o}": F.sum(f"_t_{o}").over(before) for o in sums})
        .withColumns({f"_s_{o}": F.max(f"_t_{o}").over(before) for o in max_before})
        .filter(F.col("_shift").isNotNull())
        .select(*keys, "_piece", "_shift", *[f"_s_{o}" for o in [*sums, *max_before]])
    )
    local = Window.partitionBy("_piece", *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        pieces.withColumn(rank, F.row_number().over(local).cast("bigint"))
        .withColumns({o: F.sum(c).over(upto) for o, c in sums.items()})
        .withColumns({o: F.max(c).over(earlier) for o, c in max_before.items()})
    )
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [
        F.col("a._piece") == F.col("b._piece")
    ]
    joined = numbered.alias("a").join(F.broadcast(shifts).alias("b"), on, "left")
    cols = [F.col(f"a.{c}") for c in df.columns if c not in (rank, *sums, *max_before)]
    return joined.select(
        *cols,
        (F.col(f"a.{rank}") + F.coalesce(F.col("b._shift"), F.lit(0))).alias(rank),
        *[(F.col(f"a.{o}") + F.coalesce(F.col(f"b._s_{o}"), F.lit(0))).alias(o) for o in sums],
        *[F.greatest(F.col(f"a.{o}"), F.col(f"b._s_{o}")).alias(o) for o in max_before],
    )


#: Stretches that a counting pass divides a range of values into.
BINS = 4096


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Where v lies between lo and hi, from 0 to 1: evenly if they are of one size, else by powers of two."""
    def power(x: Column) -> Column:  # the least double has the power -1074
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100.0))

    even = (F.signum(lo) == F.signum(hi)) & (F.greatest(F.abs(lo), F.abs(hi)) <= 4 * F.least(F.abs(lo), F.abs(hi)))
    return F.when(even, (v - lo) / (hi - lo)).otherwise((power(v) - power(lo)) / (power(hi) - power(lo)))


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, levels: Column, out: str = "q"
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one row per (key, level).

    ``levels`` is an array column computed from ``n`` (the group's row count); NULL and NaN values
    take no part. Each quantile needs the values at one or two ranks. A pass counts the rows of
    ``BINS`` even stretches of the range that a rank is known to lie in, and the stretch that holds
    it, from its least to its greatest value, is the next range, until that is one value. Two or
    three passes do for most data; each shuffles counts only, and no copy of ``df`` is written,
    sorted or gathered, whatever the size of a group. ``df`` is read once a pass.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    given = keys
    if not keys:  # one group, whose ranges are met by a constant
        keys, rows, ends = ["_all"], rows.withColumn("_all", F.lit(0)), ends.withColumn("_all", F.lit(0))
    picks = cut_lineage(
        ends.withColumn("level", F.explode(levels))
        .withColumn("_pos", F.col("level") * (F.col("n") - 1))
        .withColumn("_first", F.floor("_pos").cast("bigint"))
        .withColumn("_last", F.ceil("_pos").cast("bigint"))
    )
    wanted = picks.select(*keys, F.explode(F.array("_first", "_last")).alias("_at"), "_lo", "_hi").distinct()
    wanted = wanted.withColumn("_below", F.lit(0).cast("bigint"))
    found = None
    while True:
        wanted = cut_lineage(wanted)
        done = wanted.filter("_lo = _hi").select(*keys, "_at", F.col("_lo").alias("_x"))
        found = done if found is None else found.unionByName(done)
        wanted = wanted.filter("_lo < _hi")
        if wanted.isEmpty():
            break
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
        inside = (F.col("r._v") >= F.col("w._lo")) & (F.col("r._v") <= F.col("w._hi"))
        place = F.floor(F.least(F.greatest(_share(F.col("r._v"), F.col("w._lo"), F.col("w._hi")), F.lit(0.0)), F.lit(1.0)) * BINS)
        ranges = wanted.select(*keys, "_lo", "_hi", "_below").distinct()  # ranks that lie close share one
        counted = (
            rows.alias("r").join(few(ranges).alias("w"), [*same, inside])
            .select(*[F.col(f"r.{k}") for k in keys], "w._lo", "w._hi", "w._below", "r._v", place.alias("_bin"))
            .groupBy(*keys, "_lo", "_hi", "_below", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        )
        upto = Window.partitionBy(*keys, "_lo", "_hi", "_below").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        on = [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col(f"w.{x}") == F.col(f"c.{x}") for x in ("_lo", "_hi", "_below")]
        held = (F.col("w._at") >= F.col("c._from")) & (F.col("w._at") < F.col("c._from") + F.col("c._c"))
        wanted = wanted.alias("w").join(counted.alias("c"), [*on, held]).select(
            *[F.col(f"w.{k}") for k in keys], "w._at", F.col("c._min").alias("_lo"), F.col("c._max").alias("_hi"), F.col("c._from").alias("_below"))

    def at(rank: str, name: str, left: DataFrame) -> DataFrame:
        on = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] + [F.col(f"p.{rank}") == F.col("f._at")]
        return left.alias("p").join(found.alias("f"), on).select("p.*", F.col("f._x").alias(name))

    both = at("_last", "_b", at("_first", "_a", picks))
    weight = F.col("_pos") - F.col("_first")
    return both.select(*given, "level", "n", F.when(F.col("_first") == F.col("_last"), F.col("_a")).otherwise(F.col("_a") * (1 - weight) + F.col("_b") * weight).alias(out))
