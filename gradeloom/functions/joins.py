"""Joins of a large table with one whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most this many short rows (some 50 MB) is sent to every task.
FEW = 500_000
SALTS = 16


def few(small: DataFrame, rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if it was counted (here or by the caller) as at most FEW rows."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= FEW else small


def lookup(rows: DataFrame, table: DataFrame, on: str, spread: str) -> DataFrame:
    """``rows`` with what ``table`` (one row per ``on``) says, however unevenly ``on`` is spread.

    A table of few rows is sent to the rows. A larger one meets them in SALTS pieces: a value that
    very many rows hold is dealt over that many tasks by the column ``spread``.
    """
    if table.count() <= FEW:
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"]).drop("_salt")
