"""Vectors over whole groups: rows are dealt by a key once and handed on in batches that split no group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lineage import cut_lineage

#: Rows of a group that are worked on in one place; larger groups go by windows over their rows.
LOCAL = 1 << 14


def split_wide(df: DataFrame, by: str, local: int = LOCAL, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most ``local`` rows, and the others, if any.

    Groups are counted first, unless the caller knows that none has above ``most`` rows and these are few.
    """
    if most is not None and most <= local:
        return df, None
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > local).select(by)
    if wide.isEmpty():
        return df, None
    wide = cut_lineage(wide)
    return df.join(wide, by, "left_anti"), df.join(wide, by, "left_semi")


def starts_of(values: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal values begin (NULLs are equal)."""
    if not len(values):
        return np.zeros(0, np.int64)
    codes = values.combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt by a key over the session's number of pieces, which is not lowered to what their bytes need:
    what follows makes much of few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def over_groups(
    df: DataFrame, by: str, order: list[Column | str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: StructType
) -> DataFrame:
    """``fn`` (rows of whole groups sorted by ``order``, where each group starts) over all groups.

    A task holds an Arrow batch and one group.
    """
    ordered = dealt(df, by).sortWithinPartitions(by, *order)

    def whole(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        return fn(rows, starts_of(rows[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            cut = int(starts_of(pa.Table.from_batches([*last, batch])[by])[-1]) - len(last)
            if cut < 0 or (not held and cut == 0):  # one group so far
                held.append(batch)
                continue
            yield from whole([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield from whole(held)

    return ordered.mapInArrow(run, schema)
