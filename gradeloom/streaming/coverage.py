"""Coverage monitoring on a stream of checked intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expr import share
from ..functions.lineage import scratch_folder


def windowed_coverage(
    hits: DataFrame, length: str = "1 hour", slide: str | None = None, ts: str = "ts", group: str = "grp",
    target: float = 0.9, tolerance: float = 0.05, watermark: str | None = None,
) -> DataFrame:
    """Coverage per event-time window and group, for streams and tables alike.

    Partial sums are combined before the shuffle, so a busy group costs no more than
    another. With a watermark, rows later than it are dropped and finished windows leave
    the state.
    """
    rows = hits.withWatermark(ts, watermark) if watermark else hits
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = rows.groupBy(span.alias("window"), group).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("covered")).alias("coverage")
    )
    return out.withColumn("drifted", F.col("coverage") < target - tolerance)


_OUT = "grp string, seen bigint, coverage double, drifted boolean"
_STATE = "seen bigint, hits binary"


class LastRows:
    """The last ``window`` rows by (ts, key) of any number that are added, chunk by chunk."""

    def __init__(self, window: int):
        self.window, self.seen = window, 0
        self.kept: pd.DataFrame | None = None

    def add(self, rows: pd.DataFrame) -> None:
        """Rows in any order; at most ``window`` and a chunk are held."""
        self.seen += len(rows)
        both = rows if self.kept is None else pd.concat([self.kept, rows])
        self.kept = both.sort_values(list(both.columns[:2]), kind="stable").iloc[-self.window:]

    def hits(self) -> bytes:
        """One byte per row, oldest first."""
        return b"" if self.kept is None else self.kept["covered"].astype("uint8").to_numpy().tobytes()


def last_n_coverage(
    hits: DataFrame, window: int = 2000, target: float = 0.9, tolerance: float = 0.05, group: str = "grp",
    ts: str = "ts", key: str = "id",
) -> DataFrame:
    """Exact coverage over each group's last ``window`` rows, one output row per batch.

    Rows are taken in arrival order by batch and in (ts, key) order within it. The state is one
    byte per remembered hit. A group's share of a batch comes in chunks, of which only the
    last ``window`` rows so far are kept: a group of any size takes bounded memory.
    """

    def update(grp, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, b"")
        last = LastRows(window)
        for chunk in chunks:
            last.add(chunk[[ts, key, "covered"]])
        seen += last.seen
        kept = (bytes(kept) + last.hits())[-window:]
        state.update((seen, kept))
        cov = float(np.frombuffer(kept, np.uint8).mean())
        yield pd.DataFrame({"grp": [grp[0]], "seen": [seen], "coverage": [cov], "drifted": [cov < target - tolerance]})

    return (
        hits.select(F.col(group).alias("grp"), ts, key, "covered")
        .groupBy("grp")
        .applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    )


def drain(monitor: DataFrame) -> DataFrame:
    """Run a monitor over all that its source holds now; returns every row it put out, with its batch.

    Rows go to the shared folder batch by batch; a batch that is repeated after a failure replaces itself.
    """
    spark = monitor.sparkSession
    at = scratch_folder(spark, "monitor")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{at}/rows/run={batch}")

    query = (
        monitor.writeStream.outputMode("update").option("checkpointLocation", f"{at}/progress")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in monitor.schema.fields)
    return spark.read.schema(f"{schema}, batch bigint").option("recursiveFileLookup", "true").parquet(f"{at}/rows")
