"""The escalation log: one training row per judged candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_rows(log: DataFrame, round_no: int) -> DataFrame:
    return log.withColumn("round", F.lit(round_no))


def append_log(log: DataFrame, path: str, round_no: int) -> None:
    """Write one round; running the round again replaces it instead of doubling it."""
    log_rows(log, round_no).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def stream_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Continuous variant: every micro-batch is a round; a replayed batch overwrites itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        append_log(batch, path, epoch)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
