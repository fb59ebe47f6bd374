"""Reading column files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is stored.

    In a local session, whose test files hold one row group each, the rows are spread over the
    cores; on a cluster a table is never moved before it is used.
    """
    df = spark.read.parquet(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.sparkContext.master.startswith("local[") else df
