"""Run ledgers: directories of manifest and metric files turned into tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "name string, status string, wall_seconds double, config map<string,string>, metrics string"
)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """``root/<run>/manifest.json`` joined with ``root/<run>/metrics.json`` (if any)."""
    def load(file: str, out: str) -> DataFrame:
        raw = spark.read.text(f"{root}/*/{file}", wholetext=True)
        run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
        return raw.select(run.alias("run"), F.col("value").alias(out))

    rows = load("manifest.json", "manifest")
    try:
        rows = rows.join(load("metrics.json", "metrics"), "run", "left")
    except Exception as err:  # no run has written metrics yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
        rows = rows.withColumn("metrics", F.lit(None).cast("string"))
    return parse_runs(rows)


def parse_runs(df: DataFrame) -> DataFrame:
    """(run, manifest JSON, metrics JSON) -> typed columns and a flat metric map."""
    m = F.from_json("manifest", MANIFEST_SCHEMA)
    return df.withColumn("_m", m).select(
        "run",
        F.coalesce("_m.status", F.lit("unknown")).alias("status"),
        F.col("_m.wall_seconds").alias("wall_seconds"),
        F.col("_m.config").alias("config"),
        F.coalesce("metrics", "_m.metrics").alias("metrics"),
    )


def _numbers(path: str, value) -> list[tuple[str, float]]:
    """Numbers below a JSON value, by dotted path; list items go by position."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [(path, float(value))]
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for key, v in inner for x in _numbers(f"{path}.{key}" if path else str(key), v)]


def run_metrics(runs: DataFrame) -> DataFrame:
    """Long form (run, metric path, value) of every number, however deep; broken JSON has none."""

    @F.pandas_udf("array<struct<path:string,value:double>>")
    def flat(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append([{"path": p, "value": v} for p, v in _numbers("", json.loads(text or "{}"))])
            except ValueError:
                out.append([])
        return pd.Series(out)

    return runs.select("run", F.inline(flat("metrics")))


def stage_deltas(history: DataFrame, run: str = "run", step: str = "step", value: str = "value") -> DataFrame:
    """Change of a metric from one recorded stage to the next, and from the first.

    The window holds the stages of one run and metric, a handful of rows.
    """
    w = Window.partitionBy(run, "metric").orderBy(step)
    return history.select(
        run,
        "metric",
        step,
        value,
        (F.col(value) - F.lag(value).over(w)).alias("change"),
        (F.col(value) - F.first(value).over(w)).alias("since_start"),
    )
