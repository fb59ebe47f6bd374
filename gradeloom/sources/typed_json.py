"""Typed decision examples from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import col, settle


def read_typed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_typed_lines(spark.read.text(path).withColumnRenamed("value", "line"), "line")


SCHEMA = (
    "state string, type string, instructions string, criteria string, label variant, "
    "soft_label array<double>, weight double, meta map<string,string>, _corrupt_record string"
)


def parse_typed_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """One row per non-blank line; the polymorphic fields are kept as text plus a kind.

    The file's key order decides what a label given by name means, so ``criteria`` stays raw
    JSON and its keys are read in order (a VARIANT would sort them). A state that is not a
    string becomes compact JSON. A line that is no JSON object, or has a field of a wrong
    type, gives ``is_json = false``, to be sorted out by ``check_examples``.
    """
    rows = df.filter(F.length(F.trim(line)) > 0)
    parsed = F.from_json(line, SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    raw = rows.select(*[c for c in df.columns if c != line], F.inline(F.array(parsed)))
    criteria, kind = F.col("criteria"), F.col("criteria_kind")
    raw = raw.withColumn(
        "criteria_kind",
        F.when(F.startswith(criteria, F.lit("{")), "object").when(F.startswith(criteria, F.lit("[")), "list"),
    )
    keys = (
        F.when(kind == "object", F.json_object_keys("criteria"))
        .when(kind == "list", F.from_json("criteria", "array<string>"))
        .when(F.col("qtype") == "noul", F.array(F.lit("false"), F.lit("true")))
    )
    return settle(
        raw.withColumnRenamed("type", "qtype"),
        {
            "is_json": F.col("_corrupt_record").isNull(),
            "option_keys": keys,
            "option_notes": F.when(kind == "object", F.from_json("criteria", "map<string,string>")),
            "label_text": F.col("label").cast("string"),
            "label_kind": label_kind("label"),
            "weight": F.coalesce("weight", F.lit(1.0)),
            "meta": F.coalesce("meta", F.create_map().cast("map<string,string>")),
        },
    ).drop("label", "_corrupt_record")


def label_kind(v: Column | str) -> Column:
    """'name', 'index', 'flag' or NULL, from how the label was written."""
    s = F.schema_of_variant(col(v))
    return (
        F.when(s == "STRING", F.lit("name"))
        .when(s == "BOOLEAN", F.lit("flag"))
        .when(s.rlike("^(BIGINT|DECIMAL|INT|DOUBLE)"), F.lit("index"))
    )
