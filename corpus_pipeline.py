"""The corpus pipeline: language, toxicity, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last give the columns of ``documents`` back. Stages learn from the documents they are given (and
the table of labels), keep every document that they don't reject, and change texts only where
personal data is replaced by its kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.functions.lineage import scratch_folder
from gradeloom.llm import copies, language, packing, pii, toxicity
from gradeloom.llm.common import table

#: Whole texts go to tasks in Arrow batches of at most this many rows; the workers of one stage serve the next.
BATCH_ROWS = 1000


def _settle(spark: SparkSession) -> None:
    """Settings of the pipeline's session: stages are run after their function has returned.

    A stage runs many jobs, each over what the ones before have written out. Shuffle files go with
    the job they serve; without that they lie on the executors' disks until the driver happens to
    collect its garbage, and grow with the number of jobs.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages that ``lang`` names, go."""
    _settle(spark)
    return language.accepted(docs, language.learn_profiles(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely toxic than not go."""
    _settle(spark)
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity 0.8 stays, the one with the smallest id.

    Links come from op2's index first, checked by the whole texts, then from exact candidates.
    """
    _settle(spark)
    return copies.keep_one(docs)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    _settle(spark)
    return pii.redact(docs, pii.learn(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into windows."""
    _settle(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near copies", near_copy_stage),
    ("private data", private_data_stage),
    ("packing", packing_stage),
]

#: Learned models and tokenizers have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back by the next.

    The folder goes when the driver ends, as the rows returned are read from it.
    """
    docs, at = table(spark, sf_dir, "documents"), scratch_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
