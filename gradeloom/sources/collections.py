"""Document collections, queries and relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import uniform
from ..functions.ranks import running

CORPUS_SCHEMA = "_id string, title string, text string"
QUERY_SCHEMA = "_id string, text string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _tidy_corpus(spark.read.schema(CORPUS_SCHEMA).json(path))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(QUERY_SCHEMA).json(path)
    return raw.select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def parse_corpus_lines(df: DataFrame, line: str = "line") -> DataFrame:
    return _tidy_corpus(df.select(F.from_json(line, CORPUS_SCHEMA).alias("r")).select("r.*"))


def _tidy_corpus(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def full_text(title: str = "title", text: str = "text") -> Column:
    """Title, line break and text; just the text when there is no title."""
    t = F.coalesce(F.col(title), F.lit(""))
    return F.when(t == "", F.col(text)).otherwise(F.concat(t, F.lit("\n"), F.col(text)))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgement files; the order of lines decides between duplicates."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("at"),
        ).alias("seq"),
    )
    return parse_qrels_lines(lines)


def parse_qrels_lines(df: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """Split on white space, skip short lines and the header, last duplicate wins.

    ``clamped`` tells that the surviving grade was negative and has been set to 0.
    """
    parts = F.split(F.trim(F.col(line)), r"\s+")
    rows = (
        df.select(F.col(seq), parts.alias("p"))
        .filter((F.size("p") >= 3) & (F.col("p")[0] != "query-id"))
        .select(
            seq,
            F.col("p")[0].alias("qid"),
            F.col("p")[1].alias("doc_id"),
            F.try_to_number(F.col("p")[2], F.lit("S999999999")).cast("int").alias("grade"),
        )
        .filter(F.col("grade").isNotNull())
    )
    last = rows.groupBy("qid", "doc_id").agg(F.max_by("grade", seq).alias("_g"))
    return last.select(
        "qid", "doc_id", F.greatest("_g", F.lit(0)).alias("grade"), (F.col("_g") < 0).alias("clamped")
    )


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have at least one judgement."""
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def subsample_corpus(corpus: DataFrame, qrels: DataFrame, max_docs: int, seed: int = 0) -> DataFrame:
    """Keep every judged document, then fill up to ``max_docs`` in a stable random order."""
    judged = qrels.select("doc_id").distinct().withColumn("judged", F.lit(True))
    flagged = corpus.join(judged, "doc_id", "left").withColumn(
        "judged", F.coalesce("judged", F.lit(False))
    )
    keys = flagged.select("doc_id", "judged").withColumn("_u", uniform(seed, "doc_id"))
    order = [(~F.col("judged")).asc(), F.col("_u"), F.col("doc_id")]
    placed = running(keys, [], order, rank="_place")
    chosen = placed.filter(F.col("judged") | (F.col("_place") <= max_docs)).select("doc_id")
    return flagged.join(chosen, "doc_id", "left_semi")


def corpus_audit(corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: judgements, judged documents, those missing from the corpus, clamped grades."""
    judged = qrels.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("clamped").cast("bigint")).alias("c")
    )
    known = corpus.select("doc_id", F.lit(1).alias("known"))
    return judged.join(known, "doc_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_judgements"),
        F.count(F.lit(1)).alias("judged_docs"),
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).cast("bigint").alias("missing_docs"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("clamped_negatives"),
    )


def hash_split(df: DataFrame, key: str, seed: int = 0, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Stable split by a keyed draw: the same key always lands in the same part."""
    u = uniform(seed, key)
    return df.withColumn(
        "split",
        F.when(u < train, F.lit("train")).when(u < train + val, F.lit("val")).otherwise(F.lit("test")),
    )


def query_halves(df: DataFrame, key: str = "qid") -> DataFrame:
    """Key -> 'fit' or 'report': the first half of the keys in order, and the rest."""
    keys = df.select(key).distinct()
    placed = running(keys, [], [F.col(key)], rank="_place")
    n = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    return placed.select(
        key, F.when(F.col("_place") - 1 < F.floor(n / 2), "fit").otherwise("report").alias("half")
    )
