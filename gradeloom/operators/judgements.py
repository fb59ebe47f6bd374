"""Judgement data: digests, verdict cache, responses, hand grades, spend."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as ex

PRICE_PER_MILLION = 0.042
BATCH = 30
HAND_CONFIDENCE = 0.9


def request_digest(backend: Column | str, query: Column | str, signatures: Column | str, rubric: Column | str) -> Column:
    """First 20 hex digits of sha256 over every part followed by the unit separator."""
    us = chr(31)
    parts = F.concat(F.array(ex.col(backend), ex.col(query)), ex.col(signatures), ex.col(rubric))
    return F.substring(F.sha2(F.concat(F.array_join(parts, us), F.lit(us)), 256), 1, 20)


def build_requests(targets: DataFrame, rubric: list[str], backend: str, cap: int = BATCH, rank: str = "contest_rank") -> DataFrame:
    """Batched requests: up to ``cap`` candidates of a query in one state, ``c0..cn``.

    ``rank`` is the candidate's 1-based place; those past the cap go into further batches,
    so every candidate is asked about exactly once.
    """
    if not 2 <= len(rubric) <= 10:
        raise ValueError("a rubric has 2 to 10 levels")
    levels = F.array(*[F.lit(r) for r in rubric])
    rows = (
        targets.withColumn("batch", F.floor((F.col(rank) - 1) / F.lit(cap)).cast("bigint"))
        .groupBy("qid", "query", "batch")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), "item_id", "text"))).alias("_c"))
    )
    texts = F.transform("_c", lambda x: x["text"])

    def ident(i: Column) -> Column:
        return F.concat(F.lit("c"), i.cast("string"))

    def question(i: Column) -> Column:
        ask = F.concat(F.lit("How well does candidate "), ident(i), F.lit(" answer the query?"))
        return F.struct(
            F.lit("score").alias("type"),
            F.struct(ask.alias("question"), ident(i).alias("candidate_id")).alias("instructions"),
            levels.alias("criteria"),
        )

    state = F.struct("query", F.map_from_entries(F.transform("_c", lambda x, i: F.struct(ident(i), x["text"]))).alias("candidates"))
    questions = F.map_from_entries(F.transform("_c", lambda x, i: F.struct(ident(i), question(i))))
    return rows.select(
        request_digest(F.lit(backend), "query", texts, levels).alias("digest"),
        F.lit(backend).alias("backend"),
        "qid",
        "batch",
        F.transform("_c", lambda x: x["item_id"]).alias("item_ids"),
        F.to_json(F.struct(state.alias("state"), questions.alias("questions"))).alias("payload"),
    )


def _distinct_entries(cache: DataFrame) -> DataFrame:
    """One stored verdict per backend and digest: the one with the lowest cost, NULL costs last."""
    rest = [c for c in cache.columns if c not in ("backend", "digest")]
    first = F.min_by(F.struct(*rest), F.struct(F.col("cost_usd").isNull(), "cost_usd")) if "cost_usd" in rest else F.first(F.struct(*rest))
    return cache.groupBy("backend", "digest").agg(first.alias("_v")).select("backend", "digest", "_v.*")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the stored verdict, misses to be asked), by backend and digest; a digest stored twice hits once."""
    on = ["backend", "digest"]
    return requests.join(_distinct_entries(cache), on), requests.join(cache.select(*on), on, "left_anti")


def load_verdicts(spark: SparkSession, path: str, backend: str | None = None) -> DataFrame:
    """The stored verdicts; naming a backend reads only its partition."""
    rows = spark.read.parquet(path)
    return rows if backend is None else rows.filter(F.col("backend") == backend)


def store_verdicts(verdicts: DataFrame, path: str) -> None:
    """Append verdicts (backend, digest, ...) to the cache, one per digest, leaving out digests it holds."""
    spark = verdicts.sparkSession
    verdicts = verdicts.dropDuplicates(["backend", "digest"])
    try:
        known = load_verdicts(spark, path).select("backend", "digest")
        verdicts = verdicts.join(known, ["backend", "digest"], "left_anti")
    except AnalysisException as err:  # the first write
        if "PATH_NOT_FOUND" not in str(err):
            raise
    verdicts.write.mode("append").partitionBy("backend").parquet(path)


CACHE_KEY = ("backend", "digest")


def append_verdicts(verdicts: DataFrame, table: str, buckets: int = 64) -> None:
    """Append verdicts to a cache table bucketed by backend and digest, leaving out what it holds.

    A look-up (:func:`cache_lookup` on :func:`cached_verdicts`) reads the table bucket by bucket and
    shuffles the requests only. Two jobs may append at once: each adds files of its own, and a
    digest that both asked about is stored twice but read once.
    """
    spark = verdicts.sparkSession
    verdicts = verdicts.dropDuplicates([*CACHE_KEY])
    if spark.catalog.tableExists(table):
        verdicts = verdicts.join(spark.table(table).select(*CACHE_KEY), [*CACHE_KEY], "left_anti").select(*spark.table(table).columns)
    verdicts.write.mode("append").bucketBy(buckets, *CACHE_KEY).sortBy(*CACHE_KEY).saveAsTable(table)


def cached_verdicts(spark: SparkSession, table: str) -> DataFrame:
    """One verdict per backend and digest, the cheapest where racing jobs stored several; no row is moved."""
    return _distinct_entries(spark.table(table))


def compact_verdicts(spark: SparkSession, table: str, buckets: int = 64) -> None:
    """Rewrite a cache table with one row per backend and digest; run it while nobody appends."""
    kept = cached_verdicts(spark, table)
    kept.write.bucketBy(buckets, *CACHE_KEY).sortBy(*CACHE_KEY).saveAsTable(f"{table}_compact")
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {table}_compact RENAME TO {table}")


def require_complete(misses: DataFrame) -> None:
    """Read-only replay: fail when anything would have to be asked."""
    if not misses.isEmpty():
        raise RuntimeError("read-only cache: some requests have no stored verdict")


def cache_stats(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Per backend: hits, misses, hit rate and the spend of saved calls.

    A request is a hit when its digest is stored, with a cost or without, and counts once
    however often it is stored.
    """
    stored = cache.groupBy("backend", "digest").agg(F.min("cost_usd").alias("_c"), F.lit(True).alias("_held"))
    j = requests.select("backend", "digest").join(stored, ["backend", "digest"], "left")
    held = F.coalesce("_held", F.lit(False))
    return j.groupBy("backend").agg(
        F.count_if(held).alias("hits"),
        F.count_if(~held).alias("misses"),
        ex.share(held).alias("hit_rate"),
        F.coalesce(F.sum("_c"), F.lit(0.0)).alias("saved_usd"),
    )


_ANSWERS = (
    "struct<answers:map<string,struct<probabilities:map<string,double>,confidence:double>>,"
    "usage:struct<input_tokens:bigint,cost:double>>"
)


def parse_verdicts(responses: DataFrame, levels: int = 4) -> DataFrame:
    """(digest, item_ids, response JSON) -> one row per candidate with its level vector.

    ``problem`` names what is missing: the answers, a candidate's answer, or its
    distribution. Level vectors are renormalised; the cost falls back to the token price.
    """
    ans = F.element_at("_a.answers", F.concat(F.lit("c"), F.col("pos").cast("string")))
    p = F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.coalesce(F.element_at("_p", i.cast("string")), F.lit(0.0))
    )
    tokens = F.coalesce("_a.usage.input_tokens", F.lit(0))
    rows = (
        responses.withColumn("_a", F.from_json("response", _ANSWERS))
        .select("*", F.posexplode("item_ids").alias("pos", "item_id"))
        .withColumn("_ans", ans)
        .withColumn("_p", F.col("_ans.probabilities"))
    )
    problem = (
        F.when(F.col("_a.answers").isNull(), "no answers")
        .when(F.col("_ans").isNull(), "missing answer")
        .when(F.coalesce(F.size("_p"), F.lit(0)) <= 0, "no distribution")
    )
    return (
        rows.withColumn("problem", problem)
        .withColumn("_v", p)
        .withColumn("_mass", F.greatest(ex.arr_sum("_v"), F.lit(1e-9)))
        .withColumn("level_probs", F.when(F.col("problem").isNull(), F.transform("_v", lambda x: x / F.col("_mass"))))
        .withColumn("confidence", F.col("_ans.confidence"))
        .withColumn("input_tokens", tokens)
        .withColumn("request_cost_usd", F.coalesce("_a.usage.cost", tokens / 1e6 * PRICE_PER_MILLION))
        .drop("_a", "_ans", "_p", "_v", "_mass", "response", "item_ids")
    )


def parse_answers(rows: DataFrame) -> DataFrame:
    """(qtype, option_keys, answer JSON) -> probs in option order.

    Score keys are the level numbers; a yes/no answer is one number (0.5 when absent); an
    answer without mass is uniform; an empty or missing distribution is a ``problem``.
    """
    a = F.from_json("answer", "struct<noul:double,probabilities:map<string,double>>")
    keys = F.when(
        F.col("qtype") == "score", F.transform("option_keys", lambda x, i: i.cast("string"))
    ).otherwise(F.col("option_keys"))
    k = F.size("option_keys")
    raw = F.transform(keys, lambda x: F.coalesce(F.element_at("_m", x), F.lit(0.0)))
    yes = F.coalesce("_a.noul", F.lit(0.5))
    uniform = F.transform("option_keys", lambda x: F.lit(1.0) / k)
    noul = F.col("qtype") == "noul"
    problem = F.when(F.col("_a").isNull(), "no answer").when(
        ~noul & (F.coalesce(F.size("_m"), F.lit(0)) <= 0), "no distribution"
    )
    return (
        rows.withColumn("_a", a)
        .withColumn("_m", F.col("_a.probabilities"))
        .withColumn("problem", problem)
        .withColumn("_r", raw)
        .withColumn(
            "probs",
            F.when(F.col("problem").isNotNull(), F.lit(None).cast("array<double>"))
            .when(noul, F.array(1.0 - yes, yes))
            .when(ex.arr_sum("_r") > 0, ex.normalise("_r"))
            .otherwise(uniform),
        )
        .drop("_a", "_m", "_r")
    )


# ---------------------------------------------------------------- hand grades
def smooth_grade(grade: Column | str, levels: int = 4, confidence: float = HAND_CONFIDENCE) -> Column:
    """A hand grade with some doubt on its neighbours; NULL for a grade off the rubric."""
    g = ex.col(grade)
    away = F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda i: F.when(i == g, 0.0).otherwise(F.exp(-F.abs(i - g).cast("double"))),
    )
    doubt = F.transform(ex.normalise(away), lambda x: x * F.lit(1.0 - confidence))
    filled = F.transform(doubt, lambda x, i: F.when(i == g, F.lit(confidence)).otherwise(x))
    return F.when((g >= 0) & (g < levels), filled)


def outstanding(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests that nobody has answered yet."""
    return requests.join(responses.select("digest"), "digest", "left_anti")


def hand_verdicts(requests: DataFrame, responses: DataFrame, levels: int = 4, strict: bool = False) -> DataFrame:
    """One row per request and candidate: given level rows, smoothed grades, or uniform.

    ``responses`` is (digest, grades array or NULL, level_probs array of arrays or NULL). A
    count that differs from the request's, an answer without either field or a grade off
    the rubric becomes a ``problem``; in strict mode an unanswered request is one too.
    """
    j = requests.join(responses.withColumn("_got", F.lit(True)), "digest", "left").withColumn(
        "_rows",
        F.when(F.col("level_probs").isNotNull(), F.transform("level_probs", lambda r: F.transform(
            r, lambda x: x / F.greatest(ex.arr_sum(r), F.lit(1e-9)))))
        .when(F.col("grades").isNotNull(), F.transform("grades", lambda g: smooth_grade(g, levels))),
    )
    n = F.size("item_ids")
    pending = F.col("_got").isNull()
    problem = (
        F.when(pending, "pending" if strict else None)
        .when(F.col("_rows").isNull(), "neither grades nor level_probs")
        .when(F.size("_rows") != n, "count mismatch")
        .when(F.exists("_rows", lambda r: r.isNull()), "grade off the rubric")
    )
    flat = F.array_repeat(F.lit(1.0 / levels), levels)
    rows = j.withColumn("pending", pending).withColumn("problem", problem)
    return rows.select("*", F.posexplode("item_ids").alias("pos", "item_id")).withColumn(
        "level_probs",
        F.when(F.col("problem").isNotNull(), F.lit(None).cast("array<double>"))
        .when(F.col("pending"), flat)
        .otherwise(F.get("_rows", F.col("pos"))),
    ).select("digest", "item_id", "level_probs", "pending", "problem")


# --------------------------------------------------------------------- checks
def expected_grade(probs: Column | str) -> Column:
    return ex.expected_index(probs)


def check_verdicts(rows: DataFrame, levels: int = 4, tolerance: float = 1e-3) -> DataFrame:
    """Add ``problem`` to verdict rows: wrong count, not finite, negative mass sum off one."""
    p = F.col("level_probs")
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn(
        "problem",
        F.when(p.isNull() | (F.size(p) != levels), "count")
        .when(bad, "not finite")
        .when(F.abs(ex.arr_sum(p) - 1.0) > tolerance, "mass"),
    )


def spend_ledger(verdicts: DataFrame) -> DataFrame:
    """(backend, digest, n_candidates, input_tokens, cost_usd, hit) -> totals per backend."""
    paid = ~F.col("hit")
    return verdicts.groupBy("backend").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("hit").alias("hits"),
        ex.share(F.col("hit")).alias("hit_rate"),
        F.coalesce(F.sum(F.when(paid, F.col("input_tokens"))), F.lit(0)).alias("tokens_paid"),
        F.coalesce(F.sum(F.when(paid, F.col("cost_usd"))), F.lit(0.0)).alias("spend_usd"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("cost_usd"))), F.lit(0.0)).alias("saved_usd"),
    )


def confident_disagreements(student: DataFrame, teacher: DataFrame, floor: float = 0.6, n: int = 10) -> DataFrame:
    """Rows (qid, item_id, probs) where both sides are sure and disagree, surest first.

    The n per query are a report's length; the group limit runs before the shuffle.
    """
    s = student.select("qid", "item_id", F.col("probs").alias("student"))
    t = teacher.select("qid", "item_id", F.col("probs").alias("teacher"))
    both = F.least(F.array_max("student"), F.array_max("teacher"))
    rows = s.join(t, ["qid", "item_id"]).withColumn("sureness", both).filter(
        (F.col("sureness") >= floor) & (ex.argmax0("student") != ex.argmax0("teacher"))
    )
    w = Window.partitionBy("qid").orderBy(F.col("sureness").desc(), "item_id")
    return (
        rows.withColumn("place", F.row_number().over(w).cast("bigint"))
        .filter(F.col("place") <= n)
        .select("qid", "item_id", "place", "sureness", ex.argmax0("student").alias("student_pick"), ex.argmax0("teacher").alias("teacher_pick"))
    )


def throughput(timings: DataFrame, by: str = "system") -> DataFrame:
    """(system, items, ms) -> items, total time, time per item and items per second."""
    return timings.groupBy(by).agg(
        F.sum("items").alias("items"),
        F.sum("ms").alias("total_ms"),
        F.try_divide(F.sum("ms"), F.sum("items")).alias("ms_per_item"),
        (F.try_divide(F.sum("items").cast("double"), F.sum("ms")) * 1000.0).alias("items_per_second"),
    )
