"""Typed decision examples: checks, labels, options, targets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.lineage import cut_lineage

TYPES = ("choice", "score", "noul")
# fixed values: how the two answers of a yes/no question read by default
NOUL_FALSE = "no, the statement does not hold"
NOUL_TRUE = "yes, the statement holds"


def resolve_labels(parsed: DataFrame) -> DataFrame:
    """``label`` as a 0-based position: by name, by flag or by number; NULL when unresolved."""
    pos = F.nullif(F.array_position("option_keys", F.col("label_text")), F.lit(0)) - 1
    label = (
        F.when(F.col("label_kind") == "name", pos)
        .when(F.col("label_kind") == "flag", (F.col("label_text") == "true").cast("int"))
        .when(F.col("label_kind") == "index", F.col("label_text").try_cast("int"))
    )
    return ex.settle(parsed, {"label": label.cast("int")})


def render_options(parsed: DataFrame) -> DataFrame:
    """``options``: the texts a model sees, in label order, and their number ``k``."""
    keys, notes = F.col("option_keys"), F.col("option_notes")

    def with_note(key: Column) -> Column:
        note = F.nullif(F.element_at(notes, key), F.lit(""))
        return F.when(note.isNull(), key).otherwise(F.concat(key, F.lit(": "), note))

    def answer(key: str, default: str) -> Column:
        note = F.nullif(F.element_at(notes, F.lit(key)), F.lit(""))
        return F.concat(F.lit(f"{key}: "), F.coalesce(note, F.lit(default)))

    choice = F.when(F.col("criteria_kind") == "object", F.transform(keys, with_note)).otherwise(keys)
    level = F.transform(keys, lambda c, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), c))
    texts = (
        F.when(F.col("qtype") == "choice", choice)
        .when(F.col("qtype") == "score", level)
        .when(F.col("qtype") == "noul", F.array(answer("false", NOUL_FALSE), answer("true", NOUL_TRUE)))
    )
    return ex.settle(parsed, {"options": texts}).withColumn("k", F.coalesce(F.nullif(F.size("options"), F.lit(-1)), F.lit(0)))


def check_examples(rows: DataFrame) -> DataFrame:
    """Add ``errors``: every broken rule of a row; an empty list means valid."""
    k, qtype, soft = F.col("k"), F.col("qtype"), F.col("soft_label")
    named = F.col("label_kind") == "name"
    mass = ex.arr_sum(soft)
    rules = {
        "not json": ~F.col("is_json"),
        "unknown type": F.col("is_json") & ~F.coalesce(qtype.isin(*TYPES), F.lit(False)),
        "choice needs criteria": (qtype == "choice") & (k == 0),
        "score needs an ordered list of 2 to 10": (qtype == "score")
        & ((F.coalesce(F.col("criteria_kind"), F.lit("")) != "list") | (k < 2) | (k > 10)),
        "unknown label name": named & F.col("label").isNull(),
        "label out of range": F.col("label").isNotNull() & ((F.col("label") < 0) | (F.col("label") >= k)),
        "soft label length": soft.isNotNull() & (F.size(soft) != k),
        "soft label without mass": soft.isNotNull() & (F.coalesce(mass, F.lit(0.0)) <= 0),
        "no label": F.col("label").isNull() & soft.isNull() & ~F.coalesce(named, F.lit(False)),
    }
    flags = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return ex.settle(rows, {"errors": F.filter(flags, lambda e: e.isNotNull())})


def prepare(parsed: DataFrame) -> DataFrame:
    return check_examples(render_options(resolve_labels(parsed)))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def with_targets(rows: DataFrame) -> DataFrame:
    """``target``: the normalised soft label, else one-hot of the hard label."""
    return rows.withColumn(
        "target", F.when(F.col("soft_label").isNotNull(), ex.normalise("soft_label")).otherwise(ex.one_hot("label", "k"))
    )


def permute_options(rows: DataFrame, epoch: int = 0, seed: int = 0, key: str = "ex_id") -> DataFrame:
    """Reorder the options of choice and noul rows; label and soft label move along.

    The order depends only on (seed, epoch, example, option), so an epoch can be repeated.
    """
    drawn = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda i: F.struct(ex.uniform(seed, F.lit(epoch), key, i).alias("u"), i.alias("i")),
    )
    plain = F.sequence(F.lit(0), F.col("k") - 1)
    order = F.when(F.col("qtype").isin("choice", "noul"), F.transform(F.array_sort(drawn), lambda x: x["i"])).otherwise(plain)

    def moved(c: str) -> Column:
        return F.transform("_order", lambda i: F.get(c, i))

    return (
        ex.settle(rows, {"_order": order})
        .withColumn("options", moved("options"))
        .withColumn("soft_label", F.when(F.col("soft_label").isNotNull(), moved("soft_label")))
        .withColumn("label", (F.array_position("_order", F.col("label")) - 1).cast("int"))
        .withColumnRenamed("_order", "order")
    )


def label_report(rows: DataFrame) -> DataFrame:
    """Long report (section, key, n, share): by type, by option count, by label, soft share
    and majority baseline (most frequent label over all examples)."""
    facts = ex.variants(
        ("section", "key"),
        ("type", F.col("qtype")),
        ("options", F.col("k").cast("string")),
        ("label", F.col("label").cast("string")),
        ("soft", F.col("soft_label").isNotNull().cast("string")),
        ("examples", "all"),
    )
    counts = cut_lineage(
        rows.select(F.inline(facts)).filter(F.col("key").isNotNull())
        .groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.filter(F.col("section") == "examples").agg(F.max("n")).scalar()
    top = counts.filter(F.col("section") == "label").groupBy("section").agg(F.max("n").alias("n")).select(
        F.lit("majority").alias("section"), F.lit("baseline").alias("key"), "n"
    )
    return counts.unionByName(top).withColumn("share", F.round(F.col("n") / total, 4))


def slice_key(by: str, qtype: str = "qtype", k: str = "k", meta: str = "meta") -> Column:
    """'type', 'options' (type and size bucket) or a key of the meta map."""
    if by == "type":
        return F.col(qtype)
    if by == "options":
        return ex.size_bucket(qtype, k)
    return F.coalesce(F.element_at(F.col(meta), F.lit(by)), F.lit("unknown"))


def sharpen(probs: Column | str, temperature: float) -> Column:
    return ex.normalise(F.transform(ex.col(probs), lambda x: F.pow(F.greatest(x, F.lit(1e-9)), F.lit(1.0 / temperature))))


def attach_soft_labels(rows: DataFrame, verdicts: DataFrame, key: str = "ex_id") -> DataFrame:
    """Teacher distributions become soft labels where their length matches the options."""
    j = rows.drop("soft_label").join(verdicts.select(key, F.col("probs").alias("_p")), key, "left")
    fits = F.size("_p") == F.col("k")
    return (
        j.withColumn("soft_label", F.when(fits, ex.normalise("_p")))
        .withColumn("teacher_status", F.when(F.col("_p").isNull(), "missing").when(fits, "attached").otherwise("length mismatch"))
        .drop("_p")
    )
