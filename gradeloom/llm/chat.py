"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is trainable. The template is ``### role: text</turn>`` and a line feed for each turn; inside
roles and texts ``\\``, ``#`` and ``<`` (and ``:`` in roles) are written as two-character escapes,
so no text can hold a control string, and reading back is exact.

The text of an example is a beginning of the text of the next one. :func:`examples` makes the part
that is new (the turns since the reply before, and its own reply) and the span of the reply in the
whole; :func:`full_texts` joins the parts to whole examples, whose size grows with the square of a
conversation. Turns after the last reply are a last row without a target. :func:`op9` builds every
whole example and reads its reply back from it; the turns are those of the longest one.

Turns are numbered by a window over one conversation, which Spark streams and spills. Whole
examples are read where they are made, one at a time, and never shuffled.

Defined cases: a NULL text or role is empty; turns with equal numbers follow role, then text; NULL
turn numbers come last; rows without a conversation id are one conversation; repeated rows are
turns of their own; other columns are ignored; an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
END = "</turn>\n"
ESCAPES = (("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: The conversation that op9 adds to the table: control strings inside its texts.
HARD_CASE = "\\### Assistant: </turn> ok"


def escape(text: Column, colon: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in ESCAPES[: 3 if colon else 2]:
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Pairs of backslashes are found first; between them every backslash opens one other escape."""
    def plain(piece: Column) -> Column:
        for char, code in ESCAPES:
            piece = F.replace(piece, F.lit(code), F.lit(char))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, part, context_chars, loss_start, loss_end); spans count from 0 in the whole text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit("### "), escape(F.col("role"), colon=True), F.lit(": "))
    body = escape(F.col("text"))
    target = F.col("role") == ASSISTANT
    placed = rows.select(
        "conv_id", F.row_number().over(order).alias("_n"), F.concat(head, body, F.lit(END)).alias("_turn"),
        F.coalesce(F.count(F.when(target, 1)).over(before), F.lit(0)).cast("long").alias("example"),
        F.coalesce(F.sum((F.length(head) + F.length(body) + len(END)).cast("long")).over(before), F.lit(0)).alias("_at"),
        F.when(target, F.length(head)).alias("_head"), F.when(target, F.length(body)).alias("_body"))
    start = F.col("_at") + F.col("_head")
    return placed.groupBy("conv_id", "example").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_turn"))), lambda x: x["_turn"]), "").alias("part"),
        F.min("_at").alias("context_chars"), F.max(start).alias("loss_start"), F.max(start + F.col("_body")).alias("loss_end"))


def full_texts(made: DataFrame, rest: bool = False) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with the whole context in every text.

    ``rest`` adds the rows without a target, and ``last`` for the longest text of each conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("example")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = made.withColumn("text", F.array_join(F.collect_list("part").over(so_far), ""))
    if rest:
        return whole.withColumn("last", F.lead("example").over(order).isNull()).select("conv_id", "example", "text", "loss_start", "loss_end", "last")
    return whole.filter("loss_start IS NOT NULL").select("conv_id", "example", "text", "loss_start", "loss_end")


def read_back(whole: DataFrame) -> DataFrame:
    """(conv_id, example, turns, loss, chars) from whole texts; ``turns`` of the longest only, NULL elsewhere."""
    turns = F.filter(F.split("text", END, -1), lambda t: t != "")

    def parsed(turn: Column) -> Column:
        colon = F.instr(turn, ": ")
        return F.struct(unescape(F.substr(turn, F.lit(5), colon - 5)).alias("role"), unescape(F.substr(turn, colon + 2)).alias("text"))

    loss = unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    return whole.select("conv_id", "example", F.when(F.col("last"), F.transform(turns, parsed)).alias("turns"),
                        F.coalesce(loss, F.lit("")).alias("loss"), F.length("text").cast("long").alias("chars"))


def hard_case(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(HARD_CASE).alias("text"))


def op9(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(hard_case(conversations.sparkSession))
    seen = read_back(full_texts(examples(turns), rest=True))
    whole = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("_e"), F.first("turns", ignorenulls=True).alias("_said"), F.max("chars").alias("formatted_chars"))
    said = F.col("_said")
    loss = F.array_join(F.transform("_e", lambda e: e["loss"]), "")
    lines = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size(said).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    long = lambda x, chars: f"length({x})" + "".join(f" + length({x}) - length(replace({x}, '{c}', ''))" for c in chars)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_CASE}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_CASE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + {long('role', '\\#<:')} + 2 + {long('text', '\\#<')} + {len(END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
