"""Source divergence audit: how far the word use of each source lies from the others of its language.

A term is a run of letters (A-Z lower-cased) or characters above U+007F; a language keeps the terms
that at least ``MIN_DOCS`` of its documents hold. Every group (lang, source) and every language
gives each kept term a share p = 1 + floor(10^9 (count + 1) / (N + V)), and p is compared with q by
f = floor((p - q)^2 / q). All numbers are whole, so results do not hang on order or partitioning.

Sums over all kept terms of f between two sources come from a frequent-pattern tree. A term's row
is the list of its nonzero counts in order of source; rows, with multiplicities, are inserted
into a tree in which rows share the nodes of a common beginning. With f0 for two sources that both
lack a term, a sum is V f0, plus what one nonzero count changes (by distinct counts of a source),
plus what two nonzero counts change together. The last is added once for each combination of a
node and one of its ancestors, times the rows that run through the node.

The tree is never whole in one place: rows are grouped with their multiplicities, sorted by path
over range partitions, and every Arrow batch of sorted rows is a piece of the tree (a node that
two batches share is added twice, with its parts of the rows). A task holds one batch and at most
the pairs of sources that it met. Counts are combined in the task before each shuffle, so a hot
source or term costs one row per flush; a term's row has as many entries as it has sources, whose
square is the size of the result.

Defined cases: NULL text, lang or source are empty strings; every row is a document of its own,
repeated ids too; groups without terms get their pairs; where V is 0 all values are 0; ties are
ranked by item; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: A task hands on what it has counted when it holds this many entries.
FLUSH = 200_000
#: A table of at most this many groups is sent to all tasks; a larger one is met in salted pieces.
MAX_BROADCAST, SALTS = 50_000, 32
#: Node-ancestor combinations worked on at once.
BLOCK = 1 << 18

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; bytes above 0x7F only occur inside characters above U+007F."""
    return text.translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), combined as far as FLUSH allows; a NULL term names the group itself."""
    held: dict[tuple[bytes, bytes], list[Counter]] = defaultdict(lambda: [Counter(), Counter()])

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * size, pa.binary()).cast(pa.string()), pa.array([source] * size, pa.binary()).cast(pa.string()),
                pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(docs[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c].cast(pa.binary()) for c in ("lang", "source", "text"))):
            n, docs = held[lang.as_py(), source.as_py()]
            before, terms = len(n), terms_of(text.as_py())
            n.update(terms)
            docs.update(set(terms))
            entries += len(n) - before
            if entries > FLUSH:
                yield from flush()
                entries = 0
    yield from flush()


def kept_rows(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, items): counts per source of every kept term; the row with a NULL term lists all sources."""
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = (
        plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("items"))
    return rows.filter(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", "items")


def share(count: Column | str, total: Column | str) -> Column:
    """p of a term: 1 + floor(SCALE * (count + 1) / total), in decimals so that it cannot overflow."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (F.col(count) + 1 if isinstance(count, str) else count + 1), F.col(total) if isinstance(total, str) else total) + 1


def gap(p: str, q: str) -> Column:
    """f = floor((p - q)^2 / q)"""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _beside(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` met with the small table ``groups``, however few keys there are."""
    if groups.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(groups), on)
    salted = rows.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "_salt"]).drop("_salt")


def _groups(kept: DataFrame) -> DataFrame:
    """(lang, source, sid, total, p0, lang_total, v): one row per group; sid numbers a language's sources in order."""
    v = kept.groupBy("lang").agg(F.count("term").alias("v"))
    sums = kept.select("lang", "term", F.explode("items").alias("i")).groupBy("lang", F.col("i.source").alias("source")).agg(F.sum("i.n").alias("total"))
    by_lang = Window.partitionBy("lang")
    joined = sums.join(v, "lang").select(
        "lang", "source", "v", F.row_number().over(by_lang.orderBy("source")).alias("sid"),
        (F.col("total") + F.col("v")).alias("total"), (F.sum("total").over(by_lang) + F.col("v")).alias("lang_total"))
    return cut_lineage(joined.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), "total"))))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of ``values`` by equal rows of ``keys``."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)] if len(order) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    return [k[starts] for k in keys], np.add.reduceat(values[order], starts) if len(starts) else values


def tree_sums(lang: np.ndarray, offsets: np.ndarray, items: dict[str, np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Corrections ((lang, s, o), value) of a piece of the tree: rows sorted by lang and path, each ``times`` over.

    Row r has the items offsets[r]:offsets[r + 1] (sid, n, p, p0). A node at depth d stands for a
    run of rows that agree up to and with d; its row count is summed once, and it meets its d
    ancestors once, for both directions of the pair. |value| stays far below 2^63, as the squares
    of shares that sum up to 10^9 + V do.
    """
    size = np.diff(offsets)
    # agreeing items of each row with the row before
    agree, alive = np.zeros(len(size), np.int64), np.flatnonzero(np.r_[False, lang[1:] == lang[:-1]]) if len(size) else np.empty(0, np.int64)
    depth = 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        here, before = offsets[alive] + depth, offsets[alive - 1] + depth
        alive = alive[(items["sid"][here] == items["sid"][before]) & (items["n"][here] == items["n"][before])]
        depth += 1
        agree[alive] = depth
    keys, values = [np.empty(0, np.int64)] * 3, np.empty(0, np.int64)
    for d in range(1, int(size.max(initial=0))):
        rows = np.flatnonzero(size > d)
        starts = np.flatnonzero(agree[rows] <= d)
        through = np.add.reduceat(times[rows], starts)
        heads = rows[starts]
        step = max(1, BLOCK // d)
        for at in range(0, len(heads), step):
            head, m = np.repeat(heads[at:at + step], d), np.repeat(through[at:at + step], d)
            node = offsets[head] + d
            up = offsets[head] + np.tile(np.arange(d), len(heads[at:at + step]))
            new_k, new_v = [], []
            for s, o in ((node, up), (up, node)):
                p, p0, q, q0 = items["p"][s], items["p0"][s], items["p"][o], items["p0"][o]
                new_v.append(m * (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)))
                new_k.append((lang[head], items["sid"][s], items["sid"][o]))
            keys, values = _summed([np.concatenate([k, *n]) for k, n in zip(keys, zip(*new_k))], np.concatenate([values, *new_v]))
    return keys, values


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch["lang"].dictionary_encode()
        flat = batch["items"].flatten()
        offsets = batch["items"].offsets.to_numpy().astype(np.int64)
        items = {name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("sid", "n", "p", "p0")}
        (lang, s, o), values = tree_sums(code.indices.to_numpy().astype(np.int64), offsets - offsets[0], items, batch["times"].to_numpy())
        yield pa.RecordBatch.from_arrays([
            code.dictionary.take(pa.array(lang)), pa.array(s, pa.int64()).cast(pa.int32()), pa.array(o, pa.int64()).cast(pa.int32()), pa.array(values, pa.int64())],
            ["lang", "s", "o", "value"])


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, s, o, value) for every two sources of a language; counts: (lang, term, sid, n, p, p0)."""
    rows = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("sid", "n", "p", "p0"))).alias("items"))
    rows = rows.groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    both = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items").mapInArrow(_pieces, "lang string, s int, o int, value long")

    others = groups.select("lang", F.col("sid").alias("o"), F.col("p0").alias("q0"), "v")
    # what one nonzero count changes: by distinct counts of a source, against every other source's p0
    distinct = counts.groupBy("lang", "sid", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    met = _beside(distinct, others, ["lang"]).filter("sid != o")
    single = met.groupBy("lang", F.col("sid").alias("s"), "o").agg(
        F.sum((F.col("times") * (gap("p", "q0") - gap("p0", "q0"))).cast("decimal(38,0)")).alias("there"),
        F.sum((F.col("times") * (gap("q0", "p") - gap("q0", "p0"))).cast("decimal(38,0)")).alias("back"))
    base = _beside(groups.select("lang", F.col("sid").alias("s"), "p0"), others, ["lang"]).filter("s != o")
    base = base.select("lang", "s", "o", F.when(F.col("v") > 0, F.col("v") * gap("p0", "q0")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))
    parts = (
        base.unionByName(single.select("lang", "s", "o", F.col("there").alias("value")))
        .unionByName(single.select("lang", F.col("o").alias("s"), F.col("s").alias("o"), F.col("back").alias("value")))
        .unionByName(both.withColumn("value", F.col("value").cast("decimal(38,0)")))
    )
    return parts.groupBy("lang", "s", "o").agg(F.sum("value").cast("long").alias("value"))


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and the ``top`` terms that each source overuses."""
    kept = cut_lineage(kept_rows(docs, min_docs))
    groups = _groups(kept)
    exploded = kept.filter("term IS NOT NULL").select(
        "lang", "term", F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["n"]).alias("lang_n"), F.explode("items").alias("i"))
    counts = _beside(exploded.select("lang", "term", "lang_n", "i.source", "i.n"), groups, ["lang", "source"])
    counts = counts.select("lang", "source", "term", "sid", "n", "p0", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"))

    terms = counts.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    names = groups.select("lang", "source", "sid")
    pairs = pair_sums(counts.select("lang", "term", "sid", "n", "p", "p0"), groups)
    pairs = _beside(pairs, names.withColumnRenamed("sid", "s"), ["lang", "s"])
    pairs = _beside(pairs, names.select("lang", F.col("source").alias("item"), F.col("sid").alias("o")), ["lang", "o"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def op11(docs: DataFrame) -> DataFrame:
    return divergences(docs)


def oracle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT k, lang, source, translate(raw, '{upper}', '{upper.lower()}') AS term
  FROM (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS raw FROM d)
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}
), v AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), f AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v)::HUGEINT AS p,
    1 + ({SCALE}::HUGEINT * (kept.lang_n + 1)) // (v.lang_total + v.v)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), both_sides AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM f AS a JOIN f AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN both_sides AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM f WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
