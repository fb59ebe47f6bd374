"""Classes of texts whose five-word shingle sets have a Jaccard similarity of at least 0.8.

Texts are split into words as in :mod:`simhash` (A-Z lower-cased, ASCII spaces); a text of fewer
than five words is one shingle. Texts are linked if |A and B| / |A or B| >= 4/5, and a class is what
links connect. No link is missed: under one order of all shingles, two sets that similar share one
among the first |X| - ceil(0.8 |X|) + 1 of each, so only these heads are shuffled and met. The
order is by hash, with the shingles that a sample holds often at the end, so that common lines
and phrases bring few texts together; any order gives the same links. A pair that meets at places
i and j can share at most min(|A| - i, |B| - j) shingles if it met nowhere before; where that
is below 4/9 (|A| + |B|), which 0.8 needs, the pair goes without a look at its sets.

Candidates are compared by their whole sets, in three rounds: first what op2's Gray-order index
(:mod:`simhash`) links within two bits, then every member of a shingle's bucket with the bucket's
center, then those pairs of a bucket whose classes are still apart. The center is the set that has
the shingle at the earliest place: in a group of near copies that is the one with the fewest edits,
as an edit puts rare shingles before the shared ones, so most members are similar to it and few
pairs are left for the last round. Pairs are checked star by star, by their heads first and what these leave open by the whole
texts: the centre is read once and its members stream past, so a task holds two sets; a star of
many members is split over salts, each with its own copy of the centre.

Equal sets are one (a 64-bit digest names them), so exact copies cost nothing. Blank texts have
the empty set and are one class; NULL is blank. Repeated rows, and rows with a NULL or a repeated
doc_id, count by their texts. Other columns are not read, whatever their names. An empty table
gives no classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .common import beside, one_per_class, small_batches, text_key
from .components import connected_components
from .simhash import fingerprint, link_fingerprints

SHINGLE_WORDS = 5
#: One text in SAMPLE says which shingles are common: those that COMMON of its texts hold.
SAMPLE, COMMON, MAX_COMMON = 16, 8, 1 << 20
#: Members that are checked next to one copy of a centre's text.
STAR = 256
#: Rows handed on at once; texts come in batches of Spark's own size and are read one by one.
ROWS = 1000


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + SHINGLE_WORDS])) for i in range(n)), np.uint64, n).view(np.int64))


def set_digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def head_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of the set, ``common`` ones (sorted) last."""
    n = len(hashes) - (4 * len(hashes) + 4) // 5 + 1 if len(hashes) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(common[at] == hashes, kind="stable")]
    return hashes[:n]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def _common(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()))], ["shingle"])

    some = texts.filter(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").count()
    often = counts.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MAX_COMMON)
    return np.sort(often.select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64))  # 8 MB at most


def _marked(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(text_key, doc_id, fp, size, head, code) of every row of ``texts``; ``code`` is op2's fingerprint."""
    known = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), []
                for text in part["text"]:
                    hashes = shingle_set(text.as_py())
                    out.append((set_digest(hashes), len(hashes), head_of(hashes, known.value), fingerprint(text.as_py())))
                fp, size, head, code = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part["text_key"], part["doc_id"], pa.array(fp, pa.int64()), pa.array(size, pa.int32()), pa.array(head, pa.list_(pa.int64())), pa.array(code, pa.int64())],
                    ["text_key", "doc_id", "fp", "size", "head", "code"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return cut_lineage(texts.mapInArrow(run, f"text_key long, doc_id {id_type}, fp long, size int, head array<long>, code long"))


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (shingle, fp, size, pos) without the shingles of one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row so far, and whether the row before has its shingle
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            shingle = got["shingle"].to_numpy()
            same = shingle[1:] == shingle[:-1]
            keep = np.r_[met, same] | np.r_[same, False]
            last = len(shingle) - 1
            held, met = got.slice(last).to_batches()[0], bool(same[-1]) if last else met
            yield from got.slice(0, last).filter(pa.array(keep[:last])).to_batches()
        if met:
            yield held

    # an explicit exchange: whatever AQE makes of it, a shingle meets in one task, which streams it
    return rows.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "shingle long, fp long, size int, pos int")


def _possible(size: str, pos: str, size2: str, pos2: str) -> Column:
    """Whether two sets that first meet at these places can be similar enough; so their sizes are near, too."""
    left = F.least(F.col(size) - F.col(pos), F.col(size2) - F.col(pos2))
    return 9 * left >= 4 * (F.col(size) + F.col(size2))


def _stars(pairs: DataFrame) -> DataFrame:
    """(fp, center, salt, leads): where every set of ``pairs`` (center, member) is wanted."""
    stars = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    members = pairs.join(stars, "center").select(F.col("member").alias("fp"), "center", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads"))
    centers = stars.select(F.col("center").alias("fp"), "center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"))
    return members.unionByName(centers)


def _star_by_star(rows: DataFrame, read: Callable, alike: Callable) -> DataFrame:
    """(center, member) where ``alike(read(center's row), read(member's row))``; rows: (center, salt, leads, fp, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, held = None, None
        for batch in batches:
            found = []
            for k, (c, leads, fp) in enumerate(zip(batch["center"], batch["leads"], batch["fp"])):
                if leads.as_py():
                    center, held = c.as_py(), read(batch, k)
                elif alike(held, read(batch, k)):
                    found.append((center, fp.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["center", "member"])

    met = rows.repartition("center", "salt").sortWithinPartitions("center", "salt", F.desc("leads"))
    return cut_lineage(met.mapInArrow(run, "center long, member long").distinct())


def _plausible(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    """Whether two sets (size, head) can be similar enough.

    Up to where the first of the two heads ends, what they share is in both heads; behind it, the
    set whose head that is has no more than its other shingles.
    """
    shared = len(np.intersect1d(a[1], b[1], assume_unique=True))
    left = max(a[0] - len(a[1]), b[0] - len(b[1]))
    return 9 * (shared + left) >= 4 * (a[0] + b[0])


def _verified(pairs: DataFrame, sets: DataFrame, owner: DataFrame, texts: DataFrame) -> DataFrame:
    """Those ``pairs`` (center, member) whose sets are similar enough: by their heads first, then by the whole texts."""
    heads = _stars(pairs).join(sets, "fp").select("center", "salt", "leads", "fp", "size", "head")
    likely = _star_by_star(heads, lambda batch, k: (batch["size"][k].as_py(), batch["head"][k].values.to_numpy()), _plausible)
    sent = cut_lineage(_stars(likely).join(owner, "fp"))
    rows = texts.join(beside(sent), "text_key").filter(F.col("doc_id").eqNullSafe(F.col("owner"))).select("center", "salt", "leads", "fp", "text")
    return _star_by_star(rows, lambda batch, k: shingle_set(batch["text"][k].as_py()), _similar)


def _centered(pairs: DataFrame) -> DataFrame:
    """Pairs (center, member), each of two sets once."""
    return pairs.groupBy(F.least("center", "member").alias("a"), F.greatest("center", "member").alias("b")).agg(F.min("center").alias("center")).select(
        "center", F.when(F.col("center") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))


def distinct_sets(marked: DataFrame) -> DataFrame:
    """(fp, size, head), one row a set."""
    return cut_lineage(marked.select("fp", "size", "head").dropDuplicates(["fp"]))


def candidate_rows(sets: DataFrame) -> DataFrame:
    """(shingle, fp, size, pos) of all heads, where two sets meet at least."""
    return cut_lineage(_shared(sets.select("fp", "size", F.posexplode("head").alias("pos", "shingle")).select("shingle", "fp", "size", "pos")))


def indexed_pairs(marked: DataFrame) -> DataFrame:
    """(center, member): sets of one fingerprint, and of fingerprints that op2's index links, if their sizes are near.

    One set stands for a fingerprint and the index gives a forest of links, so these are a few pairs a set at most.
    """
    coded = cut_lineage(marked.select("code", "fp", "size").distinct())
    heads = cut_lineage(coded.groupBy("code").agg(F.min(F.struct("fp", "size")).alias("h")))
    links = link_fingerprints(heads.select(F.col("code").alias("fp")))
    same = coded.join(heads, "code").select(F.struct("fp", "size").alias("m"), F.col("h").alias("c"))
    linked = links.join(heads.select(F.col("code").alias("a"), F.col("h").alias("m")), "a").join(heads.select(F.col("code").alias("b"), F.col("h").alias("c")), "b").select("m", "c")
    near = 5 * F.least("m.size", "c.size") >= 4 * F.greatest("m.size", "c.size")
    met = same.unionByName(linked).filter((F.col("m.fp") != F.col("c.fp")) & near)
    return _centered(met.select(F.col("c.fp").alias("center"), F.col("m.fp").alias("member")))


def star_pairs(rows: DataFrame) -> DataFrame:
    """(center, member): every row of a shingle with the set that has the shingle at the earliest place."""
    first = rows.groupBy("shingle").agg(F.min(F.struct("pos", "fp", "size")).alias("e"))
    met = rows.join(first, "shingle").filter((F.col("fp") != F.col("e.fp")) & _possible("size", "pos", "e.size", "e.pos"))
    return _centered(met.select(F.col("e.fp").alias("center"), F.col("fp").alias("member")))


def _apart(pairs: DataFrame, classes: DataFrame, seen: DataFrame) -> DataFrame:
    """Those ``pairs`` that were not ``seen`` and that ``classes`` (fp, component) does not join."""
    sides = [classes.select(F.col("fp").alias(side), F.col("component").alias(name)) for side, name in (("center", "_c"), ("member", "_m"))]
    named = pairs.join(sides[0], "center", "left").join(sides[1], "member", "left")
    open_ = named.filter(F.coalesce("_c", "center") != F.coalesce("_m", "member"))
    x, y = F.least("center", "member").alias("x"), F.greatest("center", "member").alias("y")
    return cut_lineage(open_.select("center", "member", x, y).join(seen.select(x, y), ["x", "y"], "left_anti").select("center", "member"))


def open_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(center, member): the pairs of a shingle that ``classes`` (fp, component) does not join."""
    named = rows.join(classes, "fp", "left").withColumn("c", F.coalesce("component", "fp")).drop("component")
    mixed = named.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("shingle")
    left = cut_lineage(named.join(mixed, "shingle", "left_semi"))
    right = left.select("shingle", F.col("fp").alias("fp2"), F.col("size").alias("size2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"))
    met = left.join(right, "shingle").filter((F.col("c") < F.col("c2")) & _possible("size", "pos", "size2", "pos2"))
    return _centered(met.select(F.col("fp").alias("center"), F.col("fp2").alias("member")))


def links_of(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (center, member) that connect exactly the sets of ``marked`` (text_key, doc_id, fp, size, head, code) that are similar enough."""
    sets = distinct_sets(marked)
    # one row stands for all that have a set
    first = marked.groupBy("fp").agg(F.min(F.struct("text_key", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("o"))
    owner = first.select("fp", F.col("o.text_key").alias("text_key"), F.col("o.doc_id").alias("owner"))
    none = texts.sparkSession.createDataFrame([], "fp long, component long")

    def classes_of(links: DataFrame) -> DataFrame:
        return none if links.isEmpty() else connected_components(links, "center", "member").select(F.col("node").alias("fp"), "component")

    seen = cut_lineage(indexed_pairs(marked))
    near = _verified(seen, sets, owner, texts)
    rows = candidate_rows(sets)
    for make in (lambda classes: star_pairs(rows), lambda classes: open_pairs(rows, classes)):
        classes = classes_of(near)
        pairs = _apart(make(classes), classes, seen)
        if not pairs.isEmpty():
            near, seen = near.union(_verified(pairs, sets, owner, texts)), seen.union(pairs)
    return near


def text_classes(docs: DataFrame) -> DataFrame:
    """(text_key, component) for every text of ``docs``."""
    texts = docs.select(text_key().alias("text_key"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    with small_batches(docs.sparkSession):  # every step that reads texts is run in here
        marked = _marked(texts, _common(texts))
        links = links_of(marked, texts)
    classes = connected_components(links, "center", "member").select(F.col("node").alias("fp"), "component")
    named = marked.select("text_key", "fp").distinct().join(classes, "fp", "left")
    return named.select("text_key", F.coalesce("component", "fp").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with its smallest id (see :func:`common.one_per_class`)."""
    return one_per_class(docs, text_classes(docs))
