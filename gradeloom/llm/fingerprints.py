"""Document fingerprints: threshold-scaled sketches of character shingles.

Every run of ``WIDTH`` code points is hashed to 32 bits, and a sketch keeps each distinct hash below
``FRACTION`` of all 32-bit values. A shingle is thus kept in every document or in none: the
sketch of a union is the union of the sketches (:func:`merged`), and the share of a sketch that
another one holds estimates containment however unequal the documents are (:func:`containment`). A
text of fewer code points is one shingle, the empty text has none. A fingerprint is the number of
shingles and the kept hashes in ascending order, four bytes each, big endian; so equal texts have
equal fingerprints. Where a sketch keeps nothing, as short texts' may, the likeness is 1 for equal
fingerprints and 0 for others.

:func:`with_next` compares each document with the next by doc_id and with an edit that takes its
second half from there. Texts cross one shuffle, by ranges of doc_id (and text, where ids
repeat), and are then read in order; only a range's last document is left for the first of the
next range, which is settled by joining one text from each end of a range.

Sketches are made in slices of ``SLICE`` code points, so a very long text takes its own size and
its sketch. Defined cases: a NULL text is empty; rows without a doc_id come first, equal ids in
order of their texts, and each row is a document of its own; the last document's next is the first (of
a single row: itself); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

WIDTH = 12
FRACTION = 1 / 32
SLICE = 1 << 20
#: Fixed values of the hash: an odd multiplier for each place, and the finish of a 64-bit mix.
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> int:
    return pow(int(_PLACE), n, 1 << 64)


def _rolling(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial of every ``width`` neighbours, put together from halves."""
    parts, h, size = [], x, 1
    while width:  # binary digits of the width, lowest first
        if width & 1:
            parts.append((h, size))
        width >>= 1
        if width:
            h = h[:-size] * np.uint64(_powers(size)) + h[size:]
            size *= 2
    out, reach = parts[0]
    for h, size in parts[1:]:
        n = len(h) - reach
        out = h[:n] * np.uint64(_powers(reach)) + out[size:size + n]
        reach += size
    return out


def sketch(points: np.ndarray, fraction: float = FRACTION) -> tuple[int, np.ndarray]:
    """(number of shingles, sorted distinct hashes below the threshold) of a text's code points."""
    if not len(points):
        return 0, np.empty(0, np.uint32)
    if len(points) < WIDTH:
        points = np.concatenate([points, np.zeros(WIDTH - len(points), points.dtype)])
    total, limit, kept = len(points) - WIDTH + 1, np.uint64(int(fraction * 2**32)), []
    for at in range(0, total, SLICE):
        x = _mixed(points[at:at + SLICE + WIDTH - 1].astype(np.uint64) + np.uint64(1))
        h = _mixed(_rolling(x, WIDTH)) >> np.uint64(32)
        kept.append(np.unique(h[h < limit].astype(np.uint32)))
    return total, np.unique(np.concatenate(kept)) if len(kept) > 1 else kept[0]


def packed(made: tuple[int, np.ndarray]) -> bytes:
    """The fingerprint's bytes."""
    return np.concatenate([[min(made[0], 2**32 - 1)], made[1]]).astype(">u4").tobytes()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of a's sketch that b's holds."""
    if len(a[1]):
        return len(np.intersect1d(a[1], b[1], assume_unique=True)) / len(a[1])
    return float(a[0] == b[0] and not len(b[1]))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def sketches(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_shingles, hashes) of every text: the form to store, merge and compare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(code_points(t.as_py()), fraction) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([n for n, _ in made], pa.int64()),
                pa.array([h.astype(np.int64) for _, h in made], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "hashes"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles long, hashes array<long>")


def merged(made: DataFrame, *keys: str) -> DataFrame:
    """(*keys, hash): the union sketch of every group, one row a hash, so that no group is one row."""
    return made.select(*keys, F.explode("hashes").alias("hash")).distinct()


def containment(a: Column | str, b: Column | str) -> Column:
    """Estimated share of a's shingles that b holds; NULL where a kept none."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def containment_in_groups(made: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, *keys, containment) for every document and group of :func:`merged` that share a hash."""
    hashes = made.select("doc_id", F.size("hashes").alias("_size"), F.explode("hashes").alias("hash"))
    met = hashes.join(groups, "hash").groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size"))
    return met.select("doc_id", *keys, (F.col("_n") / F.col("_size")).alias("containment"))


_ROW = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"
_ENDS = f"{_ROW}, range int, end string, text string"


def _judged(text: str, made: tuple, following: str, next_made: tuple, fraction: float) -> tuple:
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    edited_made = sketch(code_points(edited), fraction)
    return (len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(made), packed(edited_made),
            likeness(made, edited_made), likeness(made, next_made))


def with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) for every row of ``docs``."""
    columns = [f.split()[0] for f in _ENDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, rows, size = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id, text = doc_id.as_py(), text.as_py()
                made = sketch(code_points(text), fraction)
                if held is None:
                    rows.append((doc_id, *[None] * 6, here, "first", text))
                else:
                    rows.append((held[0], *_judged(*held[1:], text, made, fraction), None, None, None))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                held = (doc_id, text, made)
                if size > SLICE:
                    yield batch_of(rows)
                    rows, size = [], 0
        if held is not None:
            yield batch_of([*rows, (held[0], *[None] * 6, here, "last", held[1])])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "following"))):
                made, next_made = sketch(code_points(text), fraction), sketch(code_points(following), fraction)
                yield batch_of([(doc_id, *_judged(text, made, following, next_made, fraction), None, None, None)])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by_text = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = plain.repartitionByRange(*by_text).sortWithinPartitions(by_text[0], by_text[1])
    done = cut_lineage(ordered.mapInArrow(in_order, _ENDS))

    # one number for each range that has rows: which range comes after it
    ranges = done.filter("end = 'first'").select("range")
    order = Window.orderBy("range")
    after = ranges.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("after"))
    firsts = done.filter("end = 'first'").select(F.col("range").alias("after"), F.col("text").alias("following"))
    lasts = done.filter("end = 'last'").select("range", "doc_id", "text").join(after, "range").join(firsts, "after")
    settled = lasts.select("doc_id", "text", "following").mapInArrow(settle, _ENDS)
    wanted = columns[:-3]
    return done.filter("end IS NULL").select(*wanted).unionByName(settled.select(*wanted))


def op13(docs: DataFrame) -> DataFrame:
    text = lambda c: F.lower(F.hex(c))
    return with_next(docs).select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
