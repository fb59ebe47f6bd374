"""SimHash fingerprints and their near-duplicate classes by a Gray-order hierarchical index.

A document's text is lower-cased (A-Z only), split into words and 3-word shingles; every
fingerprint bit is the majority over the shingles' XXH64 (seed 42). Fingerprints that differ in
at most two bits are linked.

Distinct fingerprints only are compared. Two fingerprints within two bits agree on at least one
of three blocks of 21 or 22 bits, so every fingerprint goes to three buckets. Inside a bucket
they are sorted by Gray rank (the position in the reflected Gray sequence, where neighbours
differ in few bits) and cut into groups of ``FANOUT``; a node keeps the bits that all below it
share, and its children hold only the bits their parent does not. A search carries the
differences gathered on the way down and drops a whole group once they exceed two.

Buckets above ``BUCKET_LIMIT`` distinct fingerprints are not searched in one task: their members
go by an exact other way (:func:`_ball_links`) whose groups hold at most 65 rows.

Defined cases: a NULL or blank text has fingerprint zero, which is linked like any other; equal
texts share a fingerprint; a NULL doc_id is carried along but never names a component (a
component of NULL ids only has a NULL name); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .common import one_per_class, per_batch, text_key
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
FANOUT = 16
BUCKET_LIMIT = 1 << 16
#: (lowest bit, width) of the blocks; with MAX_BITS + 1 blocks one of them is always free of differences.
BLOCKS = ((0, 21), (21, 22), (43, 21))
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Majority bits over the shingles' hashes as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # on bytes: only A-Z, only the six ASCII spaces
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for lo in range(0, total, 1 << 16):  # a very long text is counted piece by piece
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(lo, min(total, lo + (1 << 16)))),
            np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "fp": [fingerprint(t, shingle) for t in batch["text"].to_pylist()]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over the fingerprints of many buckets; groups never cross a bucket."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.codes = codes[order]
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        self.levels = []  # from the leaves up: first child, children, shared mask, shared bits
        low = high = self.codes  # AND and OR of all below a node
        starts, sizes = edges, np.diff(np.r_[edges, len(codes)])
        self.bucket_sizes = np.repeat(sizes, sizes)
        while True:
            groups = -(-sizes // FANOUT)
            within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
            first = np.repeat(starts, groups) + within * FANOUT
            count = np.minimum(FANOUT, np.repeat(starts + sizes, groups) - first)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            mask = ~(low ^ high)
            self.levels.append((first, count, mask, low & mask))
            starts, sizes = np.cumsum(groups) - groups, groups
            if (groups == 1).all():
                break
        self.root = np.repeat(np.arange(len(edges)), np.diff(np.r_[edges, len(codes)]))

    def search(self, who: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, inside the buckets of rows ``who`` that differ in at most ``max_bits``."""
        node, known = self.root[who], np.zeros(len(who), np.uint64)
        spent = np.zeros(len(who), np.uint8)
        for first, count, mask, shared in reversed(self.levels):
            # only bits that the parent did not already settle are new at this node
            spent = spent + np.bitwise_count((self.codes[who] ^ shared[node]) & mask[node] & ~known).astype(np.uint8)
            keep = spent <= max_bits
            who, node, spent = who[keep], node[keep], spent[keep]
            known, n = mask[node], count[node]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, spent, known, node = np.repeat(who, n), np.repeat(spent, n), np.repeat(known, n), np.repeat(first[node], n) + at
        spent = spent + np.bitwise_count((self.codes[who] ^ self.codes[node]) & ~known).astype(np.uint8)
        keep = (spent <= max_bits) & (who < node)
        return who[keep], node[keep]

    def spanning_links(self, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """(code, smallest code position's code reached) per row that has a link: a forest, not all pairs."""
        parent = np.arange(len(self.codes))
        ends = np.cumsum(self.bucket_sizes)
        lo = 0
        while lo < len(self.codes):  # bounded number of pairs in flight
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            _unite(parent, *self.search(np.arange(lo, hi), max_bits))
            lo = hi
        linked = np.flatnonzero(parent != np.arange(len(parent)))
        return self.codes[linked], self.codes[parent[linked]]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


def _bucketed_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links inside buckets; ``rows`` (bucket, fp) arrive sorted by bucket in each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket, codes):
            if len(codes) > 1:
                a, b = GrayIndex(bucket, codes).spanning_links(max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        bucket, codes = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            bucket = np.r_[bucket, batch["bucket"].to_numpy()]
            codes = np.r_[codes, batch["fp"].to_numpy().view(np.uint64)]
            if len(codes) < 1 << 16:
                continue
            cut = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on in the next batch
            yield from links(bucket[:cut], codes[:cut])
            bucket, codes = bucket[cut:], codes[cut:]
        yield from links(bucket, codes)

    return rows.mapInArrow(run, "a long, b long")


def _ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links of fingerprints in overfull buckets.

    Two words within two bits have a common word within one bit of both, so each word is filed
    under itself and its 64 single-bit flips. At most 65 words lie around a centre, all of them
    within two bits of each other: no group can grow, whatever the data.
    """
    if max_bits != 2:
        raise ValueError("the way for overfull buckets is made for two bits")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = (
        fps.select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .groupBy("centre").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    )
    return balls.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).filter("a != b").distinct()


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints ``distinct`` (fp) within ``max_bits``."""
    if max_bits >= len(BLOCKS):
        raise ValueError(f"{len(BLOCKS)} blocks allow at most {len(BLOCKS) - 1} differing bits")
    keys = F.array(*[
        F.call_function("shiftrightunsigned", F.col("fp"), F.lit(lo)).bitwiseAND((1 << width) - 1) + F.lit(i << 22)
        for i, (lo, width) in enumerate(BLOCKS)])
    rows = distinct.select("fp", F.explode(keys).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    usual = rows.join(sizes.filter(F.col("n").between(2, limit)).select("bucket"), "bucket", "left_semi")
    full = rows.join(sizes.filter(F.col("n") > limit).select("bucket"), "bucket", "left_semi")
    # an explicit exchange: whatever AQE makes of the join, a bucket meets in one task
    usual = usual.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return _bucketed_links(usual, max_bits).union(_ball_links(full.select("fp").distinct(), 2))


def _components(distinct: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """``distinct`` (fp and other columns) with the ``component`` of every fingerprint."""
    classes = connected_components(link_fingerprints(distinct.select("fp"), max_bits, limit), "a", "b")
    named = distinct.join(classes.select(F.col("node").alias("fp"), "component"), "fp", "left")
    return named.withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE_WORDS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: the smallest doc_id reachable by links."""
    marked = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = _components(distinct, max_bits, limit)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with its smallest id (see :func:`common.one_per_class`)."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"text_key": batch["text_key"], "fp": [fingerprint(t) for t in batch["text"].to_pylist()]}

    marked = cut_lineage(per_batch(docs.select(text_key().alias("text_key"), "text"), run, "text_key long, fp long").distinct())
    named = _components(cut_lineage(marked.select("fp").distinct()), MAX_BITS, BUCKET_LIMIT)
    return one_per_class(docs, marked.join(named, "fp").select("text_key", "component"))
