"""Approximate nearest neighbours by inner product: a hash-prefix forest per block of vectors.

Distinct vectors are dealt evenly to blocks of about ``BLOCK_ROWS``, and every batch of queries
visits every block. A block's forest has ``TREES`` trees; a tree is the sorted array of one long
hash string (``BITS`` random hyperplanes) per vector. A query first descends to its longest prefix
matches in all trees, and takes the provisional neighbours found there. From the k-th of these
follows the prefix length at which a vector as near is met in some tree with probability
``RECALL``; all trees then ascend together, bit by bit, to that length, or further until there are
enough candidates (length zero is the whole block). Candidates are scored exactly.

Inner products become angles by one more coordinate: a block's vectors are divided by its largest
norm and filled up to length one, queries get a zero there.

Copies of a vector are searched once: a class of equal vectors has one row in the forest and keeps
its k + 1 smallest ids, more can't be among the k nearest of any query. Blocks are dealt by hash,
so near copies spread over all of them and no block is hot; a task holds one block and one batch.

Defined cases: vectors that are NULL, zero or hold NULL, NaN or infinite components take no part,
nor do those of another length than most have (the longer, if equally many); rows without an id
take no part; of a repeated id the smallest vector counts; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

K = 20
QUERY_STEP = 20
BLOCK_ROWS = 1 << 14
BATCH_QUERIES = 1 << 12
TREES = 32
BITS = 62
RECALL = 0.95
SEED = 7


class Forest:
    """Sorted arrays of hash strings over one block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.bits = vectors, bits
        norms = np.sqrt((vectors * vectors).sum(1))
        self.reach = norms.max()
        fill = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.reach) ** 2))
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, vectors.shape[1] + 1, bits))
        hashes = self._strings(np.c_[vectors / self.reach, fill])
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def _strings(self, x: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(x @ p > 0) @ weights for p in self.planes])

    def _ranges(self, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last position of each query's prefix of ``length`` bits, tree by tree."""
        shift = self.bits - length
        low = strings >> shift << shift
        high = low + (np.int64(1) << shift)
        return (np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, low)]),
                np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, high)]))

    def _ascend(self, strings: np.ndarray, length: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """All trees go up together from ``length`` until they hold ``enough`` rows between them."""
        length = length.copy()
        lo, hi = self._ranges(strings, length)
        while True:
            short = np.flatnonzero(((hi - lo).sum(0) < enough) & (length > 0))
            if not len(short):
                return lo, hi
            length[short] -= 1
            lo[:, short], hi[:, short] = self._ranges(strings[:, short], length[short])

    def _candidates(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.vectors), bool)
        for order, a, b in zip(self.order, lo.tolist(), hi.tolist()):
            seen[order[a:b]] = True
        return np.flatnonzero(seen)

    def search(self, queries: np.ndarray, k: int, recall: float = RECALL) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, (rows, scores) of the ``k`` nearest found and of all that tie with the last."""
        norms = np.sqrt((queries * queries).sum(1))
        strings = self._strings(np.c_[queries / norms[:, None], np.zeros(len(queries))])
        n = len(self.vectors)
        longest = np.full(len(queries), min(self.bits, int(np.log2(n)) + 8))
        lo, hi = self._ascend(strings, longest, 8 * k)
        length = np.zeros(len(queries), np.int64)
        miss = 1.0 - (1.0 - recall) ** (1.0 / len(self.planes))  # a tree must meet a near row this often
        for i, q in enumerate(queries):
            near = self.vectors[self._candidates(lo[:, i], hi[:, i])] @ q
            if len(near) >= k:
                cosine = np.partition(near, len(near) - k)[len(near) - k] / (self.reach * norms[i])
                same_side = 1.0 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
                if same_side > 0:
                    length[i] = self.bits if same_side >= 1 else min(self.bits, int(np.log(miss) / np.log(same_side)))
        lo, hi = self._ascend(strings, length, k)
        out = []
        for i, q in enumerate(queries):
            rows = self._candidates(lo[:, i], hi[:, i])
            if len(rows) < k and (hi - lo)[:, i].max() < n:  # the trees met the same few rows
                rows = np.arange(n)
            scores = self.vectors[rows] @ q
            if len(rows) > k:
                last = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= last - 1e-9 * (1 + abs(last))
                rows = rows[keep]
            # row by row, so that a score does not hang on what stands beside it
            out.append((rows, (self.vectors[rows] * q).sum(1)))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, components as doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v)).alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.filter(F.size("embedding") == (usual["n"] if usual else 0))


def _search_blocks(classes: DataFrame, queries: DataFrame, k: int, recall: float) -> DataFrame:
    """(query, row, score) candidates: the nearest of every block; both sides are (class, embedding)."""
    blocks = -(-max(1, classes.count()) // BLOCK_ROWS)
    batches = -(-max(1, queries.count()) // BATCH_QUERIES)
    rows = classes.select("class", "embedding", F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))
    asked = queries.select("class", "embedding", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(batches)).alias("batch"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(mine: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"query": [], "row": [], "score": []}
        if mine.num_rows and wanted.num_rows:
            def matrix(t):
                return t["embedding"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

            ids = mine["class"].to_numpy()
            for q, (found, scores) in zip(wanted["class"].to_pylist(), Forest(matrix(mine)).search(matrix(wanted), k, recall)):
                best = np.lexsort((ids[found], -scores))[:k]
                out["query"] += [q] * len(best)
                out["row"] += ids[found][best].tolist()
                out["score"] += scores[best].tolist()
        return pa.table({"query": pa.array(out["query"], pa.int64()), "row": pa.array(out["row"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return rows.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInArrow(run, "query long, row long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (a column), its ``k`` nearest found."""
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    # k + 1 ids of each class; the limit is applied before the shuffle too
    members = cut_lineage(rows.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1))
    heads = members.filter("_n = 1").select(F.col("vec_id").alias("class"), "embedding")
    asking = cut_lineage(rows.filter(is_query).join(heads, "embedding").select("vec_id", "class", "embedding"))
    found = _search_blocks(heads, asking.select("class", "embedding").distinct(), k + 1, recall)
    top = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    found = found.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k + 1).select("query", "row", "score")
    named = members.select("vec_id", "embedding").join(heads.withColumnRenamed("class", "row"), "embedding").select("row", "vec_id")
    pairs = asking.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")).join(found, "query").join(named, "row")
    pairs = pairs.filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % QUERY_STEP == 0)
