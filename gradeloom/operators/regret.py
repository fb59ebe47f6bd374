"""Expected regret of shipping a pool in its current order, by keyed draws over pools of any size.

Each draw perturbs every utility by its sigma and takes the result for the truth; the regret is
the share of nDCG@k that the shipped order then loses. Only two things of a draw count: its k
largest values, and the values of the k candidates shipped first. So a candidate that is in no
draw's first k, not among the first k shipped and at no end of a column's range can go, and what is left
of two parts of a pool can be put together and thinned again: at most k (draws + 1) + 4 rows
stay of any number. Rows are thinned where they lie, before the shuffle, and again while a pool's
rows stream by; no pool is ever gathered in a row or a task's memory.

Draws are those of :mod:`functions.draws`, keyed by (seed, qid, item_id, draw), so a before/after
pair sees the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.draws import normals, words

#: Rows of a pool that are held before they are thinned, at least.
BLOCK = 4096


class _Pool:
    """What is left of a pool's rows, in columns."""

    def __init__(self, batch: pa.RecordBatch):
        self.u, self.s, self.scale = (batch[c].to_numpy(zero_copy_only=False) for c in ("utility", "sigma", "_scale"))
        self.words = np.stack([batch["_w0"].to_numpy(), batch["_w1"].to_numpy()], axis=1)
        # the order of ids is all that counts; numpy compares numbers and strings
        self.ids = batch["item_id"].to_numpy(zero_copy_only=False)

    def take(self, rows: np.ndarray) -> _Pool:
        out = object.__new__(_Pool)
        for name in ("u", "s", "scale", "words", "ids"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    def plus(self, other: _Pool) -> _Pool:
        out = object.__new__(_Pool)
        for name in ("u", "s", "scale", "words", "ids"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        return out

    def __len__(self) -> int:
        return len(self.u)

    def drawn(self, draws: int) -> np.ndarray:
        return self.u[:, None] + self.s[:, None] * normals(self.words, draws)

    def shipped(self, k: int) -> np.ndarray:
        return np.lexsort((self.ids, -self.u))[:k]

    def needed(self, k: int, draws: int) -> np.ndarray:
        """The rows that can still count, in their order."""
        x = self.drawn(draws)
        keep = (x >= np.partition(x, len(x) - k, axis=0)[len(x) - k]).any(axis=1) if len(x) > k else np.ones(len(x), bool)
        keep[self.shipped(k)] = True
        keep[[self.u.argmin(), self.u.argmax(), self.scale.argmin(), self.scale.argmax()]] = True
        return np.flatnonzero(keep)

    def regret(self, k: int, draws: int, scaled: bool, clip: bool) -> float:
        x = self.drawn(draws)
        first = x[self.shipped(k)]
        best = -np.sort(np.partition(-x, k - 1, axis=0)[:k] if len(x) > k else -x, axis=0)
        if scaled:
            lo, hi = (max(e, 0.0) if clip else e for e in (self.scale.min(), self.scale.max()))
            span, width = max(hi - lo, 1e-9), max(self.u.max() - self.u.min(), 1e-9)
            first, best = (lo + (v - self.u.min()) / width * span for v in (first, best))
        else:
            first, best = np.maximum(first, 0.0), np.maximum(best, 0.0)
        discount = 1.0 / np.log2(np.arange(len(first)) + 2.0)
        ships, ideal = (discount @ (np.exp2(v) - 1.0) for v in (first, best))
        loss = np.divide(ideal - ships, ideal, out=np.zeros(draws), where=ideal > 0)
        return float(np.maximum(loss, 0.0).mean())


def expected_regret(
    scored: DataFrame,
    k: int = 10,
    samples: int = 256,
    seed: int = 0,
    scale: str | None = "utility",
    carry: list[str] | None = None,
    clip: bool = True,
) -> DataFrame:
    """Expected nDCG@k lost by shipping the current order, one row per query (and ``carry``).

    ``scale`` names a column whose range the draws are mapped onto, cut off below at 0 where
    ``clip`` says so; None clips the draws at 0 instead. Ties of utility ship the smaller item_id
    first; candidates without a utility, sigma or scale take no part.
    """
    keys = ["qid", *(carry or [])]
    most = k * (samples + 1) + 4  # what may be left of any number of rows
    block = max(BLOCK, 2 * most)
    first, second = words(seed, "qid", "item_id")
    rows = scored.select(
        *keys, "item_id", *[F.col(c).cast("double").alias(c) for c in ("utility", "sigma")],
        F.col(scale or "utility").cast("double").alias("_scale"), first.alias("_w0"), second.alias("_w1"),
    ).dropna(subset=["utility", "sigma", "_scale"])

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows > most:
                codes = [batch[c].dictionary_encode().indices.fill_null(-1).to_numpy() for c in keys]
                order = np.lexsort(codes)
                ends = np.flatnonzero(np.r_[np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0), True]) + 1
                pools = [order[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]
                if max(map(len, pools)) > most:
                    kept = [p[_Pool(batch.take(pa.array(p))).needed(k, samples)] if len(p) > most else p for p in pools]
                    batch = batch.take(pa.array(np.sort(np.concatenate(kept))))
            yield batch

    def judged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = _Pool(batch.slice(at, block))
                pool = part if pool is None else pool.plus(part)
                if len(pool) > block:
                    pool = pool.take(pool.needed(k, samples))
        if pool is not None:
            value = pool.regret(k, samples, scale is not None, clip)
            yield pa.RecordBatch.from_arrays([*(pa.array([x.as_py()], x.type) for x in key), pa.array([value])], [*keys, "regret"])

    out = StructType([*(f for f in rows.schema.fields if f.name in keys), StructField("regret", DoubleType())])
    return rows.mapInArrow(thinned, rows.schema).groupBy(*keys).applyInArrow(judged, out)

