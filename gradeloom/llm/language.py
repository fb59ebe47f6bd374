"""Language identification by rank-order profiles.

A text is lower-cased; every run of characters that are no letters is one space. Its 1- to 3-grams
(none that spans two words) are ranked by frequency, ties by code points. A language's profile is
the same ranking over all its training documents. A document goes to the language with the
smallest out-of-place distance: over its ``PROFILE`` most frequent n-grams, the sum of the
differences in rank, or ``PROFILE`` where the profile lacks the n-gram.

Training counts are added up per task batch before they are shuffled, over all training
documents; a profile is ``PROFILE`` rows, and the driver holds the profiles only (at most
``MAX_LANGUAGES`` of them, more is an error).

Defined cases: ``und`` with score 0 for a NULL text, one without a letter, or when nothing was
learned; equal distances go to the name first in order; a NULL language or text teaches nothing; a
NULL doc_id is hashed as the empty string; repeated rows count each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, per_batch

PROFILE = 300
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Texts further from every profile than this are in none of the languages.
MIN_SCORE = 0.1
#: Code points handled at once in a long text.
STRETCH = 1 << 19
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the words, single spaces around and between them; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, SPACE)
    codes = np.r_[SPACE, codes, SPACE]
    codes = codes[np.r_[True, (codes[1:] != SPACE) | (codes[:-1] != SPACE)]]
    return codes.astype(np.int64) if len(codes) > 1 else codes[:0].astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the 1- to 3-grams; a key holds 21 bits for each code point."""
    codes = _codes(text or "")
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for lo in range(0, len(codes), STRETCH):
        part = codes[lo:lo + STRETCH + 2]
        n = min(STRETCH, len(codes) - lo)
        one = part[:n][part[:n] != SPACE]
        two = part[:-1] << 21 | part[1:]
        three = two[:-1] << 21 | part[2:]
        three = three[part[1:-1] != SPACE]
        # the last stretch has no characters beyond its end, the others have two
        new, add = np.unique(np.concatenate([one, two[:n], three[: n - np.count_nonzero(part[1:n + 1][: len(part) - 2] == SPACE)]]), return_counts=True)
        keys, counts = _merge(np.r_[keys, new], np.r_[counts, add])
    return keys, counts


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The ``n`` most frequent keys; ``keys`` come in ascending order, so ties go by key."""
    return keys[np.argsort(-counts, kind="stable")[:n]]


def learn_profiles(docs: DataFrame) -> list[tuple[str, list[int]]]:
    """(language, keys by rank) for every language that a training document with a letter has."""
    def run(batch: pa.RecordBatch) -> dict:
        found: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            found.setdefault(lang, []).append(ngrams(text.as_py()))
        langs, keys, counts = [], [], []
        for lang, parts in found.items():
            k, c = _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            langs += [lang] * len(k)
            keys.append(k)
            counts.append(c)
        return {"lang": langs, "key": np.concatenate(keys), "n": np.concatenate(counts)}

    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = per_batch(usable, run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    rows = counts.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).select("lang", "key", "rank").limit(MAX_LANGUAGES * PROFILE + 1).collect()
    if len(rows) > MAX_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        profiles.setdefault(r.lang, []).append(r.key)
    return sorted(profiles.items())


@dataclass
class RankOrder:
    """Learned profiles, ready for look-ups."""

    profiles: list[tuple[str, list[int]]]

    def __post_init__(self):
        self.tables = []
        for _, keys in self.profiles:
            order = np.argsort(keys)
            self.tables.append((np.array(keys, np.int64)[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - out-of-place distance over its largest value)."""
        mine = top(*ngrams(text))
        if not len(mine) or not self.profiles:
            return UNKNOWN, 0.0
        ranks, best = np.arange(len(mine)), None
        for (lang, _), (keys, rank) in zip(self.profiles, self.tables):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            apart = np.where(keys[at] == mine, np.abs(rank[at] - ranks), PROFILE).sum()
            if best is None or apart < best[1]:
                best = lang, apart
        return best[0], 1.0 - float(best[1]) / (PROFILE * len(mine))


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]]) -> DataFrame:
    """``docs`` (any columns and text) with ``lang_pred`` and ``score`` in place of the text."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    model = RankOrder(profiles)

    def run(batch: pa.RecordBatch) -> dict:
        made = [model.predict(t.as_py()) for t in batch["text"]]
        return {f.name: batch[f.name] for f in others} | {"lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    return per_batch(docs, run, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: list[tuple[str, list[int]]], min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages; ``und`` and scores below ``min_score`` are rejected."""
    model = RankOrder(profiles)

    def wanted(batch: pa.RecordBatch) -> list[bool]:
        made = (model.predict(t.as_py()) for t in batch["text"])
        return [lang != UNKNOWN and score >= min_score for lang, score in made]

    return keep_rows(docs, wanted)


def op4(docs: DataFrame) -> DataFrame:
    """Every document's language; documents whose crc32(doc_id) mod 4 is 2 are held out of training."""
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out")
    marked = docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out)
    profiles = learn_profiles(marked.filter(~F.col("held_out")))
    return predict(marked.select("doc_id", "held_out", "text"), profiles)
