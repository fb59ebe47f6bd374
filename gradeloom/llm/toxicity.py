"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - t_k) for k = 0, 1, 2 with one weight vector for all thresholds
and t_0 < t_1 < t_2; the expected severity is the sum of the three. Labels only say toxic or not,
so grades are made from them: 0 for documents labelled clean; toxic ones get 1 to 3 by the terciles
of the share of their words that are features.

Features are whole words and word beginnings of 3 to 8 characters (words split at white space,
lower case, punctuation at their ends removed) that labelled toxic documents hold significantly
more often; a value is the logarithm of the rate per thousand words. Two more say whether any
feature is there, and at what rate all of them are. The model is fitted on a bounded sample: the ``FIT_ROWS`` labelled
documents with the smallest hash of their id, one for each group of near copies (same smallest
shingle hash), so that a copied document does not vouch for its own words. Counts for the
choice of features are made by Spark over that sample; the driver holds at most ``MAX_FEATURES``
features and the sample's few values for these. Every document is scored in place: no text is
shuffled in training or scoring.

Defined cases: a NULL or blank text has severity 0 and is not toxic; labels that are NULL, or of
documents not in the table, teach nothing; a document labelled several times is toxic if any label
says so; with no toxic or no clean label nothing is learned and severity is 0; repeated rows are
scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .common import keep_rows, per_batch

FIT_ROWS = 10_000
MAX_FEATURES = 256
#: Share of a feature's documents that must be toxic.
MIN_PRECISION = 0.8
#: Any feature at all; all features together. Words never start with a space.
PRESENT, TOGETHER = " present", " together"
BEGINNINGS = range(3, 9)
MIN_TOXIC_DOCS = 3
GRADES = 3
L2 = 0.05
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…„“”‚‘’«»¿¡–—"
TOXIC_AT = 0.5


def word_counts(text: str | None) -> tuple[dict[str, int], int]:
    """(count by word, number of words)."""
    raw = Counter((text or "").lower().split())
    counts: dict[str, int] = {}
    for token, n in raw.items():
        word = token.strip(PUNCTUATION)
        if word:
            counts[word] = counts.get(word, 0) + n
    return counts, raw.total()


def _sketch(text: str) -> int:
    """The smallest hash of the text's five-word shingles: near copies mostly share it."""
    words = text.lower().split()
    return min(zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4)))


def _fit_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(toxic, n_words, words, counts): the bounded sample, one row per group of near copies."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")  # at most FIT_ROWS rows

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": [], "toxic": [], "sketch": [], "n_words": [], "words": [], "counts": []}
        for doc_id, toxic, text in zip(batch["doc_id"].to_pylist(), batch["toxic"].to_pylist(), batch["text"].to_pylist()):
            counts, n = word_counts(text)
            for k, v in zip(out, (doc_id, int(toxic > 0), _sketch(text), n, list(counts), list(counts.values()))):
                out[k].append(v)
        return out

    made = cut_lineage(per_batch(texts, run, "doc_id long, toxic int, sketch long, n_words long, words array<string>, counts array<int>"))
    heads = made.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return made.join(heads, ["sketch", "toxic", "doc_id"], "left_semi")


def features_of(word: str) -> list[str]:
    """The whole word (marked by a final space) and its beginnings."""
    return [word + " ", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def _choose_features(sample: DataFrame) -> list[str]:
    """Features of toxic documents, by the likelihood ratio of their two-by-two table.

    The bar grows with the number of features looked at, so that chance lets about none through.
    """
    totals = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, n = totals["t"] or 0, totals["n"]
    if not t or t == n:
        return []

    def run(batch: pa.RecordBatch) -> dict:
        docs, toxic = Counter(), Counter()
        for words, is_toxic in zip(batch["words"], batch["toxic"].to_pylist()):
            found = {f for w in words.as_py() for f in features_of(w)}
            docs.update(found)
            if is_toxic:
                toxic.update(found)
        return {"feature": list(docs), "a": [toxic[f] for f in docs], "m": list(docs.values())}

    counts = per_batch(sample.select("toxic", "words"), run, "feature string, a long, m long").groupBy("feature").agg(
        F.sum("a").cast("double").alias("a"), F.sum("m").cast("double").alias("m")).filter(F.col("a") >= MIN_TOXIC_DOCS)
    counts = cut_lineage(counts)

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, m = F.col("a"), F.col("m")
    ratio = 2 * (term(a, m * (t / n)) + term(m - a, m * (1 - t / n)) + term(t - a, (n - m) * (t / n)) + term(n - t - m + a, (n - m) * (1 - t / n)))
    bar = 4 + 2 * math.log(max(1, counts.count()))
    picked = counts.filter((a * n > m * t) & (a >= MIN_PRECISION * m)).withColumn("g", ratio).filter(F.col("g") >= bar)
    return sorted(r.feature for r in picked.orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect())


def rate(count: float, n_words: int) -> float:
    return math.log1p(1000.0 * count / n_words)


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, features: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = dict(zip(features, weights.tolist())), thresholds

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        counts, n = word_counts(text)
        if not n or not self.weights:
            return np.zeros(GRADES)
        found = feature_values(counts.items(), n, self.weights)
        z = sum(self.weights[f] * found[f] for f in sorted(found))
        return 1.0 / (1.0 + np.exp(self.thresholds - z))


def feature_values(counts, n_words: int, features) -> dict[str, float]:
    """Value by feature, for the features that the words hold."""
    hits: dict[str, int] = {}
    marked = 0
    for word, n in counts:
        own = [f for f in features_of(word) if f in features]
        for f in own:
            hits[f] = hits.get(f, 0) + n
        marked += n if own else 0
    found = {f: rate(n, n_words) for f, n in hits.items()}
    return found | {PRESENT: 1.0, TOGETHER: rate(marked, n_words)} if found else {}


def fit_ordinal(x: np.ndarray, grade: np.ndarray, l2: float = L2, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent on the penalised cumulative-link likelihood.

    Thresholds are t_0 and positive gaps on a log scale, so they stay ordered.
    """
    n, d = x.shape
    levels = np.arange(GRADES)
    share = np.array([(grade > k).mean() for k in levels])
    start = np.log((1 - share + 1e-3) / (share + 1e-3))
    p = np.r_[np.zeros(d), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        gaps = np.exp(p[d + 1:])
        t = p[d] + np.r_[0.0, np.cumsum(gaps)]
        z = x @ p[:d]
        s = 1 / (1 + np.exp(np.clip(t - z[:, None], -40, 40)))  # P(grade > k)
        upper = np.c_[np.ones(n), s]
        prob = np.maximum(upper[np.arange(n), grade] - np.c_[s, np.zeros(n)][np.arange(n), grade], 1e-12)
        slope = s * (1 - s)
        # a row of grade g depends on the thresholds g - 1 (from above) and g (from below)
        d_logit = (np.c_[np.zeros(n), slope][np.arange(n), grade] - np.c_[slope, np.zeros(n)][np.arange(n), grade]) / prob
        g_t = np.array([-(slope[:, k] / prob)[grade == k + 1].sum() + (slope[:, k] / prob)[grade == k].sum() for k in levels])
        g = np.r_[x.T @ d_logit - l2 * p[:d], g_t.sum(), np.array([g_t[k + 1:].sum() for k in range(GRADES - 1)]) * gaps] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * min(1.0, 2.0 * (1 - step / (rounds + 1)))
    return p[:d], p[d] + np.r_[0.0, np.cumsum(np.exp(p[d + 1:]))]


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on the bounded sample of labelled documents."""
    sample = cut_lineage(_fit_sample(docs, labels, rows))
    features = _choose_features(sample)
    if not features:
        return OrdinalModel([], np.zeros(0), np.zeros(GRADES))
    features += [PRESENT, TOGETHER]
    at = {f: k for k, f in enumerate(features)}

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "at": [], "value": []}
        for n, words, counts in zip(*(batch[c].to_pylist() for c in ("n_words", "words", "counts"))):
            found = feature_values(zip(words, counts), max(1, n), at)
            out["at"].append([at[f] for f in found])
            out["value"].append(list(found.values()))
        return out

    # at most FIT_ROWS rows, with values for the chosen features only
    held = per_batch(sample, run, "doc_id long, toxic int, at array<int>, value array<double>").collect()
    held.sort(key=lambda r: r.doc_id)
    x = np.zeros((len(held), len(features)))
    for i, r in enumerate(held):
        x[i, r["at"]] = r["value"]
    toxic = np.array([r.toxic for r in held], bool)
    share = x[:, -1]
    cuts = np.quantile(share[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (share[:, None] > cuts).sum(1), 0)
    return OrdinalModel(features, *fit_ordinal(x, grade))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` (any columns and text) with severity, grade and toxic in place of the text."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def run(batch: pa.RecordBatch) -> dict:
        above = np.array([model.above(t.as_py()) for t in batch["text"]])
        return {f.name: batch[f.name] for f in others} | {
            "severity": above.sum(1), "grade": (above >= TOXIC_AT).sum(1), "p_toxic": above[:, 0], "toxic": above[:, 0] >= TOXIC_AT}

    return per_batch(docs, run, f"{schema}, severity double, grade int, p_toxic double, toxic boolean")


def clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic."""
    return keep_rows(docs, lambda batch: [bool(model.above(t.as_py())[0] < TOXIC_AT) for t in batch["text"]])


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected severity (0 to 3) and its parts for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return score(texts, learn(texts, labels))
