"""Personal data: fixed patterns, and more spans picked by boosted trees.

The base spans (e-mail, IPv4, payment card, international phone) are those of fixed patterns,
leftmost and non-overlapping for each kind. Generators of high recall then propose overlapping
spans: every stretch of digits and separators, and every run of its blank-separated parts, as a
phone, card or address; obfuscated and defanged e-mails. Features describe a candidate's format
(digits, groups, check digit, separators, length) and context (neighbouring characters, cue words
on its left). Gradient-boosted trees score them, and a candidate is a span if its score reaches its
kind's threshold and it touches neither a base span nor a better candidate.

The trees are trained here, on the candidates of all documents: base spans and rewritten copies of
them in other spellings at the same place are positives, other candidates and rewritten copies with
broken digits are negatives. Candidates of equal features are one row whose weight is their
number, so what is fitted grows with the kinds of candidates and not with the texts. Thresholds are
calibrated on the quarter of the candidates that training does not see (by a hash of their
surroundings): the smallest score from which on at least ``MIN_PRECISION`` are right. A kind without
``MIN_CALIBRATION`` held-out positives adds nothing. Spark's own GBTClassifier does the fit; its
trees are then applied to whole batches inside the tasks that read the texts, so no text is
shuffled, and each text is searched whole.

Defined cases: a NULL text is empty; repeated rows and NULL ids are treated like any other row;
other columns are ignored; with nothing to learn from only base spans are found; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.ranks import running
from .common import per_batch

KINDS = ("email", "ip", "card", "phone")
MIN_PRECISION = 0.99
MIN_CALIBRATION = 10
TREES, DEPTH = 12, 4
#: Longest run of blank-separated parts that one candidate may take.
MAX_PARTS = 5
CONTEXT = 32

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits, and a run is taken whole: no second look at a digit
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBERS = re.compile(r"(?<![\w.+@])[+(]?[0-9][0-9 ()./\[\]-]{5,}[0-9](?![\w@])")
PARTS = re.compile(r"[^ ]+")
HIDDEN_EMAIL = re.compile(
    r"(?<![\w.])[\w.+-]{1,64} ?(?:\(at\)|\[at\]|@|(?<= )at(?= )) ?[\w-]{1,64}(?: ?(?:\(dot\)|\[dot\]|\[\.\]|(?<= )dot(?= )|\.) ?[\w-]{1,64}){1,6}(?![\w])", re.I)
HIDDEN_MARK = re.compile(r"\(at\)|\[at\]|\(dot\)|\[dot\]|\[\.\]| dot ", re.I)
CUES = {
    "email": ("mail", "contact", "write", "@"), "phone": ("phone", "call", "tel", "fax", "mobile", "contact"),
    "card": ("card", "visa", "pay", "credit", "account"), "ip": ("ip", "host", "server", "address", "from"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def candidates(text: str):
    """(start, kind number, end) of everything that might be personal data."""
    for m in NUMBERS.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in PARTS.finditer(m[0])]
        for i in range(len(parts)):
            for j in range(i, min(len(parts), i + MAX_PARTS)):
                start, end = parts[i][0], parts[j][1]
                piece = text[start:end]
                n = len(_digits(piece))
                if 7 <= n <= 15:
                    yield start, 3, end
                if 12 <= n <= 19:
                    yield start, 2, end
                if 4 <= n <= 12:
                    groups = re.split(r"[^0-9]+", piece)
                    if len(groups) == 4 and all(g and int(g) <= 255 for g in groups):
                        yield start, 1, end
    if HIDDEN_MARK.search(text):
        for m in HIDDEN_EMAIL.finditer(text):
            yield m.start(), 0, m.end()


FEATURES = ["kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "luhn", "groups", "longest_group", "shortest_group",
            "plus", "parens", "spaces", "dots", "dashes", "slashes", "brackets", "letters", "hidden_at", "hidden_dot",
            "before_word", "after_word", "before_blank", "after_blank", "cue"]


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    piece = text[start:end]
    low = piece.lower()
    digits = _digits(piece)
    groups = [len(g) for g in re.split(r"[^0-9]+", piece) if g] or [0]
    left = text[max(0, start - CONTEXT):start].lower()
    before, after = text[start - 1:start], text[end:end + 1]
    return [
        *(float(kind == k) for k in range(4)), len(piece), len(digits), luhn(digits) if digits else 0.0, len(groups), max(groups), min(groups),
        piece.count("+"), piece.count("("), piece.count(" "), piece.count("."), piece.count("-"), piece.count("/"), piece.count("["),
        sum(c.isalpha() for c in piece), sum(low.count(x) for x in ("(at)", "[at]", " at ")), sum(low.count(x) for x in ("(dot)", "[dot]", "[.]", " dot ")),
        before.isalnum(), after.isalnum(), not before or before.isspace(), not after or after.isspace(), any(c in left for c in CUES[KINDS[kind]]),
    ]


def _rewritten(text: str, start: int, kind: int, end: int):
    """(text, start, end, label) with the span spelled otherwise, rightly (1) and with broken digits (0)."""
    piece = text[start:end]
    digits = _digits(piece)
    forms: list[tuple[str, int]] = []
    if kind == 0:
        for at, dot in ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("@", "[.]")):
            forms.append((piece.replace("@", at).replace(".", dot), 1))
        forms.append((piece.replace("@", " at ").replace(".", " "), 0))
    elif kind == 1:
        forms += [(piece.replace(".", sep), 1) for sep in ("[.]", "(.)")] + [(piece.replace(".", sep), 0) for sep in ("-", " ", "/")]
    elif kind == 2:
        broken = digits[:-1] + str((int(digits[-1]) + 1 + int(digits[0]) % 8) % 10)
        for sep in (".", "/"):
            for value, label in ((digits, 1), (broken, 0)):
                forms.append((sep.join(value[i:i + 4] for i in range(0, len(value), 4)), label))
        forms.append((broken, 0))
    elif len(digits) >= 11:
        own = digits[-10:]
        forms += [(f"({own[:3]}) {own[3:6]}-{own[6:]}", 1), (f"00{digits[:-10]} {own[:3]} {own[3:6]} {own[6:]}", 1), (f"{own[:3]}-{own[3:6]}-{own[6:]}", 1)]
        forms += [(own, 0), (f"{own[:4]}-{own[4:6]}-{own[6:8]}", 0), (f"{own[:2]}/{own[2:6]}/{own[6:]}", 0)]
    for form, label in forms:
        yield text[max(0, start - CONTEXT):start] + form + text[end:end + 2], min(start, CONTEXT), min(start, CONTEXT) + len(form), label


def training_rows(docs: DataFrame) -> DataFrame:
    """(held_out, kind, label, x, n): how many candidates in ``docs``, real and rewritten, have these features."""
    def run(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()

        def add(text, start, kind, end, label):
            held_out = zlib.crc32(text[max(0, start - CONTEXT):end + 2].encode()) % 4 == 0
            seen[held_out, kind, label, tuple(float(v) for v in describe(text, start, kind, end))] += 1

        for text in batch["text"]:
            text = text.as_py() or ""
            base = base_spans(text)
            for s, k, e in base:
                add(text, s, k, e, 1.0)
                for other, a, b, label in _rewritten(text, s, k, e):
                    add(other, a, k, b, float(label))
            touched = _Taken(base)
            for s, k, e in candidates(text):
                if not touched.hit(s, e):
                    add(text, s, k, e, 0.0)
        held_out, kind, label, x = zip(*seen) if seen else ((), (), (), ())
        return {"held_out": held_out, "kind": kind, "label": label, "x": x, "n": list(seen.values())}

    made = per_batch(docs.select("text"), run, "held_out boolean, kind int, label double, x array<double>, n long")
    return made.groupBy("held_out", "kind", "label", "x").agg(F.sum("n").alias("n"))


class _Taken:
    """Spans that may not be touched, in blocks of text so that a look-up is short."""

    BLOCK = 256

    def __init__(self, spans):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for s, _, e in spans:
            self.add(s, e)

    def add(self, start: int, end: int) -> None:
        for b in range(start // self.BLOCK, (end - 1) // self.BLOCK + 1):
            self.blocks.setdefault(b, []).append((start, end))

    def hit(self, start: int, end: int) -> bool:
        return any(s < end and start < e for b in range(start // self.BLOCK, (end - 1) // self.BLOCK + 1) for s, e in self.blocks.get(b, ()))


@dataclass
class Trees:
    """Boosted trees as arrays: feature (-1 at a leaf), threshold, left, right, value; one threshold per kind."""

    trees: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                down = np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(f < 0, at, down)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * np.clip(margin, -300, 300)))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates above their kind's threshold, best first, that touch nothing chosen before."""
        if not self.thresholds:
            return []
        taken, good, part = _Taken(base), [], []

        def judge():
            if part:
                for p, c in zip(self.score(np.array([describe(text, *c) for c in part], float)), part):
                    if p >= self.thresholds[c[1]]:
                        good.append((-p, c))
                part.clear()

        for c in candidates(text):
            if c[1] in self.thresholds and not taken.hit(c[0], c[2]):
                part.append(c)
                if len(part) >= 1 << 14:
                    judge()
        judge()
        out = []
        for _, (s, k, e) in sorted(good):
            if not taken.hit(s, e):
                taken.add(s, e)
                out.append((s, k, e))
        return out

    def find(self, text: str | None) -> tuple[list, list]:
        """(base spans, all spans), each (start, kind number, end) in order."""
        base = base_spans(text or "")
        return base, sorted(base + self.added(text or "", base))


def _arrays(node) -> tuple:
    """A tree of the fitted model, node by node, as arrays."""
    feature, threshold, left, right, value = [], [], [], [], []

    def walk(node) -> int:
        at = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, node.prediction())):
            column.append(v)
        if node.getClass().getSimpleName() == "InternalNode":
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at] = walk(node.leftChild())
            right[at] = walk(node.rightChild())
        return at

    walk(node)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def learn(docs: DataFrame) -> Trees:
    """Boosted trees and calibrated thresholds from all of ``docs``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = cut_lineage(training_rows(docs))
    seen = {(bool(r.held_out), r.label) for r in rows.select("held_out", "label").distinct().collect()}
    if len(seen) < 4:  # both labels on both sides
        return Trees()
    train = rows.filter("NOT held_out").select("label", F.col("n").cast("double").alias("n"), array_to_vector("x").alias("features"))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=64, weightCol="n", cacheNodeIds=False, checkpointInterval=-1).fit(train)
    model = Trees([_arrays(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights))
    model.thresholds |= calibrated(rows.filter("held_out"), model)
    return model


def calibrated(rows: DataFrame, model: Trees) -> dict[int, float]:
    """The threshold of each kind that gets one, from all held-out ``rows`` (kind, label, x, n)."""
    def run(batch: pa.RecordBatch) -> dict:
        x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
        return {c: batch[c] for c in ("kind", "label", "n")} | {"score": model.score(x)}

    scored = per_batch(rows.select("kind", "label", "x", "n"), run, "kind int, label double, n long, score double")
    steps = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"))
    upto = running(steps, ["kind"], [F.desc("score")], {"of": "n", "good": "right"})
    good = upto.filter(F.col("good") >= F.greatest(F.lit(float(MIN_CALIBRATION)), MIN_PRECISION * F.col("of")))
    return {r.kind: max(r.best, 0.5) for r in good.groupBy("kind").agg(F.min("score").alias("best")).collect()}


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Trees) -> DataFrame:
    """Counts and digest of the base spans, and all spans, per row of ``docs``."""
    def run(batch: pa.RecordBatch) -> dict:
        found = [model.find(t.as_py()) for t in batch["text"]]
        return {"doc_id": batch["doc_id"]} | {
            f"n_{name}": [sum(k == kind for _, k, _ in base) for base, _ in found] for kind, name in enumerate(KINDS)
        } | {"base_sha256": [hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], "spans": [_listed(every) for _, every in found]}

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with every span of the texts replaced by its kind in brackets; n_chars, if there, follows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [None if t is None else redacted(t, model.find(t)[1]) for t in batch["text"].to_pylist()]
        return {c: batch[c] for c in batch.schema.names} | {"text": texts}

    made = per_batch(docs, run, schema)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def op1(docs: DataFrame) -> DataFrame:
    return find(docs, learn(docs))
