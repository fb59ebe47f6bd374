import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeloom.llm import quality

SPACES = " \t\n\x0b\f\r"


def brute_counts(text):
    text = text or ""
    words, cur = [], ""
    for ch in text + " ":
        if ch in SPACES:
            words += [cur] * bool(cur)
            cur = ""
        else:
            cur += ch
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def brute_kept(rows):
    """rows: (lang, source, counts); plain numpy, group by group."""
    groups, out = defaultdict(list), [False] * len(rows)
    vecs = []
    for k, (lang, source, (n, chars, sym, dup, rep, lines)) in enumerate(rows):
        v = [math.log((chars + 250) / (n + 50)), math.sqrt(sym / (chars + 100)), math.sqrt(dup / (lines + 3)), math.sqrt(rep / (n + 20))]
        vecs.append([math.floor(x * 4096 + 0.5) / 4096 for x in v])
        if not (n < 10 or 100 * rep > 20 * n):
            groups[lang, source].append(k)
    floors = np.diag([0.05**2, 0.05**2, 0.15**2, 0.15**2])
    for members in groups.values():
        x = np.array([vecs[k] for k in members])
        q = np.percentile(x, [25, 50, 75], axis=0)
        centre, scatter = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors
        for _ in range(quality.STEPS):
            d = x - centre
            d2 = (d @ np.linalg.inv(scatter) * d).sum(1)
            step = np.floor(np.log1p(d2) * 256 + 0.5)
            inner = x[step <= np.percentile(step, 75)]
            centre, scatter = inner.mean(0), np.cov(inner.T, bias=True) * quality.CONSISTENCY + floors
        d = x - centre
        d2 = (d @ np.linalg.inv(scatter) * d).sum(1)
        for k, y in zip(members, d2):
            out[k] = len(members) < quality.MIN_GROUP or y <= quality.CUTOFF
    return out


HARD = [None, "", " \n ", "one", "a b c d e", "a b c d e f a b c d e", "x " * 40, "é ü | # <x>\n\n|\n|", "l1 a\nl1 a\n l1 a\n\nl2",
        "a\x0bb\x0cc\x00d " * 3, "p q r s t u p q r s t u v p q r s t", " ".join(f"w{i % 700}" for i in range(20_000)), "tie tie", "tie tie"]


def test_counts_of_hard_texts(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 7) for i, t in enumerate(HARD)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.op5(docs).collect()}
    assert got == {i: brute_counts(t)[:5] for i, t in enumerate(HARD)}
    assert quality.op5(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = docs.collect()
    counts = [brute_counts(r.text) for r in rows]
    kept = brute_kept([(r.lang, r.source, c) for r, c in zip(rows, counts)])
    got = {r.doc_id: r for r in quality.op5(docs).collect()}
    for r, c, k in zip(rows, counts, kept):
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == c[:5]
        assert g.kept == k and g.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])


def test_outliers_are_found_in_a_contaminated_group(spark):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocab, 120)) for _ in range(160)] + [" ".join(w + " ||" for w in rng.choice(vocab, 120)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.op5(docs).filter("kept").collect()}
    assert kept == set(range(160))


def test_no_python_on_the_path(spark):
    plan = quality.op5(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
