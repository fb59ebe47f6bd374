import zlib
from collections import Counter, defaultdict

import pytest

from gradeloom.llm import language


def brute_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    counts = Counter()
    for w in words:
        counts.update(w)
    flat = " " + " ".join(words) + " " if words else ""
    for n in (2, 3):
        counts.update(g for i in range(len(flat) - n + 1) if " " not in (g := flat[i:i + n])[1:-1])
    return counts


def brute_top(counts):
    return sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[:300]


def brute(rows):
    """rows: (doc_id, text, lang) -> {doc_id: (held_out, language, score)}"""
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    learned = defaultdict(Counter)
    for d, text, lang in rows:
        if lang is not None and not held[d]:
            learned[lang] += brute_ngrams(text)
    profiles = {lang: {g: k for k, g in enumerate(brute_top(c))} for lang, c in learned.items() if c}
    out = {}
    for d, text, _ in rows:
        mine = brute_top(brute_ngrams(text))
        if not mine or not profiles:
            out[d] = held[d], "und", 0.0
            continue
        apart, lang = min((sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(mine)), lang) for lang, p in profiles.items())
        out[d] = held[d], lang, 1 - apart / (300 * len(mine))
    return out


HARD = ["", None, "123 !!", "é", "Ünï cödé", "a", "ab", "日本語 テキスト", "İstanbul ǅ", "x\x00y", " lead trail ", "word " * 30_000]


@pytest.mark.parametrize("stretch", [7, 64, language.STRETCH])
@pytest.mark.parametrize("text", HARD[:-1] + ["the quick brown fox jumps over the lazy dog, again and again. " * 3])
def test_ngrams(text, stretch, monkeypatch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    keys, counts = language.ngrams(text)
    name = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
    got = {name(int(k)): int(c) for k, c in zip(keys, counts)}
    assert got == dict(brute_ngrams(text))
    assert [name(int(k)) for k in language.top(keys, counts)] == brute_top(brute_ngrams(text))


def test_hard_texts(spark):
    rows = [(i, t, ["xx", "yy", None][i % 3]) for i, t in enumerate(HARD * 2)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language.op4(docs).collect()}
    want = brute(rows)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - want[k][2]) < 1e-12 for k in got)
    assert language.op4(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.op4(nothing).collect()] == [(None, False, "und", 0.0)]


def test_whole_table_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute(rows)
    right, total = 0, 0
    lang = {d: x for d, _, x in rows}
    for r in language.op4(docs).collect():
        held, pred, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, pred) and abs(r.score - score) < 1e-12
        if r.held_out:
            total += 1
            right += r.lang_pred == lang[r.doc_id]
    assert right / total > 0.97
