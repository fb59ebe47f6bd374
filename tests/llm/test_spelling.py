import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gradeloom.llm import spelling

SCHEMA = "doc_id long, text string, lang string, n long, page long"


def edits(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    """rows: (doc_id, text) -> {(word, n, n_near, form, form_n, root)}"""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in spelling.op12(docs).collect()]


def hard_rows():
    rng = np.random.default_rng(4)
    base = ["abcdefg", "Abcdefgh", "gfedcba", "éèêëàâä", "éèêëàâä×", "straßen", "aaaaaaaa", "aaaaaaaaa", "aabbaabb"]
    words = []
    for w in base:
        for _ in range(12):
            v = list(w)
            for _ in range(int(rng.integers(0, 3))):
                at, c = int(rng.integers(0, len(v))), str(rng.choice(list("abcdefgéèßÀ÷")))
                v = [v[:at] + v[at + 1:], v[:at] + [c] + v[at:], v[:at] + [c] + v[at + 1:]][int(rng.integers(0, 3))]
            words.append("".join(v))
    rows = [(i, ", ".join(rng.choice(words, 30))) for i in range(40)]
    # a chain of forms: each ten times as frequent as the one before
    chain = ["commmmoon", "commmoon", "commoon", "commoun"]
    rows += [(next(k for k in range(900, 999) if zlib.crc32(f"{k}:{w}".encode()) % 31), " ".join([w] * (2 * 12**i))) for i, w in enumerate(chain)]
    return rows + [(None, "without identifier, without identifier"), (1, None), (2, ""), (3, "1234 %% Āā"), (7, "longword" * 3000 + " longword" * 40), (7, "tie tie")]


@pytest.mark.parametrize(("pages", "flush", "block"), [(20_000, 200_000, 20_000), (20, 50, 7), (1, 10**6, 3)])
def test_hard_rows_match_brute_force(spark, monkeypatch, pages, flush, block):
    monkeypatch.setattr(spelling, "FLUSH", flush)
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = hard_rows()
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (pages,))
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[5] not in (r[0], r[3]) for r in got)  # a chain of two forms


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("groups", spelling.GROUPS)
def test_every_split_of_letters_finds_each_pair_once(spark, groups, monkeypatch):
    rng = np.random.default_rng(groups)
    words = sorted({"".join(rng.choice(list("abéöz"), rng.integers(7, 9), p=[.5, .3, .1, .05, .05])) for _ in range(700)})
    monkeypatch.setattr(spelling, "GROUPS", (groups,))
    got = [(r.word, r.near) for r in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    want = [(a, b) for a in words for b in words if edits(a, b)]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w20" for w, _ in chain}


def test_whole_table_matches_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = {tuple(r) for r in spelling.op12(spark.read.parquet(path)).collect()}
    assert got == set(con.sql(spelling.oracle()).fetchall()) and any(r[3] for r in got)
