import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gradeloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, sid int, p long, n long"


def brute(rows):
    """rows: (text, lang, source) -> {(lang, source, part, item, value, rank)}"""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, count = defaultdict(set), defaultdict(Counter)
    for k, (text, lang, source) in enumerate(rows):
        count[lang, source]
        for raw in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            term = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
            held[lang, term].add(k)
            count[lang, source][term] += 1
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {g[0] for g in count}:
        terms = sorted(t for (g, t), docs in held.items() if g == lang and len(docs) >= 3)
        v, groups = len(terms), sorted(s for g, s in count if g == lang)

        def shares(c):
            total = sum(c[t] for t in terms) + v
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in terms}

        p = {s: shares(count[lang, s]) for s in groups}
        q = shares(sum((count[lang, s] for s in groups), Counter()))
        for s in groups:
            found = {"pair": [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in groups if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in terms if count[lang, s][t] and p[s][t] > q[t]]}
            for part, values in found.items():
                for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= 200:
                        out.add((lang, s, part, item, value, rank))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i % 3, t, lang, s, 5, 6, 7) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)
    return [tuple(r) for r in divergence.op11(docs).collect()]


def test_hard_rows_match_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["a", "B", "b", "été", "Éa", "中文", "x1y", "it's", "\u0080z", "ñ", "ß"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), rng.choice(["en", "de"]), f"s{rng.integers(0, 6)}") for _ in range(150)]
    rows += [(None, "en", "s0"), ("", None, None), ("a a a", None, "x"), ("a b", "", None), ("one alone", "xx", "s1"), ("", "xx", "s2"),
             (None, "xx", None), ("word " * 30_000, "en", "hot"), ("tie tie", "en", "t1"), ("tie tie", "en", "t1"), ("tie tie", "en", "t2")]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_few_entries_per_flush_and_salted_groups_change_nothing(spark, monkeypatch):
    rows = [(f"alpha beta w{chr(97 + i % 7)} gamma{'é' * (i % 3)}", "en", f"s{i % 5}") for i in range(60)]
    monkeypatch.setattr(divergence, "FLUSH", 3)
    monkeypatch.setattr(divergence, "MAX_BROADCAST", 0)
    assert set(run(spark, rows)) == brute(rows)


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_tree_adds_each_pair_of_counts(block, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = np.random.default_rng(1)
    p0 = rng.integers(1, 50, 7)
    rows = sorted({tuple((int(s), int(rng.integers(1, 3))) for s in sorted(rng.choice(7, rng.integers(1, 7), replace=False))) for _ in range(80)})
    lang = np.array([0] * 30 + [1] * (len(rows) - 30))
    rows = sorted(rows[:30]) + sorted(rows[30:])
    times = rng.integers(1, 4, len(rows))
    flat = [x for r in rows for x in r]
    items = {"sid": np.array([s for s, _ in flat]), "n": np.array([n for _, n in flat])}
    items["p0"] = p0[items["sid"]]
    items["p"] = items["p0"] * (items["n"] + 1)
    keys, values = divergence.tree_sums(lang, np.cumsum([0, *map(len, rows)]), items, times)
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for g, row, m in zip(lang, rows, times):
        for s, n in row:
            for o, k in row:
                if s != o:
                    p, p_, q, q_ = p0[s] * (n + 1), p0[s], p0[o] * (k + 1), p0[o]
                    want[g, s, o] += m * (f(p, q) - f(p, q_) - f(p_, q) + f(p_, q_))
    assert dict(zip(zip(*(k.tolist() for k in keys)), values.tolist())) == {tuple(map(int, k)): int(v) for k, v in want.items()}


def test_whole_table_matches_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = [tuple(r) for r in divergence.op11(spark.read.parquet(path)).collect()]
    assert sorted(got) == sorted(con.sql(divergence.oracle()).fetchall()) and got


def test_terms_keep_characters_whole():
    assert divergence.terms_of("Ab\x00é中-ÉZ 1x".encode()) == ["ab".encode(), "é中".encode(), "Éz".encode(), b"x"]
    assert divergence.terms_of(b"") == [] and pa.array([b"x"]).cast(pa.string())[0].as_py() == "x"
