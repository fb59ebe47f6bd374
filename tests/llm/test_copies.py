import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_heads(rows):
    """Smallest id of every class; rows: (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    heads = {}
    for i, (doc_id, _) in enumerate(rows):
        heads[find(i)] = min(heads.get(find(i), doc_id), doc_id)
    return set(heads.values())


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    return sorted(r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, None).collect())


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"x{rng.integers(1000)}"
    return " ".join(words)


def test_copy_beyond_two_bits_goes(spark):
    words = [f"w{i}" for i in range(120)]
    assert stage(spark, [(1, " ".join(words)), (2, " ".join(["other", *words[1:60], "new", *words[61:]])), (3, "something else")]) == [1, 3]


@pytest.mark.parametrize("common", [2, 10**9])
def test_chains_and_common_phrases_match_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(copies, "COMMON", common)
    monkeypatch.setattr(copies, "SAMPLE", 1)
    rng = np.random.default_rng(5)
    line = "this line is found in very many of the texts here"
    texts = []
    for k in range(12):
        words = [f"v{k}_{i}" for i in range(int(rng.integers(20, 150)))] + line.split()
        for _ in range(12):
            texts.append(edited(rng, words, int(rng.integers(0, 4))))
    at = [f"c{i}" for i in range(100)]
    for k in range(25):  # neighbours are linked, ends have nothing in common
        texts.append(" ".join(at))
        at = at[5:] + [f"d{k}_{i}" for i in range(5)]
    texts += ["", None, " ", "a b", "A  b", "a b c", line]
    rows = list(enumerate(texts))
    assert stage(spark, rows) == sorted(brute_heads(rows))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, None).collect()}
    assert got == brute_heads([(r.doc_id, r.text) for r in docs.collect()])


def test_a_long_common_part_forms_few_pairs(spark):
    """400 texts that share most of their words and are no copies: hardly a pair is looked at."""
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"u{i}_{j}" for j in range(12)])) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    texts = docs.select(copies.text_key().alias("text_key"), "doc_id", "text")
    marked = copies._marked(texts, copies._common(texts))
    found = copies.candidate_rows(copies.distinct_sets(marked))
    alone = marked.select("fp", F.col("fp").alias("component")).distinct()
    assert copies.star_pairs(found).count() + copies.open_pairs(found, alone).count() < 1000
    assert len(stage(spark, rows)) == 400


def test_a_large_star_is_split(spark, monkeypatch):
    monkeypatch.setattr(copies, "STAR", 3)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, words, 1)) for i in range(60)] + [(100 + i, f"unlike{i} " * 9) for i in range(5)]
    assert stage(spark, rows) == sorted(brute_heads(rows))


def test_columns_of_any_name_stay(spark):
    schema = "doc_id long, text string, _text string, _row string, _own int, _own_ int, text_key string, fp string, component string, `a.b` string"
    rows = [(1, "one two three four five six", "x", "y", 1, 2, "k", "f", "c", "d"), (2, "one two three four five six", "z", "y", 1, 2, "k", "f", "c", "d"),
            (None, "another text", None, None, None, None, None, None, None, None), (None, "another text", None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = copies.keep_one(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
    assert copies.keep_one(docs.limit(0)).count() == 0


def test_heads_never_hide_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 200, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 200, int(rng.integers(0, 20)))]))
        common = np.unique(rng.integers(0, 200, 40))
        heads = [(len(x), copies.head_of(x, common)) for x in (a, b)]
        if len(b) and copies._similar(a, b):
            assert copies._plausible(*heads) and copies._plausible(*heads[::-1])
    far = [np.arange(100), np.arange(70, 170)]
    assert not copies._plausible(*[(len(x), copies.head_of(x, np.empty(0, np.int64))) for x in far])


def test_op2_links_are_checked_first(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, edited(rng, words, 1)) for i in range(8)] + [(9, "one text"), (10, "another one"), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    marked = copies._marked(docs.select(copies.text_key().alias("text_key"), "doc_id", "text"), np.empty(0, np.int64))
    code = {r.fp: r.code for r in marked.collect()}
    got = {frozenset((r.center, r.member)) for r in copies.indexed_pairs(marked).collect()}

    def linked(pairs):
        root = {fp: fp for fp in code}
        for pair in pairs:
            a, b = ([root[x] for x in pair])
            root = {k: b if v == a else v for k, v in root.items()}
        return sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))

    near = [(a, b) for a in code for b in code if a < b and ((code[a] ^ code[b]) & (1 << 64) - 1).bit_count() <= 2]
    assert near and linked(got) == linked(near)


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Copies with up to three edits, which are mostly similar to the one without edits only."""
    rng, looked_at, check = np.random.default_rng(4), [], copies._verified
    monkeypatch.setattr(copies, "SAMPLE", 1)
    monkeypatch.setattr(copies, "_verified", lambda pairs, *rest: looked_at.append(pairs.count()) or check(pairs, *rest))
    words = [f"w{i}" for i in range(146)]
    rows = [(0, " ".join(words))] + [(i, " ".join(f"x{i}_{k}" if k in at else w for k, w in enumerate(words)))
                                     for i, at in ((i, set(rng.choice(146, int(rng.integers(1, 4)), replace=False).tolist())) for i in range(1, 200))]
    assert stage(spark, rows) == sorted(brute_heads(rows))
    assert sum(looked_at) < 4 * len(rows)
