import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, lang string, fp long, range int, following string"


def plain_hash(window):
    """The hash of WIDTH code points, place by place."""
    h = 0
    for c in window:
        h = (h * int(fp._PLACE) + int(fp._mixed(np.array([ord(c) + 1], np.uint64))[0])) % 2**64
    return int(fp._mixed(np.array([h], np.uint64))[0] >> np.uint64(32))


def plain_sketch(text):
    if not text:
        return 0, set()
    text = text.ljust(fp.WIDTH, "\0")
    hashes = [plain_hash(text[i:i + fp.WIDTH]) for i in range(len(text) - fp.WIDTH + 1)]
    return len(hashes), {h for h in hashes if h < 2**32 * fp.FRACTION}


def hexed(made):
    return "".join(f"{x:08x}" for x in [made[0], *sorted(made[1])])


def like(a, b):
    return len(a[1] & b[1]) / len(a[1]) if a[1] else float(a[0] == b[0] and not b[1])


def brute(rows):
    """rows: (doc_id, text), sorted by doc_id; ids differ."""
    rows = sorted((i, t or "") for i, t in rows)
    made = [plain_sketch(t) for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(t) // 2
        edited = t[:len(t) - half] + rows[after][1][:half]
        e = plain_sketch(edited)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(made[k]), hexed(e), like(made[k], e), like(made[k], made[after]))
    return out


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in rows], SCHEMA).repartition(parts)
    return [(r[0], tuple(r)[1:]) for r in fp.op13(docs).collect()]


HARD = ["", None, "a", "é中😀", "x" * 11, "x" * 12, "x" * 13, "same text twice " * 9, "same text twice " * 9, "\0", " \n ",
        " ".join(f"w{i}" for i in range(800)), " ".join(f"w{i}" for i in range(400)), "😀é" * 300]


@pytest.mark.parametrize("parts", [1, 7])
def test_hard_rows_match_brute_force(spark, parts):
    rows = [(37 * i % 101, t) for i, t in enumerate(HARD)]
    got = run(spark, rows, parts)
    assert len(got) == len(rows) and dict(got) == brute(rows)


def test_one_row_follows_itself_and_an_empty_table_is_empty(spark):
    assert run(spark, []) == []
    assert dict(run(spark, [(5, "alone " * 40)])) == brute([(5, "alone " * 40)])


def test_repeated_and_missing_ids(spark):
    rows = [(None, "no id " * 30), (3, "tie " * 50), (3, "tie " * 50), (3, "other " * 50), (9, None)]
    got = run(spark, rows)
    assert sorted(str(i) for i, _ in got) == ["3", "3", "3", "9", "None"]
    texts = {hexed(plain_sketch(t or "")) for _, t in rows}
    assert {r[2] for _, r in got} == texts
    # the ring starts without an id and ends at the greatest
    assert dict(got)[9][1] == hashlib.sha256(b"").hexdigest()


def test_slices_change_nothing(monkeypatch):
    points = fp.code_points("".join(chr(97 + i * i % 23) for i in range(3000)))
    whole = fp.packed(fp.sketch(points))
    monkeypatch.setattr(fp, "SLICE", 17)
    assert fp.packed(fp.sketch(points)) == whole


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in fp.op13(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    near = np.array([[r[4], r[5]] for r in got.values()])
    assert 0.45 < near[:, 0].mean() < 0.6 and near[:, 1].mean() < 0.05


def test_sketches_merge_and_contain(spark):
    rng = np.random.default_rng(0)
    words = [f"{rng.integers(10**9)}" for _ in range(6000)]
    whole, part = " ".join(words), " ".join(words[1000:1600])
    docs = spark.createDataFrame([(1, whole), (2, part), (3, "else " + " ".join(words[5000:5500])), (4, "")], "doc_id long, text string")
    made = fp.sketches(docs)
    one = {r.doc_id: r for r in made.collect()}
    assert one[2].n_shingles == len(part) - fp.WIDTH + 1 and one[4].hashes == []
    pair = made.filter("doc_id = 2").select(F.col("hashes").alias("a")).join(made.filter("doc_id = 1").select(F.col("hashes").alias("b")))
    assert pair.select(fp.containment("a", "b"), fp.containment("b", "a")).first()[0] == 1.0
    assert 0.07 < pair.select(fp.containment("b", "a")).first()[0] < 0.13
    union = fp.merged(made.withColumn("half", F.col("doc_id") <= 2), "half")
    assert {r.hash for r in union.filter("half").collect()} == set(one[1].hashes) | set(one[2].hashes)
    inside = {(r.doc_id, r.half): r.containment for r in fp.containment_in_groups(made, union, "half").collect()}
    assert inside[2, True] == 1.0 and inside[3, True] > 0.9 and inside.get((2, False), 0) == 0
