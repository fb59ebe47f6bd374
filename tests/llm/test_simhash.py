import numpy as np
import pytest
import xxhash

from gradeloom.llm import simhash


def brute_fp(text):
    words, cur = [], b""
    for ch in (text or "").encode():
        if ch in b" \t\n\x0b\x0c\r":
            words, cur = words + [cur] * bool(cur), b""
        else:
            cur += bytes([ch + 32 if 65 <= ch <= 90 else ch])
    words += [cur] * bool(cur)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); the smallest id reachable over links of at most two bits."""
    fps = [f for _, f in rows]
    seen, out = set(), [None] * len(rows)
    for i in range(len(rows)):
        if i in seen:
            continue
        seen.add(i)
        group, todo = [], [i]
        while todo:
            j = todo.pop()
            group.append(j)
            new = [k for k in range(len(rows)) if k not in seen and bin(fps[j] ^ fps[k]).count("1") <= 2]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = min(ids, default=None)
    return out


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One TWO", "a b c", "É a É b c d e", "x " * 40, "a\x0bb\x0cc d e f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fp(text)


def mutated(rng, n, clusters):
    centres = rng.integers(0, 2**64, clusters, dtype=np.uint64)
    out = []
    for _ in range(n):
        c = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            c ^= 1 << int(b)
        out.append(c)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    codes = np.unique(np.array(mutated(rng, 400, 5), np.uint64))
    bucket = rng.integers(0, 3, len(codes))
    index = simhash.GrayIndex(bucket, codes)
    i, j = index.search(np.arange(len(codes)))
    got = {frozenset(x) for x in zip(index.codes[i].tolist(), index.codes[j].tolist())}
    want = {frozenset((int(a), int(b))) for x, a in enumerate(codes) for y, b in enumerate(codes)
            if x < y and bucket[x] == bucket[y] and bin(int(a) ^ int(b)).count("1") <= 2}
    assert got == want


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 20])
def test_components_match_brute_force(spark, limit):
    rng = np.random.default_rng(9)
    codes = mutated(rng, 500, 6)
    rows = [(i, c - 2**64 if c >= 2**63 else c) for i, c in enumerate(codes)]
    distinct = spark.createDataFrame(rows, "doc_id long, fp long").groupBy("fp").agg({"doc_id": "min"})
    links = [tuple(r) for r in simhash.link_fingerprints(distinct.select("fp"), limit=limit).collect()]
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    mine = {}
    for i, f in rows:
        mine.setdefault(find(f), []).append(i)
    got = [min(mine[find(f)]) for _, f in rows]
    assert got == brute_components([(i, c) for (i, _), c in zip(rows, codes)])


def test_edges_of_the_table(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c d", "x"), (3, "A b  C\td", "y"), (7, None, None), (6, "  ", "z"), (None, "a b c d", "n"), (9, long, "l"), (8, long, "l"), (8, long, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = {r.doc_id: r for r in simhash.op2(docs).collect()}
    assert simhash.op2(docs).count() == 8
    assert out[5].component_id == out[3].component_id == out[None].component_id == 3
    assert out[7].fingerprint == out[6].fingerprint == "0" * 16 and out[7].component_id == 6
    assert out[9].component_id == 8
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [3, 6, 8] and simhash.keep_one(docs).columns == docs.columns
    assert simhash.op2(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fp(t) for _, t in rows]
    want = dict(zip([i for i, _ in rows], zip(fps, brute_components([(i, f) for (i, _), f in zip(rows, fps)]))))
    for r in simhash.op2(docs).collect():
        assert (int(r.fingerprint, 16), r.component_id) == want[r.doc_id]
