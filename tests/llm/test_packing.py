import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeloom.llm import packing, tokens

LONG = "word " * 30_000
HARD = [None, "", " ", "a", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|endoftext|", "é" * 5000, "x\x1cy \x85z  q  w", "a" * 40_000, LONG, "tie", "tie"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, reference):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = np.array(reference(text), "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_hard_texts(spark, reference):
    texts = dict(enumerate(HARD))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, start string").repartition(2)
    assert check(packing.pack_documents(docs).collect(), texts, reference) == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows) == 3 * 3 + 2 and sum(r.doc_id is None for r in rows) >= 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, reference, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert check(packing.pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, reference) == 0


def test_tiers_and_steps():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0)
    lengths = np.r_[rng.integers(1, 6000, 60), rng.integers(550, 1000, 200), rng.integers(1, 200, 2000)]
    for i, n in enumerate(lengths.tolist()):
        packer.add(i, rng.integers(0, 50_000, n).astype("<u4"))
    packer.finish()
    cut = defaultdict(int)
    filled, sizes, groups = defaultdict(int), {}, defaultdict(int)
    for doc_id, _, length, _, _, seq, _, size, group in packer.rows:
        cut[doc_id] += 1
        filled[seq] += length
        sizes[seq] = size
        groups[group] += length
    assert filled == sizes  # every window is full
    assert len(set(packing.TIERS) & set(sizes.values())) >= 3
    whole = sum(-(-n // 2048) for n in lengths)
    assert sum(cut.values()) < 1.5 * whole  # few documents are cut beyond their whole windows
    assert max(groups.values()) == packing.STEP_TOKENS


def test_vocabularies_agree():
    assert len(tokens.token_bytes()) == 50_256 and all(tokens.token_bytes())


def test_a_marker_is_one_id(reference):
    assert tokens.marked_encoder().encode("<|endoftext|> x", allowed_special="all") == [50256, 2124]
    assert reference("<|endoftext|> x") == [50256, 2124, 1]
