import hashlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
import public_tokenizers

from gradeloom.llm import bpe, tokens

HARD = [None, "", " ", "\n\n \t x", "a\x1cb \x1d\x1e\x1f c\x85d᠎ e​ f　 g﻿", "it's we'LL ''s !'s", "<|endoftext|>",
        "a" * 50_000, "wörd " * 20_000, "💥" * 300, "\x00 \x00a", "१२३ ١٢ ²½ Ⅷ", "tie", "tie"]


def want(text):
    ids = np.array(tokens.encoder().encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_pattern_splits_alike(text):
    bpe_ids = [i for w in regex.findall(public_tokenizers.PATTERN, text) for i in tokens.encoder().encode_ordinary(w)]
    assert bpe_ids == tokens.encoder().encode_ordinary(text)


def test_hard_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, block string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op8(docs).collect()}
    assert got == {i: want(t) for i, t in enumerate(HARD)}
    assert bpe.op8(docs.limit(0)).count() == 0


def test_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "other")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.op8(docs).collect())
    assert rows == [(0, 1), (1, 2), (1, 2)]


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    texts = [f"some words {i} again and again" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op8(docs).collect()} == {i: want(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op8(docs).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.collect()}
