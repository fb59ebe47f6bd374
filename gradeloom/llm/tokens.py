"""The public byte-level BPE vocabulary, loaded once per Python worker."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
#: The same vocabulary as a ``tokenizers`` file, which lists markers that are one id inside texts, too.
MARKED = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def rank_table(name: str = RANKS) -> dict[bytes, int]:
    """Token bytes -> id, as the vocabulary file lists them (50,256 entries)."""
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(name: str = RANKS) -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(name), special_tokens={})


@lru_cache(maxsize=2)
def marked_encoder(name: str = RANKS, marked: str = MARKED) -> tiktoken.Encoding:
    """The encoder with the markers of a ``tokenizers`` file; they are cut out of a text before it is split."""
    with open(public_tokenizers.path(marked), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("markers that take in blanks or whole words only are not supported")
    return tiktoken.Encoding(marked, pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(name), special_tokens={t["content"]: t["id"] for t in added})


@lru_cache(maxsize=2)
def token_bytes(name: str = RANKS) -> list[bytes]:
    """The token-byte table: id -> bytes."""
    ranks = rank_table(name)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table
