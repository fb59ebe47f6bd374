"""Brute-force versions that several tests share."""

import public_tokenizers
from tokenizers import Tokenizer

from test_copies import brute_heads  # noqa: F401
from test_pii import brute_base  # noqa: F401
from test_simhash import brute_components, brute_fp  # noqa: F401


def reference_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]
