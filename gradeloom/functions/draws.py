"""Keyed random draws for vectors: a row's digest gives two words, a word and a number give a draw.

Draws follow from (seed, keys, number) alone, whatever the partitioning and however often a task is
retried. The arithmetic stays within 63 bits, so SQL can repeat it with plain integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Odd multipliers: one per word for the draw's number, two for the mix (below 2^31, see above).
DRAW = (2654435761, 2246822507)
MIX = (2146121005, 1815976681)
SHIFTS = (16, 15)


def words(seed: int, *keys: str) -> tuple[Column, Column]:
    """Two 32-bit words of the row's digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def uniforms(word: np.ndarray, draws: int, which: int = 0) -> np.ndarray:
    """Rows x draws of uniforms in (0, 1) from one word per row."""
    x = word.astype(np.uint32)[:, None] + np.arange(draws, dtype=np.uint32) * np.uint32(DRAW[which])
    for shift, factor in zip(SHIFTS, MIX):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return ((x ^ (x >> np.uint32(16))) + 0.5) / 2.0**32


def normals(both: np.ndarray, draws: int) -> np.ndarray:
    """Rows x draws of standard normals from two words per row."""
    a, b = (uniforms(both[:, i], draws, i) for i in (0, 1))
    return np.sqrt(-2.0 * np.log(a)) * np.cos(2.0 * np.pi * b)


# ------------------------------------------------------- digests of many keys
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a key that fit one block of the digest.
ONE_BLOCK = 55
#: Digests worked on at once: their words stay in a core's cache.
AT_ONCE = 1 << 14


def _first_word(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first of the four words of MD5 over one block of sixteen words (numbers where all keys agree)."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the first word is settled three steps before the last
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            at = 7 * i % 16
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        t += a
        if isinstance(words[at], np.ndarray):
            t += words[at]
            t += np.uint32(_SINES[i])
        else:
            t += np.uint32((words[at] + _SINES[i]) & 0xFFFFFFFF)
        np.left_shift(t, np.uint32(_TURNS[i]), out=u)
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=t)
        np.bitwise_or(u, t, out=u)
        u += b
        a, b, c, d, u = d, u, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


class Texts:
    """Byte strings as words, to be put together to keys."""

    def __init__(self, texts: pa.Array | list[bytes]):
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts.cast(pa.binary())
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
        self.texts, self.sizes = texts, np.diff(edges)
        fits = np.minimum(self.sizes, ONE_BLOCK)
        self._row = np.repeat(np.arange(len(texts)), fits)
        self._at = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
        self._data, self._fits = data[(edges[:-1] - edges[0])[self._row] + self._at], fits
        self._words: dict[tuple[int, bool], list[np.ndarray]] = {}

    def words(self, shift: int = 0, close: bool = False) -> list[np.ndarray]:
        """Word by word what the texts hold when they begin at byte ``shift`` of a word; ``close`` ends a key."""
        if (shift, close) not in self._words:
            n, wide = len(self.texts), int(self._fits.max(initial=0)) + shift + close
            held = np.zeros((n, -(-wide // 4) * 4), np.uint8)
            held[self._row, self._at + shift] = self._data
            if close:
                held[np.arange(n), self._fits + shift] = 0x80
            self._words[shift, close] = list(np.ascontiguousarray(held.view("<u4").T)) if held.size else []
        return self._words[shift, close]


def digest_words(heads: Texts, head: np.ndarray, tails: Texts, tail: np.ndarray) -> np.ndarray:
    """First 32 bits of MD5 over ``heads[head] + tails[tail]``; ``head`` is one per row of the matrix ``tail``.

    The heads of a call have one length. What :func:`expr.uniform` draws is (word + 0.5) / 2^32.
    """
    size = int(heads.sizes[head[0]])
    if size + int(tails.sizes[tail].max()) > ONE_BLOCK:
        h, t = heads.texts.take(pa.array(head)).to_pylist(), tails.texts.to_pylist()
        return np.array([[int.from_bytes(hashlib.md5(a + t[j]).digest()[:4], "big") for j in row] for a, row in zip(h, tail.tolist())], np.uint32).reshape(tail.shape)
    wide, flat = tail.shape[1], tail.ravel()
    whole, shift = divmod(size, 4)
    front, back, out = heads.words(), tails.words(shift, True), np.empty(flat.shape, np.uint32)
    step = max(1, AT_ONCE // wide)
    for lo in range(0, len(head), step):
        h, t = head[lo:lo + step], flat[lo * wide:(lo + step) * wide]
        words: list[np.ndarray | int] = [0] * 16
        for k in range(min(len(back), 14 - whole)):
            words[whole + k] = back[k][t]
        for k in range(-(-size // 4)):
            own = np.repeat(front[k][h], wide)
            words[k] = own | words[k] if k >= whole else own
        words[14] = ((tails.sizes[t] + size) * 8).astype(np.uint32)
        out[lo * wide:(lo + step) * wide] = _first_word(words, len(t))
    return out.reshape(tail.shape)
