"""Hierarchical multi-length packing of token ids.

A document is its ids and one end id. It is cut into whole windows of the longest tier, and the
rest is routed to the shortest tier that holds it. Tiers are packed from the longest down: the
longest waiting piece opens a window of its tier, and the gap is filled with the longest pieces
of shorter tiers that fit; when none fits, the shortest waiting piece is cut so that the window
is full. Every tier is a power of two and every window is full, so no padding is written at all.
What remains at the end of a task (less than one window) goes to windows of 2^k ids after its
binary digits. Windows of one length are dealt to step groups of ``STEP_TOKENS`` ids each, so
groups of different lengths cost the same.

Pieces are packed inside the task that reads their documents: nothing is shuffled. A task holds
at most ``POOL_TOKENS`` waiting ids and one document. Sequence ids are (task partition, counter),
which a repeated task makes again as it reads the same rows.

Ids equal those of the ``tokenizers`` file ``byte_bpe_50k.json`` without special tokens; they are
made with ``tiktoken`` from the same vocabulary, about five times as fast (tests compare the two
on whole tables). A marker that the file lists, such as ``<|endoftext|>``, is its one id wherever
it stands in a text.

Defined cases: a NULL or empty text is the end id alone; repeated rows and NULL ids are packed
like any other row; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

TIERS = (2048, 1024, 512, 256)
END_ID = 1
POOL_TOKENS = 1 << 20
STEP_TOKENS = 16 * TIERS[0]
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
          " window int, step_group long")
Piece = tuple  # (ids, doc_id, start, doc_tokens)


class Packer:
    """Waiting pieces of one task, sorted by length, and the rows of the windows made so far."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens, self.base = tuple(sorted(tiers)), step_tokens, partition << 40
        self.pool: list[tuple[int, int, Piece]] = []
        self.waiting = self.serial = self.sequences = 0
        self.windows: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, total = self.tiers[-1], len(ids)
        whole = total // top * top
        for start in range(0, whole, top):
            self._emit(top, [(ids[start:start + top], doc_id, start, total)])
        if whole < total:
            self._put((ids[whole:], doc_id, whole, total))

    def _put(self, piece: Piece) -> None:
        self.serial += 1
        self.waiting += len(piece[0])
        insort(self.pool, (len(piece[0]), self.serial, piece))

    def _take(self, at: int) -> Piece:
        length, _, piece = self.pool.pop(at)
        self.waiting -= length
        return piece

    def _cut(self, piece: Piece, length: int) -> Piece:
        ids, doc_id, start, total = piece
        if length < len(ids):
            self._put((ids[length:], doc_id, start + length, total))
        return ids[:length], doc_id, start, total

    def pack(self) -> None:
        """Empty the pool into full windows; pieces of a window that can't be filled stay."""
        while self.pool:
            window = [self._take(-1)]
            size = next(t for t in self.tiers if t >= len(window[0][0]))
            gap = size - len(window[0][0])
            while gap and self.pool:
                fits = bisect_right(self.pool, (gap, self.serial + 1)) - 1
                window.append(self._take(fits) if fits >= 0 else self._cut(self._take(0), gap))
                gap -= len(window[-1][0])
            if gap:
                for piece in window:
                    self._put(piece)
                return
            self._emit(size, window)

    def finish(self) -> None:
        self.pack()
        while self.pool:  # less than one window is left: one window for each binary digit
            size = gap = 1 << (self.waiting.bit_length() - 1)
            window = []
            while gap:
                window.append(self._cut(self._take(-1), gap))
                gap -= len(window[-1][0])
            self._emit(size, window)

    def _emit(self, size: int, window: list[Piece]) -> None:
        nth = self.windows.get(size, 0)
        self.windows[size] = nth + 1
        group = self.base + (size.bit_length() << 34) + nth // max(1, self.step_tokens // size)
        offset = 0
        for ids, doc_id, start, total in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.sequences, offset, size, group))
            offset += len(ids)
        self.sequences += 1


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str = tokens.RANKS, marked: str = tokens.MARKED) -> DataFrame:
    """One row per piece of the documents' ids, with its place in a window."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("context sizes must be powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = tokens.marked_encoder(vocabulary, marked), Packer(TaskContext.get().partitionId(), tiers)
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows() -> pa.RecordBatch:
            cols = zip(*packer.rows) if packer.rows else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            packer.rows = []
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = bpe.encode_to_numpy(text.as_py() or "", allowed_special="all")
                packer.add(doc_id, np.append(ids, END_ID).astype("<u4"))
                if packer.waiting >= POOL_TOKENS:
                    packer.pack()
                if len(packer.rows) >= 1 << 14:
                    yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
