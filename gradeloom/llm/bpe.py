"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. Every text is split by the vocabulary's pattern, once. All documents of a block (an Arrow
   batch) share one list of distinct pre-tokens; a document becomes its sequence of places in
   that list, ordered by frequency so that places are small. The sequences stay where they are
   made: one file per block in the shared folder.
2. The distinct pre-tokens of a block go to ``BUCKETS`` word buckets by hash. A bucket meets in
   one task, which encodes each distinct word once, whatever the number of blocks that hold it.
   A word occurs once per block at most, so no word is hot.
3. The ids travel back to their block, whose file is opened where they meet, and are put in place
   of the places. Decoding looks the ids up in the token-byte table (50,256 rows, fixed by the
   vocabulary).

Only distinct words and their ids are shuffled, packed, never texts or sequences. A task holds
one block. A block's name is taken from its words and every word is counted back in, so a task
that is repeated on other rows (an input whose order is not stable) ends in an error, not in
wrong ids; its file carries the attempt's name and is read only through the row that names it.

Defined cases: a NULL text is empty; no ids have the digest of nothing; repeated rows and NULL
ids are encoded like any other row; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import scratch

BUCKETS = 1024
#: A block ends with the text that takes it over this many characters.
BLOCK_CHARS = 1 << 25
SPLIT = regex.compile(public_tokenizers.PATTERN)


class _Places(dict):
    """Word -> order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers, packed: the four bytes apart, as the high ones hold little."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(len(words).to_bytes(4, "little") + np.array([*map(len, words)], "<u4").tobytes() + b"".join(words), 1)


def _unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


class Block:
    """Documents that share a list of words."""

    def __init__(self):
        self.doc_ids, self.seqs, self.places, self.chars = [], [], _Places(), 0

    def add(self, doc_id: int | None, text: str) -> None:
        words = SPLIT.findall(text)
        self.doc_ids.append(doc_id)
        self.seqs.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.chars += len(text)

    def by_frequency(self) -> list[str]:
        """The words, most frequent first; sequences are renumbered to that order."""
        words = list(self.places)
        count = np.bincount(np.concatenate(self.seqs), minlength=len(words))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        self.seqs = [rank[s] for s in self.seqs]
        return [words[i] for i in order.tolist()]

    def write(self, folder: str, name: str) -> str:
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
        with fs.open_output_stream(path) as sink, pa.ipc.new_stream(sink, SEQUENCES) as out:
            for lo in range(0, len(self.seqs), 256):
                packed = [_planes(s) for s in self.seqs[lo:lo + 256]]
                out.write_batch(pa.record_batch([pa.array(self.doc_ids[lo:lo + 256], pa.int64()), pa.array(packed, pa.binary())], schema=SEQUENCES))
        return name


def _arrow(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], names=list(kinds))


SEQUENCES = pa.schema({"doc_id": pa.int64(), "packed": pa.binary()})
WORD_ROWS = {"block": pa.int64(), "words_in_block": pa.int32(), "file": pa.string(), "bucket": pa.int32(), "places": pa.binary(), "packed": pa.binary()}
WORD_SCHEMA = "block long, words_in_block int, file string, bucket int, places binary, packed binary"


def block_words(docs: DataFrame, folder: str) -> DataFrame:
    """Per block and word bucket, the words with their places; the sequences go to the block's file."""
    def run(batches):
        task = TaskContext.get()
        made = 0

        def rows(block: Block) -> pa.RecordBatch:
            words = [w.encode() for w in block.by_frequency()]
            lists = [([], []) for _ in range(BUCKETS)]
            for place, word in enumerate(words):
                at = lists[zlib.crc32(word) % BUCKETS]
                at[0].append(place)
                at[1].append(word)
            full = [b for b in range(BUCKETS) if lists[b][1]] or [0]  # a block without words has a row too
            packed = [_pack_words(lists[b][1]) for b in full]
            name = xxhash.xxh64_intdigest(b"".join(packed), task.partitionId() << 20 | made) - (1 << 63)
            file = block.write(folder, f"{task.partitionId()}-{made}-{task.taskAttemptId()}.arrows")
            n = len(full)
            return _arrow({"block": [name] * n, "words_in_block": [len(words)] * n, "file": [file] * n, "bucket": full,
                           "places": [_planes(np.array(lists[b][0], np.uint32)) for b in full], "packed": packed}, WORD_ROWS)

        for batch in batches:
            block = Block()
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                block.add(doc_id, text.as_py() or "")
                if block.chars > BLOCK_CHARS:
                    yield rows(block)
                    made, block = made + 1, Block()
            if block.doc_ids:
                yield rows(block)
                made += 1

    return docs.mapInArrow(run, WORD_SCHEMA)


def encode_words(words: DataFrame, vocabulary: str = tokens.RANKS) -> DataFrame:
    """The same rows; ``packed`` now holds the number of words, the number of ids of each, and all ids."""
    def run(batches):
        bpe, known, bucket_now = tokens.encoder(vocabulary), {}, None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch["bucket"].to_pylist(), batch["packed"]):
                if bucket != bucket_now:  # rows come bucket by bucket: a word of an earlier one does not return
                    known, bucket_now = {}, bucket
                listed = []
                for word in _unpack_words(packed.as_py()):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = bpe.encode_ordinary(word.decode())
                    listed.append(ids)
                flat = [len(listed), *map(len, listed), *(i for ids in listed for i in ids)]
                out.append(_planes(np.array(flat, np.uint32)))
            yield _arrow({c: batch[c] for c in WORD_ROWS} | {"packed": out}, WORD_ROWS)

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, WORD_SCHEMA)


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, seq: np.ndarray) -> np.ndarray:
    n = count[seq].astype(np.int64)
    return flat[np.repeat(start[seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Dictionary:
    """Ids and bytes of a block's words by place."""

    def __init__(self, rows: list[tuple[bytes, bytes]], words: int, table: list[bytes]):
        places, counts, ids = [], [], []
        for where, packed in rows:
            numbers = _numbers(packed)
            n = int(numbers[0])
            places.append(_numbers(where))
            counts.append(numbers[1:n + 1])
            ids.append(numbers[n + 1:])
        places, counts = np.concatenate(places), np.concatenate(counts)
        if len(places) != words:
            raise RuntimeError("a block met the words of another: the input's rows changed between attempts of a task")
        self.flat, ends = np.concatenate(ids), np.cumsum(counts, dtype=np.int64)
        self.count, self.start, self.words = np.zeros(words, np.uint32), np.zeros(words, np.int64), [b""] * words
        self.count[places], self.start[places] = counts, ends - counts
        pieces = [table[i] for i in self.flat.tolist()]
        for place, lo, hi in zip(places.tolist(), (ends - counts).tolist(), ends.tolist()):
            self.words[place] = b"".join(pieces[lo:hi])

    def encode(self, seq: np.ndarray) -> bytes:
        return _gather(self.flat, self.start, self.count, seq).astype("<u4").tobytes()

    def decode(self, seq: np.ndarray) -> bytes:
        return b"".join(map(self.words.__getitem__, seq.tolist()))


def reassemble(encoded: DataFrame, folder: str, vocabulary: str = tokens.RANKS) -> DataFrame:
    """(doc_id, ids, decoded) per document, ids as little-endian unsigned 32-bit integers."""
    kinds = {"doc_id": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()}

    def documents(file: str, found: Dictionary):
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{file}")
        with fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as stored:
            for batch in stored:
                out, size = {c: [] for c in kinds}, 0
                for doc_id, packed in zip(batch["doc_id"].to_pylist(), batch["packed"]):
                    seq = _numbers(packed.as_py())
                    for c, value in zip(kinds, (doc_id, found.encode(seq), found.decode(seq))):
                        out[c].append(value)
                    size += len(out["ids"][-1])
                    if size > 1 << 24:
                        yield _arrow(out, kinds)
                        out, size = {c: [] for c in kinds}, 0
                if out["doc_id"]:
                    yield _arrow(out, kinds)

    def run(batches):
        table, now, rows = tokens.token_bytes(vocabulary), None, []
        for batch in batches:
            for block, words, file, where, packed in zip(*(batch[c].to_pylist() for c in ("block", "words_in_block", "file", "places", "packed"))):
                if now and block != now[0]:
                    yield from documents(now[2], Dictionary(rows, now[1], table))
                    rows = []
                now = block, words, file
                rows.append((where, packed))
        if now:
            yield from documents(now[2], Dictionary(rows, now[1], table))

    return encoded.repartition("block").sortWithinPartitions("block").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_documents(docs: DataFrame, vocabulary: str = tokens.RANKS) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs``."""
    folder = scratch(docs.sparkSession, "bpe")
    words = block_words(docs.select(F.col("doc_id").cast("long"), "text"), folder)
    return reassemble(encode_words(words, vocabulary), folder, vocabulary)


def op8(docs: DataFrame) -> DataFrame:
    return encode_documents(docs).select(
        "doc_id", F.expr("bigint(octet_length(ids) div 4)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
