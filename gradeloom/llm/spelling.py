"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under the frequent one.

Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; :func:`slip` drops a code
point of some of them, as a slip of the pen would. Words of at least ``MIN_LENGTH`` code points and
``MIN_COUNT`` occurrences are arranged in a trie by their frequency vectors: the first level is the
length, the next ones count the letters of coarse groups, the last ones count each letter. A
replacement moves one count up and one down, an insertion one up, so the search for a word's near
words walks down the trie with a budget of one surplus and one deficit and ends in leaves of words
with one vector, which are verified letter by letter.

Upper levels are the partitioning: a *page* is one length and one vector of coarse counts, and a
word is sent to its own page and to those that its budget reaches. Every pair is met once: the
shorter word looks for longer ones (one surplus), and of two equally long ones the word whose
surplus comes first in the order of groups looks. The page keeps which groups may still be spent
on, so the walk below only branches there. Pages are bounded: coarse groups are split (3, 4, 6, 9, 13,
27 of them) until the largest page has at most ``PAGE_WORDS`` words; with 27 groups it is one
class of anagrams. Any number of groups gives the same pairs. Walks go down in blocks of words.

Defined cases: NULL texts have no words; a NULL doc_id reads as an empty one; every row is read,
repeated ids too; ties of frequency go to the first word in code-point order; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

MIN_LENGTH, MIN_COUNT = 7, 2
SLIP_EVERY = 31
#: A form is at least this many times as frequent as the word.
RATIO = 10
#: A task hands on what it has counted when it holds this many words.
FLUSH = 200_000
#: Words of a page at most, if splitting letter groups can make it so.
PAGE_WORDS = 20_000
GROUPS = (3, 4, 6, 9, 13, 27)
#: Words that walk down a page's trie together.
BLOCK = 20_000
#: Letters from frequent to rare; all letters above U+007F count as one, the last.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Latin-1 byte -> level of its letter in the trie.
_LEVEL = np.array([LETTERS.index(chr(b)) if chr(b) in LETTERS else len(LETTERS) for b in range(256)])
LEVELS = len(LETTERS) + 1


def runs_of(text: str) -> list[bytes]:
    """The lower-cased runs of a text in Latin-1, where each code point is a byte."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def slip(run: bytes, before: int) -> bytes:
    """The run, or what is left of it; ``before`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % SLIP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of long enough words, combined as far as FLUSH allows."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            before = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
            for run, n in Counter(w for w in runs_of(text.as_py() or "") if len(w) >= MIN_LENGTH).items():
                word = slip(run, before)
                if len(word) >= MIN_LENGTH:
                    held[word] += n
            if len(held) > FLUSH:
                yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that take part."""
    counts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


def group_of_letter(groups: int) -> np.ndarray:
    """Trie level -> coarse group; letters are dealt to and fro, so that groups hold alike many occurrences."""
    lap, at = np.divmod(np.arange(LEVELS), groups)
    return np.where(lap % 2, groups - 1 - at, at)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Words x LEVELS: how often each letter occurs."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), size) * LEVELS + _LEVEL[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(len(words), LEVELS).astype(np.int32)


def _coarse(counts: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros((len(counts), groups), np.int64)
    np.add.at(out.T, group_of_letter(groups), counts.T)
    return out


def _pages(length: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """A page's number; vectors that share one by chance share a page, which adds nothing to its pairs."""
    h = length.astype(np.uint64)
    for column in coarse.T:
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (column.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def largest_pages(words: DataFrame) -> dict[int, int]:
    """For each number of coarse groups, the words of the largest page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                latin = _latin(batch["word"])
                counts, length = letter_counts(latin), np.fromiter(map(len, latin), np.int64, len(latin))
                for g in GROUPS:
                    page, n = np.unique(_pages(length, _coarse(counts, g)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(page), g, np.int32)), pa.array(page), pa.array(n)], ["groups", "page", "n"])

    sizes = words.select("word").mapInArrow(run, "groups int, page long, n long").groupBy("groups", "page").agg(F.sum("n").alias("n"))
    return {r.groups: r.n for r in sizes.groupBy("groups").agg(F.max("n").alias("n")).collect()}


def _sent(groups: int):
    """Rows (page, looks, surplus, deficit, word, n): a word on its own page, and on those it looks in.

    ``surplus`` and ``deficit`` name the coarse group where the budget is to be spent; -1: none is
    left, -2 (on the word's own page): both within one group, whichever it is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            latin = _latin(batch["word"])
            length = np.fromiter(map(len, latin), np.int64, len(latin))
            coarse, everyone = _coarse(letter_counts(latin), groups), np.arange(len(latin))
            sent = [(everyone, _pages(length, coarse), -2, -2)]
            for up in range(groups):
                more = coarse.copy()
                more[:, up] += 1
                sent.append((everyone, _pages(length + 1, more), up, -1))
                for down in range(up + 1, groups):
                    who = np.flatnonzero(coarse[:, down] > 0)
                    moved = more[who]
                    moved[:, down] -= 1
                    sent.append((who, _pages(length[who], moved), up, down))
            for who, page, up, down in sent:
                rows = batch.take(pa.array(who))
                full = lambda v: pa.array(np.full(len(who), v, np.int8))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(page), full(up), full(down), rows["word"], rows["n"]], ["page", "surplus", "deficit", "word", "n"])

    return run


class Trie:
    """Distinct letter vectors, sorted; a node is a run of vectors that agree so far, and ``steps`` leads to its children."""

    def __init__(self, vectors: np.ndarray):
        """``vectors``: sorted by row, distinct."""
        self.vectors = vectors
        self.wide = int(vectors.max(initial=0)) + 2
        node = np.zeros(len(vectors), np.int64)
        self.steps = []
        for level in range(vectors.shape[1]):
            keys = node * self.wide + vectors[:, level]
            steps, node = np.unique(keys, return_inverse=True)
            self.steps.append(steps)

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The child with that count, or -1."""
        steps, key = self.steps[level], node * self.wide + count
        at = np.minimum(np.searchsorted(steps, key), len(steps) - 1)
        return np.where((steps[at] == key) & (count >= 0) & (count < self.wide), at, -1)

    def walk(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, leaf) for all leaves that the words reach with their budgets spent where they may."""
        word, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        up, down = surplus.astype(np.int64), deficit.astype(np.int64)
        for level, group in enumerate(groups):
            x = counts[word, level]
            same = self.child(level, node, x)
            can_up, can_down = np.flatnonzero((up == group) | (up == -2)), np.flatnonzero((down == group) & (x > 0))
            more, less = self.child(level, node[can_up], x[can_up] + 1), self.child(level, node[can_down], x[can_down] - 1)
            # a budget of -2 for both is spent within one group: what went up there comes down there
            then_down = np.where(down[can_up] == -2, group, down[can_up])
            word = np.concatenate([word, word[can_up], word[can_down]])
            node = np.concatenate([same, more, less])
            down = np.concatenate([down, then_down, np.full(len(can_down), -1)])
            up = np.concatenate([up, np.full(len(can_up), -1), up[can_down]])
            # a group that will not come again must have been spent
            alive = node >= 0
            if group not in groups[level + 1:]:
                alive &= (up != group) & (down != group)
            alive = np.flatnonzero(alive)
            word, node, up, down = word[alive], node[alive], up[alive], down[alive]
        spent = (up < 0) & (down < 0) & ((up == -2) == (down == -2))
        return word[spent], node[spent]


def near(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether words a and b (rows of bytes, padded with zeros) are one letter apart; b is one longer where ``longer`` says so."""
    differ = a != b
    replaced = differ.sum(axis=1) == 1
    width = a.shape[1]
    # an insertion: what agrees at the front and what agrees behind, one place on, cover a whole
    front = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shifted = a[:, :-1] != b[:, 1:]
    behind = np.where(shifted.any(axis=1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(axis=1), -1)
    return np.where(longer, front > behind, replaced)


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def page_pairs(words: list[bytes], surplus: np.ndarray, deficit: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (looking word, found word) of a page, as places in ``words``."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    home = np.flatnonzero(surplus == -2)
    if len(home):
        by_group = np.argsort(group_of_letter(groups), kind="stable")  # a group's letters side by side
        level_groups = group_of_letter(groups)[by_group]
        counts = letter_counts(words)[:, by_group]
        order = home[np.lexsort(counts[home].T[::-1])]
        vectors = counts[order]
        first = np.flatnonzero(np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)])
        ends = np.r_[first[1:], len(order)]
        trie, width = Trie(vectors[first]), max(map(len, words)) + 1
        letters = _matrix(words, width)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for at in range(0, len(words), BLOCK):
            word, leaf = trie.walk(counts[at:at + BLOCK], surplus[at:at + BLOCK], deficit[at:at + BLOCK], level_groups)
            many = ends[leaf] - first[leaf]
            pairs = np.cumsum(many)
            start = 0
            while start < len(word):  # leaves of many words are verified in blocks
                stop = max(start + 1, int(np.searchsorted(pairs, (pairs[start - 1] if start else 0) + 50 * BLOCK)))
                m = many[start:stop]
                a = np.repeat(word[start:stop] + at, m)
                b = order[np.repeat(first[leaf[start:stop]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                longer = size[b] == size[a] + 1
                # two words of one vector find each other; one of them counts
                real = (longer | (size[a] == size[b])) & near(letters[a], letters[b], longer)
                one_vector = np.flatnonzero(real & (surplus[a] == -2) & (counts[a] == counts[b]).all(axis=1))
                real[one_vector] = a[one_vector] < b[one_vector]
                found.append((a[real], b[real]))
                start = stop
    return tuple(map(np.concatenate, zip(*found)))


def near_pairs(words: DataFrame, page_words: int = PAGE_WORDS) -> DataFrame:
    """(word, n, near, near_n): every two near words of ``words`` (word, n), once each way."""
    largest = largest_pages(words)
    groups = next((g for g in GROUPS if largest.get(g, 0) <= page_words), GROUPS[-1])

    def search(page: pa.Table) -> pa.Table:
        latin = _latin(page["word"])
        a, b = page_pairs(latin, page["surplus"].to_numpy(), page["deficit"].to_numpy(), groups)
        one, other = page.take(pa.array(a)), page.take(pa.array(b))
        return pa.table({"word": one["word"], "n": one["n"], "near": other["word"], "near_n": other["n"]})

    sent = words.select("word", "n").mapInArrow(_sent(groups), "page long, surplus byte, deficit byte, word string, n long")
    pairs = sent.groupBy("page").applyInArrow(search, "word string, n long, near string, near_n long")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): every step doubles how far a word looks, and n grows along the way."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = cut_lineage(reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if reach.filter("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    words = cut_lineage(vocabulary(docs))
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), -F.col("best.less")).alias("form_n"))
    judged = cut_lineage(judged)
    return judged.join(roots(judged.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12(docs: DataFrame) -> DataFrame:
    return variants(docs).select("word", "n", "n_near", "form", "form_n", "root")


def oracle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    bit = "CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END"  # one step of a crc32 register
    return f"""
WITH RECURSIVE table_of(b, c, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) AS r(b)
  UNION ALL
  SELECT b, {bit}, k + 1 FROM table_of WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM table_of WHERE k = 8
), runs AS (
  SELECT doc_id, translate(raw, '{upper}', '{upper.lower()}') AS run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents)
  GROUP BY ALL
), long_runs AS (
  SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS bytes FROM runs WHERE length(run) >= {MIN_LENGTH}
), hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM long_runs, crc_table
), slipped AS (
  SELECT CASE WHEN h % {SLIP_EVERY} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), cuts AS (
  SELECT word, length(word) AS size, i, left(word, i::INTEGER - 1) || substr(word, i::INTEGER + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts AS a JOIN cuts AS b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION
  SELECT a.word, w.word FROM cuts AS a JOIN words AS w ON a.rest = w.word
  UNION
  SELECT w.word, a.word FROM cuts AS a JOIN words AS w ON a.rest = w.word
), best AS (
  SELECT p.a AS word, count(*) AS n_near, min((-w.n, p.b)) AS best FROM pairs AS p JOIN words AS w ON w.word = p.b GROUP BY p.a
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN -b.best[1] >= {RATIO} * w.n THEN b.best[2] END AS form,
    CASE WHEN -b.best[1] >= {RATIO} * w.n THEN -b.best[1] END::BIGINT AS form_n
  FROM words AS w LEFT JOIN best AS b USING (word)
), chain(word, last, hops) AS (
  SELECT word, word, 0 FROM judged
  UNION ALL
  SELECT c.word, j.form, c.hops + 1 FROM chain AS c JOIN judged AS j ON j.word = c.last WHERE j.form IS NOT NULL
), ends AS (
  SELECT word, max_by(last, hops) AS root FROM chain GROUP BY word
)
SELECT word, n, n_near, form, form_n, root FROM judged JOIN ends USING (word)
"""
