"""Tokens, BM25 postings and evidence cut out of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, strip
from ..functions.joins import FEW, few, lookup
from ..functions.lineage import cut_lineage

# fixed values: the token pattern and the stop list
TOKEN = "[a-z0-9]+"
STOPWORDS = (
    "a an and are as at be by for from has have he in is it its of on or that the to was were "
    "will with this these those i you we they them his her our your"
).split()
K1, B = 0.9, 0.4
CHARS_PER_TOKEN = 4


def raw_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Lower-case tokens in text order without the stop list."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(STOPWORDS))


# ------------------------------------------------------------------- stemming
def stem_vocabulary(terms: DataFrame, stemmer: Callable[[str], str], term: str = "term") -> DataFrame:
    """(term, stem): the stemmer runs once per distinct term, not once per occurrence."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(stemmer)

    return terms.select(term).distinct().withColumn("stem", run(F.col(term)))


def apply_stems(counted: DataFrame, stems: DataFrame, by: list[str], n: str) -> DataFrame:
    """Re-key counted terms by their stem and add the counts up.

    The stem is found where the term lies, or in salted pieces if the vocabulary is large, so a
    frequent term's rows never meet in one task (:func:`functions.joins.lookup`).
    """
    return (
        lookup(counted, stems, "term", by[0])
        .groupBy(*by, F.col("stem"))
        .agg(F.sum(n).alias(n))
        .withColumnRenamed("stem", "term")
    )


# ---------------------------------------------------------------------- hits
#: What a byte of a lower-case text is: a blank of words() (1), part of a token (2) or neither.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\x0b\f\r")] = 1
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 2
#: Bytes of text that are looked at at once; a longer text is one piece.
PIECE = 1 << 22


def _tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(document, word, term) of every token of lower-case ``texts``, and the documents' numbers of words."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    starts, kind = at - at[0], _KIND[data]
    fresh = np.zeros(len(data) + 1, bool)  # where a document begins, runs of the one before end
    fresh[starts] = True

    def begins(inside: np.ndarray) -> np.ndarray:
        return inside & (~np.r_[False, inside[:-1]] | fresh[:-1])

    token, word = kind == 2, kind != 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int32), pa.array([], pa.string()), np.zeros(len(texts), np.int32)
    first = np.flatnonzero(begins(token))
    words_so_far = np.r_[0, np.cumsum(begins(word), dtype=np.int32)].astype(np.int32)
    document = np.searchsorted(starts[1:], first, "right")
    place = words_so_far[first + 1] - 1 - words_so_far[starts[document]]
    offsets = np.r_[np.cumsum(token, dtype=np.int32)[first] - 1, np.count_nonzero(token)].astype(np.int32)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[token])))
    return document, place, terms, np.diff(words_so_far[starts])


def term_hits(corpus: DataFrame, vocabulary: pa.Array | None = None, text: Column | str = "text") -> DataFrame:
    """(doc_id, dl, n_words, term, tf, positions) of the documents' terms, of ``vocabulary`` only if given.

    Besides these every document has one row with a NULL term. A document's tokens are counted where
    its text lies, so nothing is shuffled; see :func:`positional_hits` for the columns.
    """
    kind = corpus.schema["doc_id"].dataType.simpleString()
    known = None if vocabulary is None else corpus.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "dl", "n_words", "term", "tf", "positions"]

    def counted(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        nothing, n = texts.is_null().to_numpy(zero_copy_only=False), len(texts)
        document, place, terms, n_words = _tokens_of(texts.fill_null(""))
        real = ~pc.is_in(terms, pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)
        dl = np.bincount(document[real], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(dl, pa.int64(), mask=nothing), pa.array(n_words, pa.int32(), mask=nothing), pa.nulls(n, pa.string()),
             pa.array(np.zeros(n), pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names)
        if known is None:
            coded = terms.dictionary_encode()
            values, code = coded.dictionary, coded.indices.to_numpy()
        else:
            values, code = known.value, pc.index_in(terms, known.value).fill_null(-1).to_numpy()
        wanted = np.flatnonzero(real & (code >= 0))
        key = document[wanted].astype(np.int64) * max(len(values), 1) + code[wanted]
        order = np.argsort(key, kind="stable")  # a term's places stay in the order of the text
        key, wanted = key[order], wanted[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        ends, row = np.r_[edges, len(key)].astype(np.int32), document[wanted[edges]]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row)), pa.array(dl[row], pa.int64()), pa.array(n_words[row], pa.int32()), values.take(pa.array(code[wanted[edges]])),
             pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[wanted], pa.int32()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"], batch["_lower"].cast(pa.string())
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, "right")))
                yield from counted(ids.slice(lo, hi - lo), texts.slice(lo, hi - lo))
                lo = hi

    rows = corpus.select("doc_id", F.lower(col(text)).alias("_lower"))
    return rows.mapInArrow(run, f"doc_id {kind}, dl long, n_words int, term string, tf long, positions array<int>")


# ------------------------------------------------------------------- postings
def term_counts(df: DataFrame, key: str, text: str = "text", n: str = "tf") -> DataFrame:
    return (
        df.select(key, F.explode(tokens(text)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias(n))
    )


def document_lengths(corpus: DataFrame, text: Column | str = "text") -> DataFrame:
    """Tokens per document after the stop list; empty documents count as 0."""
    return corpus.select("doc_id", F.size(tokens(text)).cast("bigint").alias("dl"))


def corpus_totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def doc_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.lit(1.0 - b) + F.lit(b) * dl / F.greatest(avgdl, F.lit(1e-9))
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * norm)


def document_frequencies(corpus: DataFrame, text: Column | str = "text") -> DataFrame:
    """(term, df): each document names a term once, so only partial counts by term are shuffled."""
    return corpus.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def counted_terms(corpus: DataFrame, text: Column | str = "text") -> DataFrame:
    """(doc_id, dl, term, tf); the length is computed in the document's own row and carried along."""
    return term_hits(corpus, None, text).filter("term IS NOT NULL").select("doc_id", "dl", "term", "tf")


def build_postings(
    corpus: DataFrame, text: Column | str = "text", k1: float = K1, b: float = B
) -> DataFrame:
    """(term, doc_id, tf, w); the only shuffle counts (document, term).

    :func:`store_postings` keeps them by term for later queries.
    """
    avgdl = document_lengths(corpus, text).agg(F.avg("dl")).scalar()
    return counted_terms(corpus, text).select(
        "term", "doc_id", "tf", doc_weight(F.col("tf"), F.col("dl"), avgdl, k1, b).alias("w"))


def store_postings(postings: DataFrame, table: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write the postings bucketed and sorted by term and return the stored table.

    Queries that join it by term read their buckets and move nothing of the index. Without a
    ``path`` the session's warehouse keeps the files and dropping the table removes them.
    """
    spark = postings.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = postings.repartition(n, "term").write.mode("overwrite").bucketBy(n, "term").sortBy("term")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def term_statistics(frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df) with the terms' idf."""
    return frequencies.select("term", "df", idf(n_docs, F.col("df")).alias("idf"))


# ------------------------------------------------------------------- evidence
def cut(text: Column | str, budget: Column | int, trim: bool = True) -> Column:
    """The first ``4 * budget`` characters; an exact counter is :func:`cut_exact`."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    kept = F.when(b <= 0, F.lit("")).otherwise(F.substring(col(text), F.lit(1), b * CHARS_PER_TOKEN))
    return strip(kept) if trim else kept


def cut_exact(counter: Callable[[str], int], trim: bool = True):
    """Pandas UDF (text, budget) -> longest prefix that the caller's counter accepts; NULL stays NULL.

    A prefix grows from the front, doubling until it is over the budget, and only its last
    stretch is narrowed: the counter never sees more than about twice what is kept.
    """

    def longest(text: str, budget: int) -> int:
        good, size = 0, max(1, budget)
        while good < len(text):
            size = min(size, len(text))
            if counter(text[:size]) > budget:
                break
            good, size = size, 2 * size
        else:
            return good
        for step in (1 << k for k in reversed(range((size - good).bit_length()))):
            if good + step < size and counter(text[:good + step]) <= budget:
                good += step
        return good

    @F.pandas_udf("string")
    def run(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        out = []
        for text, budget in zip(texts, budgets):
            size = 0 if text is None or budget <= 0 else longest(text, int(budget))
            part = text if text is None or size == len(text) and budget > 0 else text[:size]
            out.append(part.strip() if trim and part is not None and size < len(text) else part)
        return pd.Series(out, dtype=object)

    return run


def title_signature(budget: Column | int, title: str = "title", text: str = "text") -> Column:
    return cut(F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(text)), budget)


def head_signature(budget: Column | int, title: str = "title", text: str = "text") -> Column:
    joined = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.col(text))
    return cut(F.regexp_replace(joined, r"^[. ]+|[. ]+$", ""), budget)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"\S+"), F.lit(0))


def positional_hits(corpus: DataFrame, vocabulary: DataFrame, text: Column | str = "text") -> DataFrame:
    """(doc_id, dl, n_words, term, tf, positions): where the words of a vocabulary (``term``) stand.

    One row per document and term, made in one pass over the texts; a position counts the
    document's words (runs of anything but blanks), of which a word with several tokens holds
    several terms. A document without such a word has one row with a NULL term.
    """
    known = vocabulary.select("term").distinct()
    terms = known.limit(FEW + 1).toArrow()["term"].combine_chunks()
    if len(terms) <= FEW:
        return term_hits(corpus, terms, text)
    hits = cut_lineage(term_hits(corpus, None, text))
    return hits.filter("term IS NULL").unionByName(hits.join(known, "term", "left_semi"))


def best_starts(hits: DataFrame, window: int = 40, stride: int = 10) -> DataFrame:
    """(qid, doc_id, start) of the best window, for pairs that have one with weight.

    ``hits`` is (qid, doc_id, n_words, weight, positions), one row per query term in a document.
    A pair's lists, no longer than its document, meet in one row; a word scores the best weight
    among its terms, and the windows' sums are differences of one running sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for n, found in zip(batch["n_words"].to_pylist(), batch["_hits"]):
                weight = np.zeros(n)
                for hit in found:
                    at = np.asarray(hit["positions"].values)
                    weight[at] = np.maximum(weight[at], hit["weight"].as_py())
                run = np.r_[0.0, np.cumsum(weight)]
                at = np.arange(0, n - window + 1, stride)
                mass = np.round(run[at + window] - run[at], 9)
                starts.append(int(at[mass.argmax()]) if mass.max() > 0 else None)
            yield pa.RecordBatch.from_arrays([batch["qid"], batch["doc_id"], pa.array(starts, pa.int32())], ["qid", "doc_id", "start"])

    pairs = hits.filter(F.col("n_words") > window).groupBy("qid", "doc_id", "n_words").agg(F.collect_list(F.struct("weight", "positions")).alias("_hits"))
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.mapInArrow(run, f"qid {types['qid']}, doc_id {types['doc_id']}, start int").filter("start IS NOT NULL")


#: Queries that are served by one copy of a document's text.
PER_TEXT = 128


def best_windows(
    pairs: DataFrame,
    corpus: DataFrame,
    weights: DataFrame,
    window: int = 40,
    stride: int = 10,
    out: str = "window",
    keep: tuple[str, ...] = ("title",),
    index: DataFrame | None = None,
) -> DataFrame:
    """(qid, doc_id) pairs with ``keep`` columns and the ``window`` words of most query weight.

    ``weights`` is (qid, term, weight) with a query's distinct terms. A word scores the best
    weight among its tokens, the earliest of equal windows wins, and a document that is
    short or holds no query term gives its first ``window`` words.

    Where the words stand is read from ``index`` (:func:`positional_hits`, made here if not given),
    so texts are not searched again. Each is met once by the starts of (up to ``PER_TEXT`` of) the
    queries that retrieved it, and the winning words are cut where it lies: no list of words
    is shuffled. ``pairs`` must not repeat a (qid, doc_id).
    """
    weights = cut_lineage(weights)  # as many rows as the queries have terms; read twice
    if index is None:
        index = positional_hits(corpus.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), weights)
    wanted = pairs.select("qid", "doc_id").join(weights.select("qid", "term", "weight"), "qid")
    hits = index.filter("term IS NOT NULL").select("doc_id", "n_words", "term", "positions").join(wanted, ["doc_id", "term"])
    starts = cut_lineage(pairs.join(best_starts(hits, window, stride), ["qid", "doc_id"], "left"))
    own = [c for c in pairs.columns if c != "doc_id"]
    asked = starts.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    asked = asked.groupBy("doc_id", F.pmod(F.xxhash64("qid"), F.ceil(F.col("_many") / PER_TEXT)).alias("_part")).agg(
        F.collect_list(F.struct(*own, F.coalesce("start", F.lit(0)).alias("_start"))).alias("_asked"))
    texts = corpus.select("doc_id", *keep, F.col("text").alias("_text"))
    split = texts.join(few(asked, starts.count()), "doc_id").withColumn("_w", words("_text"))
    cut_out = F.transform("_asked", lambda a: F.struct(*[a[c].alias(c) for c in own], F.array_join(F.slice("_w", a["_start"] + 1, F.lit(window)), " ").alias(out)))
    return split.select("doc_id", *keep, F.inline(cut_out)).select(*pairs.columns, *keep, out)


def window_signature(budget: Column | int, window: str = "window") -> Column:
    return cut(window, budget)


def title_then_window(
    budget: int, title: str = "title", window: str = "window", title_share: float = 0.5
) -> Column:
    """Title in its share of the budget, the best window in what is left of it.

    The blank between the two counts as one token.
    """
    lead = F.coalesce(cut(F.coalesce(F.col(title), F.lit("")), int(budget * title_share)), F.lit(""))
    spent = F.floor(F.length(lead) / CHARS_PER_TOKEN).cast("int") + 1
    body = cut(window, F.greatest(F.lit(budget) - spent, F.lit(0)))
    return F.when(lead == "", body).otherwise(strip(F.concat_ws(" ", lead, body)))


SIGNATURES = ("title", "head", "lexical", "title+lexical")


def signature(kind: str, budget: int) -> Column:
    """Choose a strategy by name; the lexical ones need the ``window`` column."""
    if kind not in SIGNATURES:
        raise ValueError(f"unknown signature {kind!r}")
    return {
        "title": title_signature,
        "head": head_signature,
        "lexical": window_signature,
        "title+lexical": title_then_window,
    }[kind](budget)


def signature_recall(query: Column | str, sig: Column | str, full: Column | str) -> Column:
    """Share of the document's query terms that survive in the signature; 1 when undefined."""
    q = F.array_distinct(tokens(query))
    in_doc = F.array_intersect(q, raw_tokens(full))  # q holds no stop word, so raw tokens do
    kept = F.array_intersect(in_doc, raw_tokens(sig))
    return F.coalesce(F.try_divide(F.size(kept).cast("double"), F.size(in_doc)), F.lit(1.0))
