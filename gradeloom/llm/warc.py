"""WARC archives, index first.

Writing: every task writes its records, each a gzip member of its own, to a file in the shared
folder, and returns an index row per record: file, offset, length, URL, digest, type. The index is
stored before anything is read. Among records with equal payloads the one with the largest page id
is a response and the others are revisits that name it; payload digests are grouped with a partial
maximum, so a payload with very many copies is one row per task there, and AQE splits its records
where they are joined to their head.

Reading: the wanted index rows are dealt out by file and stretch of file, sorted by offset, and
ranges that nearly touch are read at once (at most ``READ_BYTES``). Only index rows are shuffled.

A file's name carries the attempt that wrote it and is read only through index rows of attempts
that succeeded, so a repeated task leaves an unread file and no wrong record.

Defined cases: a NULL html is an empty payload; a NULL URL has no target header; line breaks and
blanks in a URL are percent-encoded; rows with the same page id and payload are all responses (or
all revisits); a NULL page id is never a head unless its payload has no other; other columns are
ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

MIN_REVISIT_BYTES = 0
FILE_BYTES = 1 << 28
#: A reader's stretch of a file, the largest single read, and the hole that is read over.
STRETCH_BYTES = 1 << 25
READ_BYTES = 1 << 23
HOLE_BYTES = 1 << 16
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "url": pa.string(),
         "payload_digest": pa.string(), "payload_bytes": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64()}
INDEX_SCHEMA = ("file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long,"
                " record_type string, refers_to long")
RECORD = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
          "record_type": pa.string(), "refers_to": pa.int64()}
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: Column) -> Column:
    """Bare base32 SHA-1: twenty bits (five hex digits) make four characters."""
    digest = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*fours)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) per row of ``pages``."""
    html = F.coalesce("html", F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
                          sha1_base32(html.cast("binary")).alias("payload_digest"))
    heads = hashed.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_head"))
    joined = hashed.join(heads, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_head"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_head")).alias("refers_to"))


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(row: dict) -> bytes:
    """One uncompressed record."""
    payload = row["html"].encode() if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"), ("WARC-Date", DATE)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _uri(row["url"])))
    head.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if row["record_type"] == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(payload))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], names=list(kinds))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Index rows of the records that :func:`mark_revisits` made, written to ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        sink, name, made, offset = None, "", 0, 0
        try:
            for batch in batches:
                index = {c: [] for c in INDEX}
                columns = {c: batch[c] for c in batch.schema.names}
                for i in range(batch.num_rows):
                    row = {c: v[i].as_py() for c, v in columns.items()}
                    if sink is None or offset >= FILE_BYTES:
                        if sink is not None:
                            sink.close()
                        name, offset, made = f"{task.partitionId():06d}-{made}-{task.taskAttemptId()}.warc.gz", 0, made + 1
                        sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record_bytes(row)) + packer.flush()
                    sink.write(member)
                    for c, v in zip(INDEX, (name, offset, len(member), *(row[c] for c in list(INDEX)[3:]))):
                        index[c].append(v)
                    offset += len(member)
                yield _batch(index, INDEX)
        finally:
            if sink is not None:
                sink.close()

    return records.mapInArrow(run, INDEX_SCHEMA)


def parse_record(raw: bytes) -> dict:
    """The fields of one uncompressed record; a revisit has no payload, only its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: None if fields[name][10:-1] == "None" else int(fields[name][10:-1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != length:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None,
            "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To") if "WARC-Refers-To" in fields else None}


def coalesce_ranges(rows: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) in groups that are read at once."""
    groups: list[list[tuple[int, int]]] = []
    for offset, length in rows:
        if groups:
            last = groups[-1][-1][0] + groups[-1][-1][1]
            if offset - last <= HOLE_BYTES and offset + length - groups[-1][0][0] <= READ_BYTES:
                groups[-1].append((offset, length))
                continue
        groups.append([(offset, length)])
    return groups


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows point at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                wanted.setdefault(file, []).append((offset, length))
            for file, rows in wanted.items():
                with fs.open_input_file(f"{root}/{file}") as source:
                    for group in coalesce_ranges(sorted(rows)):
                        start = group[0][0]
                        source.seek(start)
                        data = source.read(group[-1][0] + group[-1][1] - start)
                        out = {c: [] for c in RECORD}
                        for offset, length in group:
                            found = parse_record(zlib.decompress(data[offset - start:offset - start + length], 31))
                            for c in RECORD:
                                out[c].append(found[c])
                        yield _batch(out, RECORD)

    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    # index rows are small: their number says nothing of the bytes behind them, so the bytes set the tasks
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // STRETCH_BYTES))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD_SCHEMA)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """(index, folder): writes the archives of ``pages`` and their index now."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(mark_revisits(pages), f"{folder}").write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index"), folder


def op10(pages: DataFrame) -> DataFrame:
    index, folder = archive(pages)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    chars = " || ".join(f"substr('{ALPHABET}', 1 + ((v[{g}] >> {shift}) & 31)::INT, 1)" for g in range(1, 9) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, h,
        list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS BIGINT)) AS v,
        max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, {chars} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to FROM n"""
