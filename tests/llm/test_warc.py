import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from gradeloom.llm import warc

ROWS = [(1, "http://a/x", "<p>one</p>", 1), (2, "http://a/y z\r\nq", "<p>one</p>", 1), (9, None, "<p>one</p>", 1), (3, "u", None, 1), (4, "u", "", 1), (5, "ü", "é\r\n\r\nWARC/1.1\r\n", 1),
        (6, "long", "x" * 300_000, 1), (None, "n", "<p>one</p>", 1), (None, "alone", "alone", 1), (7, "tie", "tie", 1), (7, "tie", "tie", 1)]
SCHEMA = "page_id long, url string, html string, payload_bytes int"


def want(rows):
    heads = {}
    for p, _, h, *_ in rows:
        if p is not None:
            heads[h or ""] = max(heads.get(h or "", p), p)
    out = []
    for p, _, h, *_ in rows:
        data, head = (h or "").encode(), heads.get(h or "")
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if p == head else ("revisit", head))))
    return sorted(out, key=str)


def test_hard_rows(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.op10(pages).collect()), key=str) == want(ROWS)
    assert warc.op10(pages.limit(0)).count() == 0


def test_files_are_warc_and_ranges_are_exact(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    index, folder = warc.archive(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    rows = index.collect()
    assert len({r.file for r in rows}) > 1
    at = Path(folder.removeprefix("file://"))
    for r in rows:
        raw = gzip.decompress((at / r.file).read_bytes()[r.offset:r.offset + r.length])
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    for file in {r.file for r in rows}:
        assert gzip.decompress((at / file).read_bytes()).count(b"WARC-Record-ID: <urn:page:") == sum(r.file == file for r in rows)
    some = warc.read_records(index.filter("url = 'long' OR page_id = 5"), folder).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in some) == [(5, "é\r\n\r\nWARC/1.1\r\n"), (6, "x" * 300_000)]
    urls = {r.page_id: r.url for r in warc.read_records(index, folder).collect()}
    assert urls[2] == "http://a/y%20z%0D%0Aq" and urls[9] is None


def test_ranges_are_coalesced():
    a, far = [(0, 10), (10, 5), (20, 5)], (10 << 20, 4)
    assert warc.coalesce_ranges([*a, far]) == [a, [far]]
    assert len(warc.coalesce_ranges([(k << 22, 1 << 22) for k in range(4)])) == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_twin(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/{sf}/pages.parquet')")
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = sorted(map(tuple, warc.op10(pages).collect()), key=str)
    assert got == sorted(con.execute(warc.oracle()).fetchall(), key=str)
    assert got == want([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
