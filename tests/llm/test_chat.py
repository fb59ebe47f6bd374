import hashlib

import pytest

from gradeloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"
HARD = ["", None, "\\", "\\\\l", "\\l\\h\\c", "###", "</turn>\n", "a: b", "### Assistant: x</turn>\n### user: y", "é💥\x00", "end\\", "\\#\\<:", "w " * 50_000]


def want(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


def rows():
    out = [(1, k, ["user", "assistant"][k % 2], t, "x") for k, t in enumerate(HARD)]
    out += [(2, 0, "assistant", "first", None), (2, 0, "assistant", "first", None), (2, 5, None, "gap", None), (2, None, "us:er\\#", "last", None)]
    out += [(3, k, "user", t, None) for k, t in enumerate(HARD)] + [(None, 1, "system", "s", None), (4, 0, "assistant", None, None)]
    return out


def test_read_back(spark):
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op9(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == want(rows() + [(-7, 0, "user", chat.HARD_CASE), (-7, 1, "assistant", chat.HARD_CASE)])


def test_examples_have_whole_context_and_one_reply(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    full = chat.full_texts(chat.examples(df)).collect()
    assert len(full) == sum(r[2] == "assistant" for r in rows())
    by_conv = {}
    for r in sorted(full, key=lambda r: (r.conv_id or 0, r.example)):
        before = by_conv.get(r.conv_id, "")
        assert r.text.startswith(before) and r.loss_start > len(before) and r.text[r.loss_end:] == chat.END
        assert r.text.rindex("### ") + len("### assistant: ") == r.loss_start
        by_conv[r.conv_id] = r.text


def test_empty_table(spark):
    assert [r.conv_id for r in chat.op9(spark.createDataFrame([], SCHEMA)).collect()] == [-7]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_twin(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/{sf}/conversations.parquet')")
    cur = con.execute(chat.oracle())
    names = [d[0] for d in cur.description]
    got = chat.op9(spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet"))
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
