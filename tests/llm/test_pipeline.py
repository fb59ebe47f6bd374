import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gradeloom.llm import language, pii, toxicity
from tests_llm_helpers import brute_base, brute_heads, reference_ids

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, as run() writes and reads them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SF)
        if name != "packing":
            assert made.columns == docs.columns and made.schema.simpleString() == docs.schema.simpleString()
        out.append(made.persist())
    return [d.collect() for d in out]


def ids(rows):
    return {r.doc_id for r in rows}


def test_language_keeps_all_with_letters_in_a_known_language(stages, spark):
    profiles = language.RankOrder(language.learn_profiles(spark.read.parquet(f"{SF}/documents.parquet")))
    want = {r.doc_id for r in stages[0] if any(c.isalpha() for c in r.text or "") and profiles.predict(r.text)[1] >= language.MIN_SCORE}
    assert ids(stages[1]) == want and len(want) >= len(stages[0]) - 10


def test_toxic_documents_go_and_clean_ones_stay(stages, spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids(stages[1]) - ids(stages[2])
    known = [d for d in ids(stages[1]) if toxic.get(d) == 1]
    assert np.mean([d in gone for d in known]) > 0.6  # 34 toxic labels only
    assert np.mean([d in gone for d in ids(stages[1]) if toxic.get(d) == 0]) < 0.01


def test_one_document_of_each_class_stays(stages):
    assert ids(stages[3]) == brute_heads([(r.doc_id, r.text) for r in stages[2]])


def test_personal_data_is_replaced_and_nothing_else(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert ids(stages[4]) == set(before)
    changed = 0
    for r in stages[4]:
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        base = brute_base(before[r.doc_id].text)
        changed += r.text != before[r.doc_id].text
        if base:
            assert r.text == pii.redacted(before[r.doc_id].text, base) or "[" in r.text
    assert changed <= sum(bool(brute_base(r.text)) for r in stages[3]) + 5


def test_every_token_is_packed_once(stages):
    tokenize = reference_ids()
    pieces = {}
    for r in stages[5]:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == ids(stages[4])
    for r in stages[4]:
        ids_, at = np.array(tokenize(r.text), "<u4"), 0
        for start, length, crc in sorted(pieces[r.doc_id]):
            assert start == at and crc == zlib.crc32(ids_[at:at + length].tobytes())
            at += length
        assert at == len(ids_)


def test_hard_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 20_000, "en", "s", 1), (None, "no id here", None, "s", 2), (5, "a@b.cc tie", "fr", None, 3), (5, "a@b.cc tie", "fr", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {3, 5, None}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_shuffle_files_go_with_their_jobs(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_(\d+)_\d+_\d+\.data", files))

    docs, before = spark.read.parquet(f"{SF}/documents.parquet").limit(300), shuffles()
    corpus_pipeline.near_copy_stage(spark, docs, SF)  # has run all its jobs but the last
    until = time.time() + 20
    while len(left := shuffles() - before) > 3 and time.time() < until:
        time.sleep(0.5)
    assert len(left) <= 3
