from gradeloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string"


def kept(spark, rows, keep=simhash.keep_one):
    return sorted((tuple(r) for r in keep(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def test_unrelated_texts_without_id_stay(spark):
    rows = [(None, "red green blue", "a"), (None, "one two three four", "b"), (None, "one two three four", "b"), (4, "RED green blue", "c")]
    assert kept(spark, rows) == sorted([(None, "one two three four", "b"), (4, "RED green blue", "c")], key=str)


def test_one_id_with_unrelated_texts_keeps_both(spark):
    rows = [(1, "red green blue", "a"), (1, "one two three four", "b"), (2, "red green blue", "a"), (3, "one two three four", None)]
    assert kept(spark, rows) == sorted([(1, "red green blue", "a"), (1, "one two three four", "b")], key=str)
