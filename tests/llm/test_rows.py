"""Stages judge rows one by one, whatever doc_ids they share or lack."""

from ledgerline.llm import simhash, toxicity


def test_one_row_of_each_component_stays(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    data = [(1, a), (1, a), (2, b), (1, b), (None, a), (None, "x y"), (None, "x y")]
    out = simhash.keep_one_each(spark.createDataFrame(data, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a), (1, b), (None, "x y")], key=str)


def test_toxic_rows_go_one_by_one(spark):
    bad, good = "you STUPID worthless idiot", "a calm river"
    data = [(None, bad), (None, good), (5, good), (5, bad), (5, good)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = toxicity.reject_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, good), (5, good), (5, good)], key=str)
