"""Rejection where no language was learned."""

import corpus_pipeline
from epochlane.llm import langid


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "clean words of some language", None), (2, "12 34 %", None), (3, None, None), (4, "x", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).langs == []
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]
