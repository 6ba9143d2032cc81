"""Bounds that are errors, flags of repeated ids, and columns named like an operator's own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epochlane.llm import exact_dedup, langid


def test_every_language_is_learned_or_it_is_an_error(spark):
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [["".join(rnd.choices(letters, k=4)) for _ in range(12)] for _ in range(201)]
    rows = [(8 * i + j, " ".join(rnd.choices(own[i], k=40)), f"l{i:03}") for i in range(201) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(set(model.langs)) == 201
    found = langid.predict(docs, model).where(F.col("lang") == F.col("lang_pred")).count()
    assert found > 0.95 * len(rows)
    with pytest.raises(ValueError, match="201 languages"):
        langid.fit(docs, most_langs=200)


def test_of_rows_with_the_id_that_stays_only_the_longest_are_kept(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "ab"), (2, "ab"), (3, "x"), (3, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_points"], r["kept"]) for r in exact_dedup.duplicates(df).collect())
    assert got == [(1, 3, False), (1, 3, True), (2, 3, False), (3, 1, True), (3, 1, True)]


def test_mixture_of_rows_with_clashing_columns(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i, -i, "r") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id long, _position long, _row string")
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)
