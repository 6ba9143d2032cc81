"""The pipeline's last stage returns the places of the mixture."""

import corpus_pipeline
from epochlane.llm import mixing


def test_last_stage_returns_places(spark):
    rows = [(i, f"text number {i}", "en", f"src{i % 3}" if i % 7 else None, 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    written = corpus_pipeline.mixture(spark, docs, "").repartition(7)
    got = {r["doc_id"]: (r["slot"], r["position"]) for r in corpus_pipeline.tokens(spark, written, "").collect()}
    assert got == {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.mix(docs).collect()}
    assert sorted(p for _, p in got.values()) == list(range(400))
