"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlane.llm import alignment, bpe, exact_dedup, jaccard, langid, line_dedup, mixing, resampling, sharding, simhash, suffix_dedup, topk, url_filter
from epochlane.sources.tables import table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _public(name: str, variable: str) -> str:
    if found := os.environ.get(variable):
        return found
    import public_tokenizers

    return str(public_tokenizers.path(name))


def vocabulary_path() -> str:
    """Where the public vocabulary file is; EPOCHLANE_VOCABULARY names another place."""
    return _public(VOCABULARY, "EPOCHLANE_VOCABULARY")


def pieces_path() -> str:
    """Where the second tokenizer's public model is; EPOCHLANE_PIECES names another place."""
    return _public(PIECES, "EPOCHLANE_PIECES")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).drop("keep_points")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = line_dedup.build(docs)
    found = line_dedup.clean(docs, index, index.pairs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), pieces_path())


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_suffix_array": op7_suffix_array,
    "op8_line_dedup": op8_line_dedup,
    "op9_top_k": op9_top_k,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_resampling": op12_resampling,
    "op13_jaccard": op13_jaccard,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS y FROM documents),
        g AS (SELECT y, first(doc_id ORDER BY length(x) DESC, doc_id) AS keep_id, count(*) AS group_size FROM (SELECT *, x AS x2 FROM t) GROUP BY y)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.y) AS text_sha256
        FROM t JOIN g ON t.y = g.y""",
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT k.doc_id, count(*) AS n_lines, count(f.key) FILTER (WHERE k.doc_id <> f.last_doc) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL OR k.doc_id = f.last_doc), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
