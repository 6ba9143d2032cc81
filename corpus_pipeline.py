"""A training-data pipeline over `documents`: language, exact and near copies, mixing, tokens.

Each stage takes what the one before kept, as read back from Parquet. All but the last
return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlane.llm import bpe, exact_dedup, langid, mixing, near_copies
from epochlane.llm.queries import vocabulary_path
from epochlane.session import shared_dir
from epochlane.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go: no letters, or far from every centroid."""
    return langid.accepted(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more in five-word shingles, the document of the smallest doc_id stays."""
    kept = near_copies.components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at its place in the mixture of sources: the files hold them in that order."""
    return mixing.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text and of its decoded ids, and its slot and position in the mixture.

    Files don't keep an order once they are read in parallel, so the places are worked out again:
    they follow from doc_id and source of the rows alone."""
    return mixing.with_places(docs, bpe.encode_decode(docs, vocabulary_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash", near),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: Fingerprints, centroids and BPE have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
