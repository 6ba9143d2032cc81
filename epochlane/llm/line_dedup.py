"""Line dedup: sharded cuckoo filters over exact reference counts, with insertion and deletion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlane.llm.cuckoo import CuckooFilter
from epochlane.session import materialise

MIN_POINTS = 40
MIN_DOCS = 5
#: Keys of one shard, about, when an index is built; LEAST_SHARDS at least.
KEYS_PER_SHARD, LEAST_SHARDS = 1_000_000, 64
#: Pairs that meet a copy of their shard's filter in one task, about.
PAIRS_PER_PART = 400_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
_LOW = str.maketrans(UPPER, LOWER)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_digest(line: str) -> bytes | None:
    """key_of() and its digest for one line; None for a key that is too short."""
    key = line.strip(BLANKS).translate(_LOW)
    return hashlib.sha256(key.encode()).digest()[:16] if len(key) >= MIN_POINTS else None


def postings(docs: DataFrame) -> DataFrame:
    """(key, doc_id): each long enough line key of each document once; key is 16 bytes of its SHA-256."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), key_of)
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= MIN_POINTS))
    return docs.select("doc_id", F.explode(long).alias("k")).select(F.substring(F.unhex(F.sha2("k", 256)), 1, 16).alias("key"), "doc_id").distinct()


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


@dataclass
class LineIndex:
    """pairs (key, doc_id), refs (key, n_docs, last_doc) and filters (shard, data), all written tables.

    refs counts the documents of every key; the filter of a shard holds its keys of MIN_DOCS
    documents or more. shards: their number."""

    pairs: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 0].copy() if len(keys) else np.zeros(0, np.uint64)


def _new_filters(refs: DataFrame, shards: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "data": [CuckooFilter.build(_hashes(group["key"].tolist())).to_bytes()]})

    return refs.where(F.col("n_docs") >= MIN_DOCS).select(shard_of(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, data binary")


def _changed_filters(old: LineIndex, refs: DataFrame) -> DataFrame:
    """The old filters with keys that rose to MIN_DOCS put in and keys that fell below taken out.

    A shard whose filter got too full is built anew from refs."""
    was = old.refs.where(F.col("n_docs") >= MIN_DOCS).select("key", F.lit(True).alias("was"))
    now = refs.where(F.col("n_docs") >= MIN_DOCS).select("key", F.lit(True).alias("now"))
    moved = was.join(now, "key", "full").where("was is null or now is null").select(shard_of(F.col("key"), old.shards).alias("shard"), "key", F.col("now").isNotNull().alias("put"))

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = (left if len(left) else right)["shard"].iloc[0]
        put, out = (_hashes(right.loc[right["put"] == x, "key"].tolist()) for x in (True, False))
        made = CuckooFilter.from_bytes(left["data"].iloc[0]) if len(left) else CuckooFilter.empty(max(16, len(put)))
        for k in out.tolist():
            made.delete(k)
        good = made.insert_many(put)
        return pd.DataFrame({"shard": [shard], "data": [made.to_bytes() if good else b""]})

    made = materialise(old.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard int, data binary"))
    full = made.where(F.octet_length("data") == 0).select("shard")
    again = _new_filters(refs.withColumn("shard", shard_of(F.col("key"), old.shards)).join(full, "shard", "left_semi").drop("shard"), old.shards)
    return materialise(made.where(F.octet_length("data") > 0).union(again))


def build(docs: DataFrame) -> LineIndex:
    """The index of docs (doc_id, text; other columns are ignored)."""
    pairs = materialise(postings(docs))
    refs = materialise(_count(pairs))
    shards = max(LEAST_SHARDS, -(-refs.count() // KEYS_PER_SHARD))
    return LineIndex(pairs, refs, materialise(_new_filters(refs, shards)), shards)


def _same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    """Equality of columns in which null ids are equal too."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in cols])


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with docs added; what it has of a doc_id already stays and counts once."""
    found = postings(docs)
    new = materialise(found.join(index.pairs, _same(found, index.pairs, "key", "doc_id"), "left_anti"))
    refs = index.refs.union(_count(new)).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
    refs = materialise(refs)
    return LineIndex(materialise(index.pairs.union(new)), refs, _changed_filters(index, refs), index.shards)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index as if the documents in doc_ids (doc_id, null among them or not) had never been added.

    Only the keys that those documents hold are counted again, from the exact pairs."""
    ids = doc_ids.select("doc_id").distinct()
    gone = materialise(index.pairs.join(ids, _same(index.pairs, ids, "doc_id"), "left_semi").select("key", "doc_id"))
    pairs = materialise(index.pairs.join(gone, _same(index.pairs, gone, "key", "doc_id"), "left_anti"))
    touched = gone.select("key").distinct()
    again = _count(pairs.join(touched, "key", "left_semi"))
    refs = materialise(index.refs.join(touched, "key", "left_anti").union(again))
    return LineIndex(pairs, refs, _changed_filters(index, refs), index.shards)


def _maybe_frequent(pairs: DataFrame, index: LineIndex) -> DataFrame:
    """The pairs (key, doc_id) whose key may be in the filters.

    Pairs meet their shard's filter in parts of about PAIRS_PER_PART, each with its own copy, so a
    shard with a very frequent key is spread like any other."""
    at = pairs.withColumn("shard", shard_of(F.col("key"), index.shards))
    parts = materialise(at.groupBy("shard").agg(F.ceil(F.count("*") / PAIRS_PER_PART).cast("int").alias("parts")))
    few = F.broadcast(parts)  # a row a shard, of KEYS_PER_SHARD keys
    spread = at.join(few, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "key", "doc_id")
    copies = index.filters.join(few, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "data")

    def look(held: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.select(["key", "doc_id"])
        if not held.num_rows or not asked.num_rows:
            return asked.slice(0, 0)
        return asked.filter(pa.array(CuckooFilter.from_bytes(held.column("data")[0].as_py()).contains(_hashes(asked.column("key").to_pylist()))))

    return copies.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(look, f"key binary, doc_id {dict(pairs.dtypes)['doc_id']}")


def clean(docs: DataFrame, index: LineIndex, pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs (doc_id, text).

    A text is its lines between \\n; a null or empty one is one empty line. A key, the line
    stripped at both ends with A-Z lower-cased, of MIN_POINTS code points or more that
    MIN_DOCS documents of the index hold loses all its lines except in the largest such
    doc_id, which keeps each of its own. Rows of one doc_id count as one document. Extra
    columns are ignored; an empty table gives an empty table. pairs: postings(docs) where
    they are at hand.

    Filters first take out the lines that no exact table need see; the rest meets refs in a
    join salted by document, so a line that every document holds is spread."""
    maybe = _maybe_frequent(postings(docs) if pairs is None else pairs, index)
    frequent = index.refs.where(F.col("n_docs") >= MIN_DOCS).select("key", "last_doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hit = maybe.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(frequent, ["key", "salt"])
    drop = hit.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("drop"))
    at = docs.select("doc_id", "text").join(drop, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_, dropped, kept = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("drop"), strict=True):
                text = text.as_py() or ""
                n = m = text.count("\n") + 1
                if gone.is_valid:
                    bad = set(gone.as_py())
                    left = [x for x in text.split("\n") if len(x) < MIN_POINTS or key_digest(x) not in bad]
                    m, text = len(left), "\n".join(left)
                lines_.append(n), dropped.append(n - m), kept.append(text)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_lines": pa.array(lines_, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return at.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_text string")
