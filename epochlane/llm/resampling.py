"""Importance resampling of documents towards a target's distribution of hashed word n-grams."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.llm import radix, words
from epochlane.llm.workers import tidy
from epochlane.session import materialise

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of the words whose digests are taken many at a time; longer words are taken one by one.
SHORT = 24
_FULL = np.uint32(0xFFFFFFFF)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of a byte's step of crc32, and tables[n, k, b]: byte k of a state, with value b, after n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    zeros = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(SHORT):
        zeros.append(step[zeros[-1] & 255] ^ (zeros[-1] >> 8))
    return step, np.stack(zeros).astype(np.uint32)


def _after_zeros(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    zeros = _tables()[1]
    return zeros[n, 0, state & 255] ^ zeros[n, 1, state >> 8 & 255] ^ zeros[n, 2, state >> 16 & 255] ^ zeros[n, 3, state >> 24]


def features(run: words.Run) -> tuple[np.ndarray, np.ndarray]:
    """crc32 and text of every word and of every two neighbouring words of a text, joined by a space.

    A state of crc32 is linear in what came before, so that of two words follows from the states of both."""
    step, data, size = _tables()[0], run.bytes_, run.end - run.first
    order = np.argsort(-size, kind="stable")
    first, state = run.first[order], np.full(len(size), _FULL)
    at_least = np.searchsorted(-size[order], -np.arange(SHORT), "left")
    for j, n in enumerate(at_least.tolist()):
        if not n:
            break
        state[:n] = step[(state[:n] ^ data[first[:n] + j]) & 255] ^ (state[:n] >> 8)
    one = np.empty_like(state)
    one[order] = ~state
    long = np.flatnonzero(size > SHORT).tolist()
    for i in long:
        one[i] = zlib.crc32(run.data[run.first[i] : run.end[i]])
    left = np.flatnonzero(run.text[1:] == run.text[:-1])
    before = step[(~one[left] ^ np.uint32(32)) & 255] ^ (~one[left] >> 8)
    two = _after_zeros(before ^ _FULL, np.minimum(size[left + 1], SHORT)) ^ one[left + 1]
    if long:
        for i in np.flatnonzero(size[left + 1] > SHORT).tolist():
            j = left[i] + 1
            two[i] = zlib.crc32(run.data[run.first[j] : run.end[j]], int(~before[i]) & 0xFFFFFFFF)
    return np.concatenate((one, two)), np.concatenate((run.text, run.text[left]))


def counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts of rows fall into each bucket; one row a task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for run in words.runs(batch.column("text"), words.ALPHANUMERIC):
                total += np.bincount(features(run)[0] % np.uint32(buckets), minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(on.astype(np.int32)), "n": pa.array(total[on])})

    return rows.select("text").mapInArrow(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain: a thousand times the log of its smoothed share in target over that in docs, rounded down."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, rows in ((s, docs), (t, target)):
        for r in counts(rows, buckets).collect():  # a row a bucket at most
            into[r["bucket"]] = r["n"]
    n_s, n_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * n_s / ((a + 1) * n_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score) of every row: the mean gain of its features, and that with Gumbel noise."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = sent.value
        for batch in batches:
            n, weight = [], []
            for run in words.runs(batch.column("text"), words.ALPHANUMERIC):
                crc, text = features(run)
                n.append(np.bincount(text, minlength=run.n_texts))
                total = np.bincount(text, weights=of_bucket[crc % np.uint32(len(of_bucket))], minlength=run.n_texts).astype(np.int64)
                weight.append(total // np.maximum(n[-1], 1))
            n, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, weight))
            noise = np.array([_noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64()), "score": pa.array(weight + noise, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(score), "doc_id long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs (doc_id, a whole number, and text; others are ignored).

    Of the documents with least_words words or more, `percent` in a hundred are drawn, those with the
    highest scores; rank numbers them, ties go to the smaller doc_id, and is null for all others. target: a
    table with text. Null and empty texts have no features, weight 0 and are never drawn;
    a null doc_id comes after others in ties and takes its noise from the seed alone; repeated rows are drawn one by one.
    No documents give no rows; an empty target makes every bucket's target share equal."""
    scored = materialise(scores(docs, gains(docs, target, buckets), seed))
    enough = F.col("n_features") >= 2 * least_words - 1  # n words have 2 n - 1 features
    drawn = scored.where(enough).count() * percent // 100
    ranked = radix.with_rank(scored.where(enough).withColumn("_by", F.bitwise_not("score")), ["_by", "doc_id"], "rank").drop("_by")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.withColumn("rank", rank).select(*scored.columns, "rank").union(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
