"""Importance resampling and the radix sort under it, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from epochlane.llm import queries, radix, resampling, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(rows, target, buckets=10_000):
    found = [(i, [zlib.crc32(x.encode()) % buckets for x in plain_features(t)]) for i, t in rows]
    s = Counter(b for _, f in found for b in f)
    t = Counter(zlib.crc32(x.encode()) % buckets for text in target for x in plain_features(text))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)]
    out = []
    for i, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_features_of_words_short_and_long_are_those_of_zlib():
    random.seed(3)
    letters = "aZ09é日😀 -_\n\x7f"
    texts = [None, "", "x", "A" * 23, "b" * 24, "c" * 25, "d " + "e" * 300 + " f " + "g" * 40 + " " + "h" * 70] + ["".join(random.choices(letters, k=random.randrange(90))) for _ in range(300)]
    for run in words.runs(pa.array(texts, pa.string()), words.ALPHANUMERIC):
        crc, text = resampling.features(run)
        got = sorted(zip(text.tolist(), crc.tolist(), strict=True))
    assert got == sorted((k, zlib.crc32(x.encode())) for k, t in enumerate(texts) for x in plain_features(t))


def test_resampling(spark, docs):
    more = spark.createDataFrame([(1000 + i, " ".join(f"w{j % (i + 1)}" for j in range(18 + i))) for i in range(40)] + [(1003, "tied " * 30)] * 3, "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    target = spark.createDataFrame([("The quick brown fox of w1 w2 w3",), (None,), ("w1 w2",)], "text string").withColumn("doc_id", F.lit("clash"))
    got = resampling.resample(docs.unionByName(more, allowMissingColumns=True), target)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == plain([tuple(r) for r in rows.collect()], [r[0] for r in target.select("text").collect()])


def test_resampling_of_nothing(empty, docs):
    assert resampling.resample(empty, docs).count() == 0
    found = resampling.resample(docs, empty)
    assert found.count() == docs.count() and found.where("rank is not null").count() == found.where("n_features >= 39").count() * 25 // 100


def test_resampling_of_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op12_resampling(spark, d).collect()), key=str) == plain(rows, target)


def test_radix_ranks(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK_ROWS", 16)
    random.seed(1)
    wide = [random.choice([-(1 << 63), (1 << 63) - 1, -1, 0, 5, None, random.getrandbits(63)]) for _ in range(300)]
    rows = [(random.randrange(-3, 4), w, f"p{i}") for i, w in enumerate(wide)]
    got = radix.with_rank(spark.createDataFrame(rows, "a long, b long, c string"), ["a", "b"], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(1, 301))
    big = (1 << 63) - 1
    assert [(r["a"], big if r["b"] is None else r["b"]) for r in got] == sorted((a, big if b is None else b) for a, b, _ in rows)
    assert sorted(r["c"] for r in got) == sorted(r[2] for r in rows)
    same = radix.with_rank(spark.createDataFrame([(7, str(i)) for i in range(40)], "a long, c string"), ["a"], "at")
    assert sorted(r["at"] for r in same.collect()) == list(range(1, 41))
    assert radix.with_rank(same.where("false"), ["a"], "again").count() == 0
