"""Each stage of the pipeline against brute force over a whole table; texts and tables that other tests leave out."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from epochlane.llm import bpe, langid, near_copies, queries, sharding, simhash, suffix_dedup

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def kept_by_brute_force(rows):
    """Ids that stay when documents linked by near_copies.similarity() keep their smallest."""
    found = {d: simhash.digests(t, near_copies.WORDS) for d, t in rows}
    root = {d: d for d in found}

    def of(d):
        while root[d] != d:
            d = root[d]
        return d

    by_shingle = defaultdict(list)
    for d, h in found.items():
        for x in set(h.tolist()):
            by_shingle[x].append(d)
    pairs = {(a, b) for ds in by_shingle.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        if near_copies.similarity(found[a], found[b]) >= near_copies.LEAST:
            x, y = sorted((of(a), of(b)))
            root[y] = x
    return sorted(d for d in found if of(d) == d)


def test_stages_over_the_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    model, rows = langid.fit(docs), docs.select("doc_id", "text").collect()
    first = written(STAGES["language_id"](spark, docs, DATA), "a")
    out = langid.judge(model, [r["text"] for r in rows])[2]
    assert ids(first) == sorted(r["doc_id"] for r, gone in zip(rows, out, strict=True) if not gone)

    second = written(STAGES["exact_dedup"](spark, first, DATA), "b")
    groups = defaultdict(list)
    for r in first.select("doc_id", "text").collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append((-len(r["text"]), r["doc_id"]))
    assert ids(second) == sorted(min(g)[1] for g in groups.values())

    third = written(STAGES["simhash"](spark, second, DATA), "c")
    assert ids(third) == kept_by_brute_force([tuple(r) for r in second.select("doc_id", "text").collect()])

    fourth = written(STAGES["mixing"](spark, third, DATA), "d")
    assert fourth.columns == docs.columns and Counter(map(tuple, fourth.collect())) == Counter(map(tuple, third.collect()))

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    tokenizer.no_truncation(), tokenizer.no_padding()
    last = STAGES["bpe"](spark, fourth, DATA).collect()
    want = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids for r in fourth.collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in last} == {d: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for d, x in want.items()}
    assert sorted(r["position"] for r in last) == list(range(len(last)))


def test_bpe_of_no_rows_and_of_columns_named_like_its_own(docs, empty):
    assert bpe.encode_decode(empty, queries.vocabulary_path()).count() == 0
    clash = docs.withColumns({"n_tokens": F.lit(-1), "ids_sha256": F.lit("x"), "ids": F.lit(None).cast("array<int>")})
    plain = lambda df: Counter(map(tuple, bpe.encode_decode(df, queries.vocabulary_path()).collect()))
    assert plain(clash) == plain(docs)


def test_pieces_merged_in_step_equal_pieces_merged_alone():
    words = bpe.Vocabulary.parse(open(queries.vocabulary_path(), encoding="utf-8").read())
    codec, rng = bpe.Codec(words, bpe.odd_characters()), np.random.default_rng(3)
    letters = list(" aeinrstlodmuéüñß的01.,\n")
    pieces = {"".join(rng.choice(letters, n)) for n in [*range(1, 70), *rng.integers(1, 20, 300)]} | {"a" * n for n in (1, 2, 3, 64, 65, 66, 200)}
    codec.learn(pieces)
    for p in pieces:
        alone = bpe.merge_piece([words.byte_ids[b] for b in p.encode()], words.merges)
        assert codec.known[p] == (",".join(map(str, alone)), p)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    codec = bpe.Codec(bpe.Vocabulary.parse(open(queries.vocabulary_path(), encoding="utf-8").read()), "")
    for lo in range(0, 600, 20):
        text = " ".join(f"word{i}x" for i in range(lo, lo + 20)) + " " + "y" * 500
        assert bpe.Codec.decode(codec.encode([text])[0]) == text
        assert len(codec.known) <= 50 + 65 and len(codec.old) <= 50 + 65 and not any(len(p) > bpe.MEMO_LETTERS for p in codec.known)


def test_very_long_texts(spark, docs):
    long = docs.where("doc_id in (8, 9)").select("doc_id", "text")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(long).collect()}
    sizes = {r["doc_id"]: len(r["text"]) for r in long.collect()}
    # 9 is 8 and one character more: what stays is the end that no other start has
    assert {d: r["n_bytes"] for d, r in got.items()} == sizes and got[8]["n_removed"] == sizes[8]
    assert bytes(got[9]["kept"]) == b"!" and got[9]["n_spans"] == 1
    shards = {r["doc_id"]: r for r in sharding.assign(docs.select("doc_id", "text")).collect()}
    assert shards[8]["size"] == sizes[8] + 1 and shards[8]["shard"] != shards[9]["shard"]
