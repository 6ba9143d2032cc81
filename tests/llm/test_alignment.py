"""Cross-tokenizer alignment against a plain version over the two libraries."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from epochlane.llm import alignment, queries
from epochlane.llm.bpe import byte_letters


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.vocabulary_path())
    a.no_truncation(), a.no_padding()
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=queries.pieces_path())


def plain_tokens(libraries, text):
    a, b = libraries
    letters = byte_letters()
    found = a.encode(" " + text, add_special_tokens=False)
    side_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in found.ids]
    name = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    side_b = [(i, name(b.id_to_piece(i))) for i in b.encode(text)]
    return side_a, side_b


def plain(libraries, rows):
    found, count = [], Counter()
    for i, text in rows:
        sides = plain_tokens(libraries, text) if text else ([], [])
        if text and any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
            sides = ([], [])
        ends = []
        for s in sides:
            at, own = 0, {}
            for token, b in s:
                at += len(b)
                own[at] = token
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(ends[0][e], ends[1][e]) for e in common]
        count.update(links)
        parts, last = [], 0
        for e in common:
            parts.append("|".join(",".join(str(own[x]) for x in sorted(own) if last < x <= e) for own in ends))
            last = e
        found.append((i, sides, links, ";".join(parts)))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, sides, links, spelt in found:
        best = sum(count[x] == most[x[1]] for x in links)
        out.append((i, len(sides[0]), len(sides[1]), len(links), len(links), best, sum(count[x] for x in links), hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return sorted(out, key=str)


HARD = ["<|endoftext|> a<|endoftext|>b", "</s><s> <unk> <0x41> x", "▁ under ▁▁ score", "日本語 テキスト ½ ² ٣", "a" * 3000, "\n\n \t  x \r\n", "\x1c \x1d \u0085", "😀👩‍👩‍👧 and 🫠", "ﬁ ǅ ᾈ ẞ", "it's we'LL  don't  x", " " * 300 + "x", "x" + " " * 50, "\x00\x01", "　᠎​", "Ⴧ ꭓ 𞤀 new letters"]


def test_alignment(spark, docs, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 300)
    rows = docs.select("doc_id", "text").where("length(text) < 9000 or text is null").union(spark.createDataFrame([(200 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    got = alignment.cross_tokens(rows.repartition(3), queries.vocabulary_path(), queries.pieces_path())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, [tuple(r) for r in rows.collect()])


def test_alignment_ignores_other_columns_and_takes_nothing(docs, empty):
    found = alignment.cross_tokens(docs, queries.vocabulary_path(), queries.pieces_path(), spell=True)
    assert found.count() == docs.count()
    for r in found.collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] if r["groups"] else r["groups_sha256"] == ""
    assert alignment.cross_tokens(empty, queries.vocabulary_path(), queries.pieces_path()).count() == 0


def test_alignment_of_a_whole_table(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(libraries, rows)


def test_settled_characters_are_cut_alike(libraries):
    """On every character that isn't unsettled, both libraries give the same ids."""
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        side = alignment.byte_level(f.read())
    odd = alignment.unsettled().search
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and odd(chr(c)) is None]
    texts = ["".join(f"a{c}1 {c} {c}{c}z" for c in every[at : at + 400]) for at in range(0, len(every), 400)]
    assert side.encode(texts) == [x.ids for x in libraries[0].encode_batch(texts, add_special_tokens=False)]
    assert len(every) > 150_000 and side.encode(["x" + " " * 400_000 + "y"]) == [libraries[0].encode("x" + " " * 400_000 + "y").ids]


def test_names_of_groups():
    data, starts = alignment._spelt(*(__import__("numpy").array(x) for x in ([7, 8, 9], [4, 5], [False, True, True], [True, True])), alignment._names(10, 10), 10, 10)
    assert bytes(data) == b"7,8|4;9|5;" and starts.tolist() == [0, 2, 4, 6, 8, 10]
    assert isinstance(alignment._names(3, 2), pa.LargeStringArray)
