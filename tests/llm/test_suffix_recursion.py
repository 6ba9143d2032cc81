"""The suffix sort recurses on names, in the registered operator too."""

import random

from epochlane.llm import suffix_dedup
from epochlane.session import materialise


def counted(monkeypatch):
    rounds, plain = [], suffix_dedup.name
    monkeypatch.setattr(suffix_dedup, "name", lambda *a: rounds.append(1) or plain(*a))
    return rounds


def brute(pieces, length):
    seen = {}
    for r, p in pieces:
        for i in range(len(p) - length + 1):
            seen.setdefault(p[i : i + length], []).append(r * suffix_dedup.SPAN + i)
    return sorted(x for v in seen.values() if len(v) > 1 for x in v)


def test_names_of_names_order_long_strings(spark, monkeypatch):
    """Strings that differ in their last byte alone, by names of one, two and three rounds."""
    rnd = random.Random(8)
    base = bytes(rnd.choices(b"ab", k=260))
    pieces = [(1, base), (2, base[:199] + b"X" + base[200:]), (3, b"zz" + base[:210] + b"q"), (4, bytes(rnd.choices(b"ab", k=230))), (5, b"ab" * 120)]
    df = materialise(spark.createDataFrame(pieces, "rid long, piece binary"))
    for length, rounds in ((24, 1), (31, 2), (72, 2), (200, 3)):
        seen = counted(monkeypatch)
        got = sorted(r["pos"] for r in suffix_dedup.repeated_starts(df, sum(len(p) for _, p in pieces), length).collect())
        monkeypatch.undo()
        assert got == brute(pieces, length) and len(seen) == rounds


def test_registered_operator_names_names(spark, monkeypatch):
    seen = counted(monkeypatch)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    suffix_dedup.remove_repeats(docs).count()
    assert len(seen) >= 2
