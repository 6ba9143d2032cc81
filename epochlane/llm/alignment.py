"""Alignment of two tokenizers' tokens by the bytes where they end, in Arrow tables merged by Spark."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from epochlane.llm.bpe import PIECES, byte_letters
from epochlane.llm.workers import tidy
from epochlane.session import materialise

#: Bytes of the texts of a block: its tokens are aligned, and its pairs counted, together. A longer text is a block.
BLOCK = 1 << 21
#: Ids of B are below this.
SHIFT = 1 << 20
NOTHING = ("n_a", "n_b", "n_groups", "n_links")


@cache
def unsettled() -> re.Pattern:
    """Characters that libraries of different Unicode versions may class differently: those that were new or
    of another category in one of the versions 3.2 and today's, and that the tokenizers library must cut itself."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    odd = [c for c in range(0x80, 0x110000) if old(chr(c)) == "Cn" or old(chr(c)) != now(chr(c))]
    spans = [[c for _, c in g] for _, g in groupby(enumerate(odd), lambda x: x[1] - x[0])]
    return re.compile("[" + "".join(f"{re.escape(chr(s[0]))}-{re.escape(chr(s[-1]))}" for s in spans) + "]")


@dataclass
class Side:
    """A tokenizer: ids of many texts, and the bytes of each id."""

    encode: object
    token_bytes: list[bytes]

    def __post_init__(self) -> None:
        self.table = pa.array(self.token_bytes, pa.binary())
        self.size = pa.array([len(b) for b in self.token_bytes], pa.int64())


def byte_level(vocabulary: str) -> Side:
    """Tokenizer A, by a byte-level vocabulary's JSON text; the ids are those of the tokenizers library.

    Ids of such a vocabulary rank its merges, which tiktoken needs; texts with an unsettled() character,
    and texts on which its pattern gives up, go to the tokenizers library."""
    data, letters = json.loads(vocabulary), byte_letters()
    special = {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if i not in special}
    fast = tiktoken.Encoding("byte level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_str(vocabulary)
    slow.no_truncation(), slow.no_padding()
    slow.encode_special_tokens = True
    odd = unsettled().search

    def one(text: str) -> list[int]:
        if odd(text) is None:
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the pattern's engine is no Exception
                if not type(e).__name__.startswith("Panic"):
                    raise
        return slow.encode(text, add_special_tokens=False).ids

    known = {i: b for b, i in ranks.items()} | special
    return Side(lambda texts: [one(t) for t in texts], [known.get(i, b"") for i in range(max(known) + 1)])


def pieces(model: bytes) -> Side:
    """Tokenizer B, by a sentencepiece model's bytes."""
    sp = SentencePieceProcessor(model_proto=model)
    of_id = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return Side(lambda texts: sp.encode(texts, num_threads=1), of_id)


@lru_cache(maxsize=1)
def _sides(vocabulary: str, model: bytes) -> tuple[Side, Side]:
    return byte_level(vocabulary), pieces(model)


def _same_bytes(side: Side, ids: list[list[int]], wanted: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """ids as a list array, and whether each text's tokens join to its wanted bytes."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, side.table.take(lists.values)), b"")
    return lists, pc.equal(joined, wanted).to_numpy(zero_copy_only=False)


def _tokens(side: Side, lists: pa.ListArray, base: np.ndarray) -> pa.Table:
    """(id, doc, end) of the tokens of lists in their order: the text they are of, and the place in the block's
    joined texts where they end. base: where each text begins there."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    size = side.size.take(ids)
    run = pc.cumulative_sum(size)
    # running lengths restart at each text: less the sum up to its first token, plus the text's own place
    before = np.concatenate(([0], run.to_numpy()))[lists.offsets.to_numpy()[:-1]]
    shift = pa.array(base - before).take(doc)
    return pa.table({"id": ids, "doc": doc, "end": pc.add(run, shift), "at": pa.array(np.arange(len(ids)))})


def _spelt(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names: pa.Array, n_a: int, n_b: int) -> tuple[memoryview, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups of a block, and where each of its names begins. cut: whether a token is the last of its group."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    ends_a, ends_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    at_a = np.arange(len(a)) + np.concatenate(([0], ends_b))[group_a]
    at_b = np.arange(len(b)) + ends_a[group_b]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[at_a] = a + n_a * cut_a
    codes[at_b] = 2 * n_a + b + n_b * cut_b
    out = names.take(pa.array(codes))
    return memoryview(out.buffers()[2] or b""), np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1]


@lru_cache(maxsize=1)
def _names(n_a: int, n_b: int) -> pa.Array:
    """Every id of A before a comma, then before a bar, and every id of B before a comma, then before a semicolon."""
    return pa.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)], pa.large_string())


def align(texts: list[str], side_a: Side, side_b: Side, spell: bool = False) -> tuple[pa.Table, pa.Table]:
    """The rows of a block's texts, and its id pairs.

    Rows: n_a, n_b, n_groups, n_links, groups_sha256 (and groups if spell), and the text's pairs: `steps`, the
    differences of their ascending places in the block's pairs, and `times`. Pairs: pair (A id * SHIFT + B id)
    and n, how many links hold it."""
    n = len(texts)
    live = [k for k, t in enumerate(texts) if t]
    wanted = pa.array([b" " + texts[k].encode() for k in live], pa.binary())
    lists, good = [], np.ones(len(live), bool)
    for side, given in ((side_a, [" " + texts[k] for k in live]), (side_b, [texts[k] for k in live])):
        found, same = _same_bytes(side, side.encode(given), wanted)
        lists.append(found)
        good &= same
    live = np.array(live, np.int64)[good]
    lists = [x.filter(pa.array(good)) for x in lists]
    base = np.cumsum(np.concatenate(([0], pc.binary_length(wanted.filter(pa.array(good))).to_numpy())))[:-1].astype(np.int64)
    a, b = (_tokens(s, x, base) for s, x in zip((side_a, side_b), lists, strict=True))
    met = a.join(b, "end", join_type="inner", right_suffix="_b", use_threads=False)
    met = pa.table({"doc": pc.cast(met["doc"], pa.int64()), "at": met["at"], "at_b": met["at_b"], "pair": pc.add(pc.multiply(pc.cast(met["id"], pa.int64()), SHIFT), pc.cast(met["id_b"], pa.int64()))})
    block = met.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]).sort_by("pair")
    place = np.searchsorted(block["pair"].to_numpy(), met["pair"].to_numpy())
    own = pa.table({"key": pa.array(met["doc"].to_numpy() << 32 | place)}).group_by("key", use_threads=False).aggregate([([], "count_all")]).sort_by("key")
    key = own["key"].to_numpy()
    at, doc = key & 0xFFFFFFFF, key >> 32
    steps = np.diff(at, prepend=0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    steps[first] = at[first]
    cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    cut_a[met["at"].to_numpy()], cut_b[met["at_b"].to_numpy()] = True, True
    rows = {c: np.zeros(n, np.int64) for c in NOTHING}
    offsets = [x.offsets.to_numpy() for x in lists]
    rows["n_a"][live], rows["n_b"][live] = (np.diff(o) for o in offsets)
    doc_a = pc.list_parent_indices(lists[0]).to_numpy()
    rows["n_groups"][live] = np.bincount(doc_a[cut_a], minlength=len(live))
    rows["n_links"][live] = np.bincount(met["doc"].to_numpy(), minlength=len(live))
    n_a, n_b = len(side_a.token_bytes), len(side_b.token_bytes)
    data, starts = _spelt(a["id"].to_numpy(), b["id"].to_numpy(), cut_a, cut_b, _names(n_a, n_b), n_a, n_b)
    groups, sha = [""] * n, [""] * n
    for j, k in enumerate(live.tolist()):
        # a text's names stand together, A's and B's: the semicolon after its last group isn't part of it
        line = data[starts[offsets[0][j] + offsets[1][j]] : starts[offsets[0][j + 1] + offsets[1][j + 1]] - 1]
        sha[k] = hashlib.sha256(line).hexdigest()
        if spell:
            groups[k] = str(line, "utf-8")
    size = np.zeros(n, np.int64)
    size[live] = np.bincount(doc, minlength=len(live))
    list_ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
    out = {c: pa.array(v) for c, v in rows.items()} | {"groups_sha256": pa.array(sha, pa.string())} | ({"groups": pa.array(groups, pa.string())} if spell else {})
    out |= {c: pa.ListArray.from_arrays(list_ends, pa.array(v.astype(np.int32))) for c, v in (("steps", steps), ("times", own["count_all"].to_numpy()))}
    return pa.table(out), block


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Document ids and texts, in runs of about BLOCK bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        kind = batch.column("doc_id").type
        for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= BLOCK:
                yield pa.array(ids, kind), texts
                ids, texts, size = [], [], 0
    if texts:
        yield pa.array(ids, kind), texts


def aligned(docs: DataFrame, vocabulary: str, model: str, spell: bool = False) -> DataFrame:
    """Each text's row as align() gives it, and one row a block with its pairs (block_pairs, block_counts)."""
    with open(vocabulary, encoding="utf-8") as f, open(model, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two files of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {'groups string, ' if spell else ''}steps array<int>, times array<int>, block_pairs array<long>, block_counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = _sides(*sent.value)
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for k, (ids, texts) in enumerate(_blocks(batches)):
            rows, pairs = align(texts, side_a, side_b, spell)
            n, block = len(ids), TaskContext.get().partitionId() << 32 | k
            longs = pa.list_(pa.int64())
            cols = {c: rows[c] for c in rows.column_names} | {"block": pa.array([block] * n, pa.int64()), "doc_id": ids} | {c: pa.nulls(n, longs) for c in ("block_pairs", "block_counts")}
            yield from pa.table({c: cols[c] for c in names}).combine_chunks().to_batches()
            of_block = {"block": pa.array([block], pa.int64()), "block_pairs": pa.array([pairs["pair"].to_numpy()], longs), "block_counts": pa.array([pairs["n"].to_numpy()], longs)}
            yield from pa.table({c: of_block.get(c, pa.nulls(1, cols[c].type)) for c in names}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def cross_tokens(docs: DataFrame, vocabulary: str, model: str, spell: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text;
    others are ignored); with spell also the groups themselves.

    A is a byte-level vocabulary (JSON), which gets a space and the text, B a sentencepiece model, which adds
    the space itself. Tokens of both that end at the same byte are linked and end a group. An id pair's count is
    the number of links in all rows that hold it; n_best: links whose count is the highest of their B id;
    count_sum: the sum of the links' counts. Null and empty texts, and those whose tokens don't join to the space and the
    text, get zeros and ''; repeated rows count each time; a null doc_id is an id like any other; no rows give no rows.

    Texts are tokenized once, in blocks of bounded bytes. A block's pairs are counted in Arrow, all blocks' counts
    are merged by Spark, and come back to their block, where each text looks up its own pairs: so a frequent pair
    moves once a block, not once a link."""
    found = materialise(aligned(docs, vocabulary, model, spell))
    of_block = found.where("block_pairs is not null").select("block", F.explode(F.arrays_zip("block_pairs", "block_counts")).alias("_")).select("block", F.col("_.block_pairs").alias("pair"), F.col("_.block_counts").alias("n"))
    total = of_block.groupBy("pair").agg(F.sum("n").alias("count"))
    total = materialise(total.withColumn("b", F.col("pair").bitwiseAND(F.lit(SHIFT - 1))))
    best = total.groupBy("b").agg(F.max("count").alias("most"))  # a row an id of B
    total = total.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = of_block.drop("n").join(total, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    names = [f.name for f in found.schema.fields if f.name not in ("block", "steps", "times", "block_pairs", "block_counts")]
    rows = found.where("block_pairs is null").select("block", *names, "steps", "times")

    def look_up(own: pa.Table, pairs: pa.Table) -> pa.Table:
        own, pairs = own.combine_chunks(), pairs.sort_by("pair")
        count, on = pairs["count"].to_numpy(), pairs["best"].to_numpy()
        steps = own["steps"].combine_chunks()
        offsets, flat = steps.offsets.to_numpy(), steps.values.to_numpy().astype(np.int64)
        run = np.concatenate(([0], np.cumsum(flat)))
        doc = np.repeat(np.arange(len(own)), np.diff(offsets))
        at = run[1:][offsets[0] : offsets[-1]] - run[offsets[:-1]][doc]
        times = pc.list_flatten(own["times"].combine_chunks()).to_numpy()
        sums = np.zeros((2, len(own)), np.int64)
        for j, v in enumerate((times * on[at], times * count[at]) if len(at) else ()):
            np.add.at(sums[j], doc, v)
        out = {c: own[c] for c in names} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table({c: out[c] for c in order})

    order = ["doc_id", *NOTHING, "n_best", "count_sum", "groups_sha256", *["groups"] * spell]
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(look_up, ", ".join(f"{c} {types.get(c, 'bigint')}" for c in order))
