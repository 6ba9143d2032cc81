"""Jaccard join of documents by distinct word n-grams, through a matrix of tokens and groups of documents."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlane.llm import words
from epochlane.llm.workers import tidy
from epochlane.operators.graph import connected_components
from epochlane.operators.skew import join_spread
from epochlane.session import discard, materialise

WORDS, PERCENT = 4, 85
#: Counters a document of the table by which n-grams are ordered, rare ones first, their least and greatest number, and those
#: of a row of it. The table decides how fast, never what is found.
COUNTERS, LEAST_COUNTERS, MOST_COUNTERS, WIDTH = 16, 1 << 16, 1 << 26, 1 << 12
#: Bits of the maps that let rows pass which a join needs; more entries let more rows pass than needed. Of the map of n-grams, bits a
#: node and their most.
BITS, BITS_A_NODE, MOST_BITS = 1 << 24, 256, 1 << 27
#: Of an n-gram's bits the first, PARTS at most, name the part in which it meets its like, one for about NODES texts; the next 32, its cut, stand for it there.
PARTS, NODES = 12, 1 << 12
#: Keys by which similar documents meet at first, to be put into groups, and how often a document must meet a leader to be compared with it.
KEYS, MEETINGS = 6, 3
SHORT = 64
#: N-grams of a part of a group, about, when its members meet those of another one: a task holds two parts.
CELL = 1 << 12

_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_RANDOM = np.random.RandomState(13)
_XOR, _TIMES = (_RANDOM.randint(0, 1 << 63, KEYS, dtype=np.int64).astype(np.uint64) << _U(1) | _U(1) for _ in range(2))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _M1
    h = (h ^ (h >> _U(29))) * _M2
    return h ^ (h >> _U(32))


def word_hashes(run: words.Run) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes of all words at a time; words over SHORT bytes one by one."""
    size = run.end - run.first
    order = np.argsort(-size, kind="stable")
    first, ordered = run.first[order], size[order]
    eight = np.ndarray(len(run.data), "<u8", run.data + bytes(8), strides=(1,)) if run.data else np.zeros(0, np.uint64)
    state = _mix(ordered.astype(np.uint64))
    for at in range(0, SHORT, 8):
        n = int(np.searchsorted(-ordered, -at, "left"))
        if not n:
            break
        state[:n] = _mix(state[:n] ^ (eight[first[:n] + at] & _LOW[np.minimum(ordered[:n] - at, 8)]))
    out = np.empty_like(state)
    out[order] = state
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(run.data[run.first[i] : run.end[i]])
    return out


class Grams(NamedTuple):
    """Runs of so many words; as bags, a repeated one counts each time: its repetitions are n-grams of their own.

    With both, a text counts as a set and, where that differs, as a bag. A set and a bag are only as similar as both texts' sets
    or less, so they may meet."""

    words: int
    bags: bool = False
    both: bool = False


def shingles(run: words.Run, grams: Grams) -> list[np.ndarray]:
    """The distinct hashes of each text's n-grams, ascending; of a text with fewer words than one the whole sequence's."""
    k = grams.words
    h, n = word_hashes(run), run.words_of_text()
    ends = np.cumsum(n)
    chains = [h]
    for j in range(1, k):
        chains.append(_mix(chains[-1][:-1] * _M2 + h[j:]) if len(h) > j else h[:0])
    out = []
    for last, c in zip(ends.tolist(), n.tolist(), strict=True):
        width = min(c, k)
        out.append(np.unique(chains[width - 1][last - c : last - width + 1]) if c else h[:0])
        if grams.bags and len(out[-1]) < c - width + 1:
            every = np.sort(chains[width - 1][last - c : last - width + 1])
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            turn = np.arange(len(every)) - np.repeat(first, np.diff(np.append(first, len(every))))
            out[-1] = np.unique(np.where(turn > 0, _mix(every + turn.astype(np.uint64) * _M1), every))
    return out


def _sets(texts: pa.Array, k: Grams) -> Iterator[np.ndarray]:
    for run in words.runs(texts, words.NOT_BLANK):
        yield from shingles(run, k)


def _forms(texts: pa.Array, k: Grams) -> Iterator[list[np.ndarray]]:
    """Each text's n-grams, of k.both first as a set and then, if a run of words repeats, as a bag."""
    if not k.both:
        yield from ([found] for found in _sets(texts, k))
        return
    for one, bag in zip(_sets(texts, Grams(k.words)), _sets(texts, Grams(k.words, True)), strict=True):
        yield [one] if len(one) == len(bag) else [one, bag]


def _digest(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes()).digest()


def _packed(x: np.ndarray) -> bytes:
    """Numbers that are small for their kind, their bytes of equal weight together and compressed: Spark's own codec finds no such bits."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: pa.Scalar, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(packed.as_buffer(), n * size, "zstd"), np.uint8).reshape(size, n).T.copy().view(kind).reshape(-1)


def classes(docs: DataFrame, k: Grams) -> np.ndarray:
    """A number from 0 to 255 for each class of n-grams, higher for classes that occur more often.

    There are about COUNTERS classes a document, MOST_COUNTERS at most, so that a common n-gram stands out at every size. A
    task sends its counters, packed, in rows of WIDTH, which are added up in two steps; the driver gets the sums."""
    size = 1 << min(max(COUNTERS * docs.count() - 1, LEAST_COUNTERS - 1).bit_length(), MOST_COUNTERS.bit_length() - 1)
    parts, top = size // WIDTH, np.iinfo(np.uint16).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for run in words.runs(batch.column("text"), words.NOT_BLANK):
                at, n = np.unique(np.concatenate(shingles(run, k._replace(bags=k.bags or k.both)) or [np.zeros(0, np.uint64)]) & _U(size - 1), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        for part, x in enumerate(np.minimum(total, top).astype(np.uint16).reshape(parts, WIDTH)):
            if x.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([_packed(x)], pa.binary())})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(_unpacked(x, WIDTH, np.uint16).astype(np.int64) for x in rows["n"])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([_packed(np.minimum(total, top).astype(np.uint16))], pa.binary())})

    sent = docs.select("text").mapInArrow(tidy(count), "part int, n binary").withColumn("salt", F.spark_partition_id() % 8)
    once = sent.groupBy("part", "salt").applyInArrow(add, "part int, n binary")
    total = np.zeros((parts, WIDTH), np.uint16)
    for r in once.groupBy("part").applyInArrow(add, "part int, n binary").toLocalIterator():
        total[r["part"]] = _unpacked(pa.scalar(bytes(r["n"])), WIDTH, np.uint16)
    flat = total.reshape(-1).astype(np.float32)
    return np.clip(np.floor(2 * np.log2(np.maximum(flat / max(1.0, float(flat.mean())), 1))), 0, 255).astype(np.uint8)


def least_overlap(n: int, percent: int) -> int:
    """The least common part of a set of n and any set linked with it."""
    return -(-percent * n // 100)


def signatures(docs: DataFrame, k: Grams, percent: int) -> DataFrame:
    """(row, doc_id, digest, twin, n, common, keys, prefix) of every row: the size and digest of its set, how many in a thousand of
    its n-grams are of common classes, keys by which similar sets meet, and so many of its n-grams, rare classes first,
    that linked sets share one of them. A text's bag, if k asks for both, is a row after its set's, which has its digest as twin."""
    sent = docs.sparkSession.sparkContext.broadcast(classes(docs, k))  # MOST_COUNTERS bytes at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            at, turn, digests, twins, sizes, common, keys, prefixes = [], [], [], [], [], [], [], []
            for i, forms in enumerate(_forms(batch.column("text"), k)):
                for j, found in enumerate(forms):
                    n = len(found)
                    at.append(i)
                    turn.append(j)
                    digests.append(_digest(found))
                    twins.append(_digest(forms[1]) if forms[1:] and not j else None)
                    sizes.append(n)
                    keys.append(_keys(found).view(np.int64) if n else np.zeros(0, np.int64))
                    own = rank[(found & _U(len(rank) - 1)).astype(np.int64)]
                    common.append(1000 * int(np.count_nonzero(own)) // max(n, 1))
                    in_order = found[np.argsort(own, kind="stable")]
                    prefixes.append(in_order[: n - least_overlap(n, percent) + 1].view(np.int64))
            row = batch.column("row").to_numpy()[at] * (1 + k.both) + np.array(turn, np.int64)
            yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "digest": pa.array(digests, pa.binary()), "twin": pa.array(twins, pa.binary()), "n": pa.array(sizes, pa.int64()), "common": pa.array(common, pa.int32()), "keys": _lists(keys), "prefix": _lists(prefixes)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(tidy(sign), f"row long, doc_id {kind}, digest binary, twin binary, n long, common int, keys array<long>, prefix array<long>")


def _keys(found: np.ndarray) -> np.ndarray:
    """A least hash of the set for each key, with its size class: near copies share most of them."""
    least = np.full(KEYS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 13):
        h = (found[at : at + (1 << 13), None] ^ _XOR) * _TIMES
        least = np.minimum(least, (h ^ (h >> _U(32))).min(axis=0))
    size = np.floor(3 * math.log(len(found)) + np.arange(KEYS) / KEYS).astype(np.uint64)
    return _mix(least + size * _M1)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def bit_map(df: DataFrame, place: Column, bits: int = BITS) -> np.ndarray:
    """So many bits, in words of 64: those at a place that a row of df has. The driver gets bits / 64 rows at most."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = df.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["w"].to_numpy().view(np.uint64)
    return out


def _on(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63).astype(np.uint64) & _U(1)).astype(bool)


def _place(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BITS))


def sets_of(docs: DataFrame, wanted: DataFrame, k: Grams, kind: type = np.uint64, more: tuple[str, ...] = ()) -> DataFrame:
    """(node, h), written: the whole sets of wanted (node, digest, least), where least is the doc_id of a text that has it,
    with more of its columns.

    h: the n-grams' hashes in ascending order as bytes, cut to numbers of `kind`. Other texts stay where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, _place("least")))  # BITS bits

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for forms in _forms(batch.column("text").filter(pa.array(_on(sent.value, batch.column("at").to_numpy()))), k) for f in forms]
            cut = [np.sort(f.astype(kind)).tobytes() for f in found]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([_digest(f) for f in found], pa.binary()), "h": pa.array(cut, pa.binary())})

    rows = docs.select(_place("doc_id").alias("at"), "text").mapInArrow(tidy(read), "digest binary, h binary")
    return materialise(rows.dropDuplicates(["digest"]).join(wanted.select("node", "digest", *more), "digest").select("node", "h", *more))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two lists share, repeats counted."""
    (a, n), (b, m) = (np.unique(v, return_counts=True) for v in (x, y))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def compared(pairs: DataFrame, sets: DataFrame, percent: int, kind: type = np.uint64) -> DataFrame:
    """(src, dst), written: the pairs whose sets, as sets_of() gives them, are linked.

    Cut hashes share no less than whole ones, so of them no linked pair is lost."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), kind) for v in (x, y))
                common = _common(x, y)
                on.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["src", "dst"]).filter(pa.array(on, pa.bool_()))

    at = pairs.select("src", "dst").join(sets.select(F.col("node").alias("dst"), F.col("h").alias("b")), "dst")
    both = at.join(sets.select(F.col("node").alias("src"), F.col("h").alias("a")), "src")
    return materialise(both.select("src", "dst", "a", "b").mapInArrow(tidy(check), "src long, dst long"))


def linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: Grams, percent: int) -> DataFrame:
    """(src, dst), written: the pairs of nodes (node, digest, least) whose whole sets are linked.

    Sixteen bits of each hash come first, as most pairs share too few of those; the whole sets of the pairs left decide."""
    few = pairs
    for kind in (np.uint16, np.uint64):
        ends = few.select(F.col("src").alias("node")).union(few.select("dst")).distinct()
        sets = sets_of(docs, nodes.select("node", "digest", "least").join(ends, "node"), k, kind)
        after = compared(few, sets, percent, kind)
        discard(sets, *([few] if few is not pairs else []))
        few = after
    return few


def first_pairs(keys: DataFrame) -> DataFrame:
    """(src, dst) of nodes (node, common, keys): each node with the two leaders of its keys that it meets MEETINGS times or more.

    One leader has the largest share of common n-grams: of near copies of a text those with the fewest changes, which are
    linked with most others. The other has the least hash."""
    cells = keys.select("node", "common", F.explode("keys").alias("key"))
    h = F.xxhash64("node")
    lead = materialise(cells.groupBy("key").agg(F.max_by("node", F.struct("common", h)).alias("x"), F.min_by("node", h).alias("y"), F.count("*").alias("n")).where("n > 1").drop("n"))
    sent = keys.sparkSession.sparkContext.broadcast(bit_map(lead, F.col("key").bitwiseAND(F.lit(BITS - 1))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = pc.list_flatten(batch.column("keys")), pc.list_parent_indices(batch.column("keys"))
            on = pa.array(_on(sent.value, key.to_numpy() & (BITS - 1)))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node").take(row.filter(on)), "key": key.filter(on)})

    few = keys.select("node", "keys").mapInArrow(tidy(keep), "node long, key long")  # most keys are one node's alone
    met = join_spread(few, lead, ["key"], "node")
    met = met.select("node", F.explode(F.array("x", "y")).alias("lead")).where("node <> lead").select(F.greatest("node", "lead").alias("src"), F.least("node", "lead").alias("dst"))
    return met.groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") >= MEETINGS).select("src", "dst")


def _prefixes(batch: pa.RecordBatch, nodes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a batch (row, at, prefix) that are on the map of nodes: the rows, and of each n-gram the hash, whose it is, and its place in the prefix."""
    batch = batch.filter(pa.array(_on(nodes, batch.column("at").to_numpy())))
    prefix = batch.column("prefix")
    tokens, of, first = pc.list_flatten(prefix).to_numpy(), pc.list_parent_indices(prefix).to_numpy(), prefix.offsets.to_numpy()
    return batch.column("row"), tokens.view(np.uint64), of, np.arange(len(tokens)) - (first[:-1] - first[0])[of]


def _repeated(rows: DataFrame, nodes: Broadcast, parts: int, bits: int) -> DataFrame:
    """(place): the last bits of the cuts of n-grams that two of rows (row, at, prefix) on the map of nodes have.

    A task sends a part its n-grams' cuts in ascending order, each twice at most, as packed differences: a few bytes an n-gram."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.sort(_prefixes(batch, nodes.value)[1])
            cut, part = (t >> _U(32 - parts)).astype(np.uint32), (t >> _U(32) >> _U(32 - parts)).astype(np.int64)
            third = np.zeros(len(t), bool)
            third[2:] = (cut[2:] == cut[:-2]) & (part[2:] == part[:-2])
            cut, part = cut[~third], part[~third]
            names, first = np.unique(part, return_index=True)
            each = np.split(cut, first[1:]) if len(names) else []
            packed = [_packed(np.diff(x, prepend=np.uint32(0))) for x in each]
            yield pa.RecordBatch.from_pydict({"part": pa.array(names, pa.int32()), "n": pa.array([len(x) for x in each], pa.int32()), "cuts": pa.array(packed, pa.binary())})

    def meet(sent: pa.Table) -> pa.Table:
        each = [np.cumsum(_unpacked(x, n.as_py(), np.uint32), dtype=np.uint32) for x, n in zip(sent["cuts"], sent["n"], strict=True)]
        cut = np.sort(np.concatenate(each))
        return pa.table({"place": pa.array(np.unique(cut[1:][cut[1:] == cut[:-1]] & np.uint32(bits - 1)), pa.int64())})

    return rows.mapInArrow(tidy(send), "part int, n int, cuts binary").groupBy("part").applyInArrow(meet, "place long")


def shared_tokens(sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, node, grp, n, pos), written: n-grams of prefixes that occur in more than one node, by their place in the prefix.

    Most n-grams of a prefix are in one text alone: those that aren't set a bit of a map each, and only rows on it are joined."""
    count = max(1, nodes.count())
    bits = min(max(1 << (BITS_A_NODE * count - 1).bit_length(), BITS), MOST_BITS)
    broadcast = sig.sparkSession.sparkContext.broadcast
    of_nodes = broadcast(bit_map(nodes, _place("node")))  # equal sets count once
    rows = sig.select("row", _place("row").alias("at"), "prefix")
    parts = min((count // NODES).bit_length(), PARTS)
    sent = broadcast(bit_map(_repeated(rows, of_nodes, parts, bits), F.col("place"), bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, tokens, of, pos = _prefixes(batch, of_nodes.value)
            on = np.flatnonzero(_on(sent.value, (tokens >> _U(32 - parts) & _U(bits - 1)).astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"node": node.take(pa.array(of[on])), "pos": pa.array(pos[on], pa.int32()), "token": pa.array(tokens[on].view(np.int64))})

    found = rows.mapInArrow(tidy(keep), "node long, pos int, token long")
    return materialise(found.join(nodes.select("node", "grp", "n"), "node").select("token", "node", "grp", "n", "pos"))


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least common part of linked sets of a and b n-grams."""
    return F.ceil(F.lit(percent) * (a + b) / (100 + percent))


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b n-grams are not too different in size to be linked."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def matrix_of(shared: DataFrame) -> DataFrame:
    """(token, grp, left, low, high): a row for each token and group: the least and greatest size of its members that have the
    token, and the most n-grams that one of them has from there on."""
    left = F.col("n") - F.col("pos")
    return shared.groupBy("token", "grp").agg(F.max(left).alias("left"), F.min("n").alias("low"), F.max("n").alias("high"))


def qualifying(matrix: DataFrame, percent: int) -> DataFrame:
    """(grp, to), grp < to: pairs of groups that may hold linked sets.

    Linked sets first meet at a token of both prefixes, and share no more than either has left there. A group counts
    once at a token, however many of its members have it."""
    a, b = ({c: F.col(f"{x}.{c}") for c in matrix.columns} for x in "ab")  # not renamed before they meet, so the matrix is dealt once for both
    sizes = (100 * a["high"] >= percent * b["low"]) & (100 * b["high"] >= percent * a["low"])
    on = (a["token"] == b["token"]) & (a["grp"] < b["grp"]) & sizes & (F.least(a["left"], b["left"]) >= _needed(a["low"], b["low"], percent))
    return matrix.alias("a").join(matrix.alias("b"), on).select(a["grp"], b["grp"].alias("to")).distinct()


def asking(pairs: DataFrame, shared: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(node, grp): of pairs (few, many) of groups, the nodes of few that may be linked with a member of many."""
    to = matrix.withColumnRenamed("grp", "many").join(pairs, "many", "left_semi").select("token", "many", F.col("left").alias("left_to"), "low", "high")
    n, left = F.col("n"), F.col("n") - F.col("pos")
    met = shared.join(pairs, F.col("grp") == F.col("few")).join(to, ["token", "many"])
    met = met.where((100 * F.col("high") >= percent * n) & (100 * n >= percent * F.col("low")) & (F.least(left, F.col("left_to")) >= _needed(n, F.col("low"), percent)))
    return met.select("node", F.col("many").alias("grp")).distinct()


def _tokens(sets: DataFrame) -> DataFrame:
    """sets with a row for each n-gram, token, of h."""
    at = F.explode(F.sequence(F.lit(1), F.length("h"), F.lit(8)))
    rest = [c for c in sets.columns if c != "h"]
    return sets.where(F.length("h") > 0).select(*rest, "h", at.alias("i")).select(*rest, F.substring("h", F.col("i"), F.lit(8)).alias("token"))


def held(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, grp), written: those rows of found (node, grp) where the union of the group's sets holds enough of the node's set to be linked with one of them.

    sets: (node, grp, n, h), the whole sets of found's nodes and of all members of its groups."""
    members = sets.join(found.select("grp").distinct(), "grp", "left_semi")
    union = _tokens(members.select("grp", "h")).distinct()
    low = members.groupBy("grp").agg(F.min("n").alias("low"))
    mine = _tokens(found.select("node", "grp").join(low, "grp").join(sets.select("node", "n", "h"), "node"))
    n = F.col("n")
    need = _needed(n, F.greatest("low", F.ceil(F.lit(percent) * n / 100)), percent)
    common = mine.join(union, ["grp", "token"]).groupBy("node", "grp", "n", "low").agg(F.count("*").alias("common"))
    return materialise(common.where(F.col("common") >= need).select("node", "grp"))


def met_in_cells(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst), written: nodes of found (node, grp) with members of the group that they are linked with, one of each cell.

    sets: as held() takes them. Nodes and members of a group are dealt into parts of about CELL n-grams; each part of the one meets each
    of the other in a cell, which is all that a task holds. The members are linked with each other by other ways, so one says as much as all."""
    asking_ = found.select(F.col("grp").alias("to"), "node").join(sets.select("node", "n", "h"), "node").withColumnRenamed("to", "grp")
    members = sets.join(found.select("grp").distinct(), "grp", "left_semi")
    parts = lambda df, c: df.groupBy("grp").agg(F.ceil(F.sum("n") / CELL).alias(c))
    of_grp = materialise(parts(asking_, "rows").join(parts(members, "cols"), "grp"))
    dealt = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).alias(c[0])
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(c[0])
    a = join_spread(asking_, of_grp, ["grp"], "node").select("grp", dealt("rows"), every("cols"), F.lit(True).alias("asks"), "node", "h")
    b = join_spread(members.select("grp", "node", "h"), of_grp, ["grp"], "node").select("grp", every("rows"), dealt("cols"), F.lit(False).alias("asks"), "node", "h")

    def meet(rows: pa.Table) -> pa.Table:
        ask, node = rows["asks"].to_numpy(), rows["node"].to_numpy()
        each = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows["h"]]
        here = np.flatnonzero(~ask)
        size = np.array([len(each[i]) for i in here], np.int64)
        token, owner = np.concatenate([each[i] for i in here] or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(here)), size)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        src, dst = [], []
        for i in np.flatnonzero(ask).tolist():
            first, n = np.searchsorted(token, each[i], "left"), np.searchsorted(token, each[i], "right")
            n -= first
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(here))
            on = np.flatnonzero(100 * common >= percent * (len(each[i]) + size - common))
            if len(on):
                src.append(node[i])
                dst.append(node[here[on[0]]])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    out = materialise(a.unionByName(b).groupBy("grp", "r", "c").applyInArrow(meet, "src long, dst long"))
    discard(of_grp)
    return out


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node, grp) with grp the component that links between nodes leave."""
    comps = connected_components(links.join(nodes.select(F.col("node").alias("src"), F.col("grp").alias("x")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("grp").alias("y")), "dst").select(F.col("x").alias("src"), F.col("y").alias("dst")))
    of_group = materialise(comps.select(F.col("node").alias("grp"), "component").where("grp <> component"))
    moved = join_spread(nodes, of_group, ["grp"], "node").select("node", F.col("component").alias("grp"))
    out = materialise(nodes.join(moved.withColumnRenamed("grp", "to"), "node", "left").withColumn("grp", F.coalesce("to", "grp")).drop("to"))
    discard(of_group)
    return out


def _known(sig: DataFrame, reps: DataFrame, known: DataFrame | None) -> DataFrame:
    """(src, dst): the nodes of both forms of a text, and those of the texts that known (src, dst) links by doc_id."""
    ends = reps.select("digest", "node")
    at = materialise(sig.where("n > 0").select("doc_id", "digest", "twin").join(ends, "digest").select("doc_id", "node", "twin"))
    out = at.where("twin is not null").join(ends.withColumnRenamed("node", "dst"), F.col("twin") == F.col("digest")).select(F.col("node").alias("src"), "dst")
    if known is None:
        return out
    a, b = (at.select(F.col("doc_id").alias(x), F.col("node").alias(f"n_{x}")) for x in ("src", "dst"))
    return out.union(known.select("src", "dst").join(a, "src").join(b, "dst").select("n_src", "n_dst"))


def components(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, bags: bool = False, both: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; others are ignored).

    A text's set are its distinct runs of n_words words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; of a text with fewer words,
    the whole sequence; with bags, repetitions count as well; with both, texts are linked by their sets or by their bags. Texts are linked when their sets' intersection is percent in a hundred of their union
    or more; component_id is the smallest doc_id reachable, itself included. Null, empty and blank texts
    have no n-gram and are linked with nothing: each row is its own component. Repeated rows give repeated results; a null doc_id gets its
    component's, null if there's no other; no rows give no rows. known: (src, dst), links of doc_ids that are there
already: their texts are in one group from the start.

    Equal sets count once. Sets that share keys meet leaders, and the components of the links found are the groups. Then
    groups are compared with groups by the matrix of tokens and groups. Two of one member are compared at once; of others the
    members of the smaller one are asked for. Each is compared with the larger one's member of the most common n-grams first. Those that are in another
    group still, and whose sets the union of the larger group holds well enough, meet all its members in cells of bounded size."""
    k = Grams(n_words, bags, both)
    sig = whole = materialise(signatures(docs, k, percent))
    reps = materialise(sig.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.first("common").alias("common"), F.first("keys").alias("keys")))
    pairs = materialise(first_pairs(reps.select("node", "common", "keys")))
    first = links = linked(docs, reps, pairs, k, percent)
    if both or known is not None:
        links = first.union(_known(sig, reps, known))
    nodes = _joined(reps.drop("keys").withColumn("grp", F.col("node")), links)
    shared = shared_tokens(sig, nodes)
    if both:
        sig = sig.where("row % 2 = 0")  # a bag is in its set's component
    rows = materialise(sig.select("row", "doc_id", "digest", "n"))
    discard(whole, pairs, first, reps)

    size = materialise(nodes.groupBy("grp").agg(F.count("*").alias("members"), F.min("node").alias("only"), F.max_by("node", F.struct("common", "node")).alias("lead")))
    matrix = materialise(matrix_of(shared))
    of_grp = lambda g, m, o: size.select(F.col("grp").alias(g), F.col("members").alias(m), F.col("only").alias(o))
    found = materialise(qualifying(matrix, percent).join(of_grp("grp", "members", "only"), "grp").join(of_grp("to", "members_to", "only_to"), "to"))
    alone = found.where("members = 1 and members_to = 1").select(F.col("only").alias("src"), F.col("only_to").alias("dst"))
    fewer = F.col("members") <= F.col("members_to")
    unlike = materialise(found.where("members > 1 or members_to > 1").select(F.when(fewer, F.col("grp")).otherwise(F.col("to")).alias("few"), F.when(fewer, F.col("to")).otherwise(F.col("grp")).alias("many")))
    several = materialise(asking(unlike, shared, matrix, percent).join(size.select("grp", "lead"), "grp"))
    discard(shared, matrix, unlike)
    tried = materialise(alone.union(several.select(F.col("node").alias("src"), F.col("lead").alias("dst"))))
    after = _joined(nodes, first := linked(docs, nodes, tried, k, percent))
    discard(size, found, tried, first)
    of = lambda c, x: after.select(F.col("node").alias(c), F.col("grp").alias(x))
    asked = materialise(several.join(of("node", "x"), "node").join(of("lead", "y"), "lead").where("x <> y").select("node", "grp"))
    if not asked.isEmpty():
        ends = asked.select("node").union(nodes.join(asked.select("grp").distinct(), "grp", "left_semi").select("node")).distinct()
        sets = sets_of(docs, nodes.join(ends, "node"), k, more=("grp", "n"))
        may = held(asked, sets, percent)
        found = met_in_cells(may, sets, percent)
        discard(sets, may)
        before, after = after, _joined(after, found)
        discard(before, found)
    discard(nodes, several, asked)

    ids = materialise(after.groupBy("grp").agg(F.min("least").alias("component_id")))
    of_digest = materialise(join_spread(after.select("node", "grp", "digest"), ids, ["grp"], "node").select("digest", "component_id"))
    discard(after, ids)
    some = join_spread(rows.where("n > 0"), of_digest, ["digest"], "row")
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").union(none)
