"""Removal of repeated byte strings by a distributed suffix sort over a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.llm.seeds import BASE, GRAM, OTHER, gram_hashes, sliding_min
from epochlane.operators.ranking import rank_column
from epochlane.operators.skew import join_spread
from epochlane.session import discard, materialise

LENGTH = 200
#: Characters of the suffix sort are words of this many bytes; names of triples of triples of
#: triples of words reach 216 bytes.
WORD = 8
#: A position is the piece's number times this, plus the byte offset.
SPAN = 1 << 16
ROWS_PER_TASK = 400_000
#: Starts of the stretches that runs are compared by.
PART = 16
#: Bytes that stand for the core that stretches share, and of a string of LENGTH bytes with its core so replaced: more
#: than three words, so the sort names triples of words and then, by recursion, triples of those names.
CORE, SHORT = 16, 16 + PART - 1


#: Columns that name a text.
T = ["t1", "t2"]


def _keys_of(text: Column) -> list[Column]:
    """Two hashes of 64 bits that stand for a text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit("another seed"), whole).alias("t2")]


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """One partition's rows; the callers' partitions have a bounded number of them."""
    got = list(batches)
    return pa.Table.from_batches(got) if got else None


def _longs(table: pa.Table, col: str) -> np.ndarray:
    return table.column(col).to_numpy()


def _hash(data: memoryview) -> int:
    return xxhash.xxh3_64_intdigest(data)


def text_runs(data: bytes) -> tuple[np.ndarray, ...]:
    """(h, a, n, m): runs of window starts whose least-hashed gram is the same and first stands at the same place.

    Run i has n starts from a on; h is the gram's hash and m the first place of it in each of these
    windows. Equal strings of LENGTH bytes lie in runs of equal h, at the same distance from m: a cut
    that follows the content. All windows of a run hold m, so it has LENGTH - GRAM + 1 starts at most."""
    grams = gram_hashes(np.frombuffer(data, np.uint8))
    low = sliding_min(grams, LENGTH - GRAM + 1)
    if not len(low):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    a = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.append(a[1:], len(low))
    h = low[a]
    known = np.unique(h)
    code = np.searchsorted(known, h)
    spot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    at = np.flatnonzero(known[spot] == grams)
    size = len(grams) + 1
    places = np.sort(spot[at] * size + at)
    first = np.searchsorted(places, code * size + a)
    count = np.searchsorted(places, code * size + end - 1 + LENGTH - GRAM, side="right") - first
    # one run for each place of the gram: the starts after the place before, up to this one
    i = np.repeat(np.arange(len(a)), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    m = places[first[i] + j] - code[i] * size
    lo = np.where(j == 0, a[i], np.maximum(a[i], np.concatenate(([0], m[:-1])) + 1))
    hi = np.minimum(end[i], m + 1)
    on = lo < hi
    return h[i][on], lo[on], (hi - lo)[on], m[on]


def runs(keyed: DataFrame) -> DataFrame:
    """(t1, t2, h, p, a, n, m): the runs of every text of keyed (t1, t2, text); p hashes a run's bytes, n + LENGTH - 1 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for t1, t2, text in zip(*(batch.column(c) for c in (*T, "text")), strict=True):
                data = (text.as_py() or "").encode()
                h, a, n, m = text_runs(data)
                view = memoryview(data)
                p = np.array([_hash(view[x:y]) for x, y in zip(a.tolist(), (a + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
                for x, v in zip(out, (np.full(len(a), t1.as_py()), np.full(len(a), t2.as_py()), h.view(np.int64), p.view(np.int64), a, n, m), strict=True):
                    x.append(v)
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*T, "h", "p", "a", "n", "m"])

    return keyed.select(*T, "text").mapInArrow(run, "t1 long, t2 long, h long, p long, a long, n long, m long")


def _one_of(*cols: str) -> list[Column]:
    """One row's values in a group, any one's: all are firsts of the same row. Plain numbers, so the grouping needs no sort."""
    return [F.first(c).alias(c) for c in cols]


def _in_several(*place: str) -> Column:
    """Whether a group has several places."""
    at = F.xxhash64(*place)
    return (F.min(at) != F.max(at)).alias("many")


def distinct_runs(rows: DataFrame) -> DataFrame:
    """(h, p, t1, t2, a, n, m, many, several): each different run once that may hold a repeated string, with one place of it.

    many: it is in two places, so all of it is repeated. several: there are other runs of its h, so
    parts of it may be elsewhere too."""
    each = materialise(rows.groupBy("h", "p").agg(*_one_of(*T, "a", "n", "m"), _in_several(*T, "a")))
    by_h = each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    # by_h has each h once; an h with very many different runs is split by the adaptive join
    out = materialise(each.join(by_h, "h", "left").withColumn("several", F.col("k").isNotNull()).drop("k").where("many or several"))
    discard(each)
    return out


def cut_runs(keyed: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, p, gram, piece): the bytes of the runs in wanted, from one row of each text, texts.one_id.

    gram: the place of the least-hashed gram in the piece."""
    of_text = wanted.groupBy(*T).agg(F.collect_list(F.struct("h", "p", "a", "n", (F.col("m") - F.col("a")).alias("gram"))).alias("runs"))
    asked = materialise(of_text.join(texts.select(*T, "one_id"), T).withColumnsRenamed({"t1": "u1", "t2": "u2"}))
    at = keyed.join(asked, (keyed["t1"] == asked["u1"]) & (keyed["t2"] == asked["u2"]) & keyed["doc_id"].eqNullSafe(asked["one_id"])).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, p, gram, piece = [], [], [], []
            for text, wanted in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = text.as_py().encode()
                for x, y, a, n, m in (r.values() for r in wanted.as_py()):
                    h.append(x), p.append(y), gram.append(m), piece.append(data[a : a + n + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(gram, pa.int64()), pa.array(piece, pa.binary())], names=["h", "p", "gram", "piece"])

    return at.mapInArrow(run, "h long, p long, gram long, piece binary")


def parts(pieces: DataFrame) -> DataFrame:
    """(h, p, k, core, v, lo, n, top): pieces in stretches of at most PART starts.

    Stretch k has the starts whose distance from the gram is k * PART and up to PART - 1 more, as far
    as they are in the piece. lo: its first start in the piece; v hashes its n + LENGTH - 1 bytes,
    core, from top on, those that the strings of a whole stretch share, and so any of them holds."""
    rest = LENGTH - PART + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            add = [c.append for c in cols]
            for h, p, gram, piece in zip(*(batch.column(c).to_pylist() for c in ("h", "p", "gram", "piece")), strict=True):
                data = memoryview(piece)
                x, total, top = 0, len(piece) - LENGTH + 1, gram % PART
                while x < total:
                    end = min(total, top + 1)
                    for put, v in zip(add, (h, p, (gram - top) // PART, xxhash.xxh3_128_digest(data[top : top + rest]), _hash(data[x : end + LENGTH - 1]) - (1 << 63), x, end - x, top), strict=True):
                        put(v)
                    x, top = end, top + PART
            kinds = [pa.binary() if i == 3 else pa.int64() for i in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["h", "p", "k", "core", "v", "lo", "n", "top"])

    return pieces.mapInArrow(run, "h long, p long, k long, core binary, v long, lo long, n long, top long")


def undecided(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is repeated for sure, (h, p, s, e) as bytes of a piece, and what a sort must decide, (h, p, s, piece, key); both written.

    Stretches that are equal as a whole are repeated. One whose core no other stretch at its
    distance has holds no repeated string. The others, one of each kind, are left to the sort with
    their cores replaced by names of CORE bytes, so that SHORT bytes stand for a string."""
    rows = materialise(parts(pieces))
    each = materialise(rows.groupBy("h", "k", "core", "v").agg(*_one_of("p", "lo", "n", "top"), _in_several("p", "lo")))
    cores = each.groupBy("h", "k", "core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = each.join(cores, ["h", "k", "core"]).select("h", "p", F.col("lo").alias("s"), "n", "top", "core")
    sure = rows.join(each.where("many").select("h", "k", "core", "v"), ["h", "k", "core", "v"]).select("h", "p", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + LENGTH - 1).alias("e"))
    left = "substring(piece, cast(s as int) + 1, cast(top - s as int))"
    right = f"substring(piece, cast(top as int) + {LENGTH - PART + 2}, cast(s + n - 1 - top as int) + {PART - 1})"
    some = pieces.join(open_, ["h", "p"]).select("h", "p", "s", F.expr(f"concat({left}, core, {right})").alias("piece"))
    sure, some = materialise(sure), materialise(some.withColumn("key", F.substring(F.unhex(F.sha2("piece", 256)), 1, 16)))
    discard(rows, each)
    return sure, some


def _tasks(n: int) -> int:
    return max(1, -(-n // ROWS_PER_TASK))


class Joined:
    """Pieces one after another in one array, so that one call serves many: zeros follow each, PAD of them.

    piece, local: for each place the number of its piece and its place in it."""

    PAD = 4 * WORD

    def __init__(self, pieces: list[bytes]) -> None:
        gap = bytes(self.PAD)
        self.data = np.frombuffer(gap.join([*pieces, b""]), np.uint8)
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.length + self.PAD) - self.length - self.PAD
        self.piece = np.repeat(np.arange(len(pieces)), self.length + self.PAD)
        self.local = np.arange(len(self.data)) - self.start[self.piece]

    def places(self, length: int) -> np.ndarray:
        """The places at which `length` bytes of a piece start."""
        return np.flatnonzero(self.local <= self.length[self.piece] - length)


def _by_bytes(columns: list[list], sizes: list[int], most: int = 1 << 21) -> Iterator[list[list]]:
    """Slices of parallel columns with about `most` bytes each."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most or i + 1 == len(sizes):
            yield [c[lo : i + 1] for c in columns]
            lo, held = i + 1, 0


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, with at least so many after it, as a signed long that sorts as the bytes do."""
    every = np.lib.stride_tricks.sliding_window_view(data, WORD)[at]
    return (np.ascontiguousarray(every).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _sorted_blocks(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df, written, in the order of keys and pos, with pid, blk and edge.

    Rows are dealt by range of (keys, pos), so even equal keys spread over tasks. blk numbers the
    blocks of equal keys in a task; edge marks a task's first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            x = _longs(table, k)
            new[1:] |= x[1:] != x[:-1]
        edge = np.zeros(table.num_rows, bool)
        edge[[0, -1]] = True
        out = table.append_column("pid", pa.array(np.full(table.num_rows, TaskContext.get().partitionId()), pa.int64())).append_column("blk", pa.array(np.cumsum(new))).append_column("edge", pa.array(edge))
        yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    ranged = df.repartitionByRange(_tasks(n), *keys, "pos").sortWithinPartitions(*keys, "pos")
    fields = ", ".join(f"{c} long" for c in df.columns)
    return materialise(ranged.mapInArrow(run, f"{fields}, pid long, blk long, edge boolean"))


def name(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(pos, name), written: whole numbers in the order of keys, equal for equal keys.

    A block that runs over into the next task keeps the name of its start; that takes one row a task."""
    at = _sorted_blocks(df, keys, n)
    ends = at.where("edge").groupBy("pid").agg(F.min(F.struct("blk", *keys)).alias("a"), F.max(F.struct("blk", *keys)).alias("b"))
    w = Window.partitionBy(F.lit(0)).orderBy("pid")
    before = F.lag("b").over(w)
    same = F.coalesce(F.lit(True) & F.reduce(F.array(*[F.col(f"a.{k}") == before[k] for k in keys]), F.lit(True), lambda x, y: x & y), F.lit(False))
    own = lambda blk: F.shiftleft(F.col("pid"), 32).bitwiseOR(blk)
    ends = ends.withColumn("same", same).withColumn("out", F.when((F.col("b.blk") > 0) | ~F.col("same"), own(F.col("b.blk"))))
    ends = ends.withColumn("last", F.last("out", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).select("pid", F.when(F.col("same"), F.col("last")).otherwise(own(F.lit(0).cast("long"))).alias("first"))
    out = materialise(at.join(ends, "pid").select("pos", F.when(F.col("blk") == 0, F.col("first")).otherwise(own(F.col("blk"))).alias("name")))
    discard(at)
    return out


def _triples(named: DataFrame, step: int, n: int) -> DataFrame:
    """(pos, a, b, c): the names at pos, pos + step and pos + 2 step of the same piece; -1 beyond its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        order = np.argsort(_longs(table, "pos"))
        pos, names = _longs(table, "pos")[order], _longs(table, "name")[order]
        cols = [names]
        for far in (pos + step, pos + 2 * step):
            spot = np.minimum(np.searchsorted(pos, far), len(pos) - 1)
            cols.append(np.where((pos[spot] == far) & (far // SPAN == pos // SPAN), names[spot], -1))
        out = pa.Table.from_arrays([pa.array(x) for x in (pos, *cols)], names=["pos", "a", "b", "c"])
        yield from out.to_batches(max_chunksize=100_000)

    piece = F.floor(F.col("pos") / SPAN)
    return named.withColumn("_piece", piece).repartition(_tasks(n), "_piece").select("pos", "name").mapInArrow(run, "pos long, a long, b long, c long")


def repeated_starts(pieces: DataFrame, n: int, length: int = LENGTH) -> DataFrame:
    """(pos): starts of strings of `length` bytes, at most 27 words, that another start in pieces has as well.

    pieces: a written table (rid, piece) of distinct rows with n bytes in all. A suffix is a string
    of words, one of eight by the start's remainder; its words are counted modulo 3.
    1. The sampled suffixes, those whose word number is 1 or 2 modulo 3, get names by sorting
       their triples of words (24 bytes).
    2. Their strings of names are sorted in the same way, by recursion: names of three names (72 bytes), and of
       three of those (216 bytes), as far as length needs; strings with names for cores need the first of these.
    3. The others are merged in: suffixes of classes 0 and 1 are ordered by (word, name of the
       next), of classes 0 and 2 by (word, word, name of the one after), of classes 1 and 2 by name.
    4. In each order neighbours' prefixes of length bytes are compared, by 128-bit fingerprints.
    Any two equal prefixes are of two classes that one of the orders holds, with only equal
    prefixes between them. Every step is a sort or a regrouping by piece; no task holds more than
    ROWS_PER_TASK rows or the positions of its pieces."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("piece").to_pylist()
            for rid, some in _by_bytes([batch.column("rid").to_pylist(), every], list(map(len, every))):
                text = Joined(some)
                at = text.places(1)
                at = at[(text.local[at] // WORD) % 3 != 0]
                cols = [text.local[at] + np.array(rid)[text.piece[at]] * SPAN, *[_words(text.data, at + i * WORD) for i in range(3)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["pos", "a", "b", "c"])

    abc = ["a", "b", "c"]
    names = name(pieces.mapInArrow(sampled, "pos long, a long, b long, c long"), abc, n)
    for step in (3 * WORD, 9 * WORD):
        if step < length:
            names, before = name(_triples(names, step, n), abc, n), names
            discard(before)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        order = np.argsort(_longs(table, "pos"))
        pos, got = _longs(table, "pos")[order], _longs(table, "name")[order]
        cuts = np.flatnonzero(np.concatenate(([True], pos[1:] // SPAN != pos[:-1] // SPAN, [True])))
        for lo in range(0, len(cuts) - 1, 5000):
            own = cuts[lo : lo + 5001]
            ends = pa.array((own - own[0]).astype(np.int32))
            at, named = pos[own[0] : own[-1]], got[own[0] : own[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(at[own[:-1] - own[0]] // SPAN), pa.ListArray.from_arrays(ends, pa.array((at % SPAN).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(named))], names=["rid", "at", "names"])

    packed = names.withColumn("_piece", F.floor(F.col("pos") / SPAN)).repartition(_tasks(n), "_piece").select("pos", "name").mapInArrow(gather, "rid long, at array<int>, names array<long>")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("piece").to_pylist()
            places, got = ([x.values.to_numpy() for x in batch.column(c)] for c in ("at", "names"))
            for rid, some, at, names in _by_bytes([batch.column("rid").to_pylist(), every, places, got], list(map(len, every))):
                text = Joined(some)
                of = np.full(len(text.data), -1)
                of[np.concatenate(at) + np.repeat(text.start, list(map(len, at)))] = np.concatenate(names)
                p = text.places(length)
                kind = (text.local[p] // WORD) % 3
                f, g = (gram_hashes(text.data, length, base)[p].view(np.int64) for base in (BASE, OTHER))
                zero = np.zeros(len(p), np.int64)
                pos = text.local[p] + np.array(rid)[text.piece[p]] * SPAN
                w, v = _words(text.data, p), _words(text.data, p + WORD)
                for o, out, keys in ((0, 2, (w, of[p + WORD], zero)), (1, 1, (w, v, of[p + 2 * WORD])), (2, 0, (of[p], zero, zero))):
                    on = kind != out
                    cols = [np.full(int(on.sum()), o), *[k[on] for k in keys], pos[on], f[on], g[on]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["o", *abc, "pos", "f", "g"])

    rows = pieces.join(packed, "rid").mapInArrow(orders, "o long, a long, b long, c long, pos long, f long, g long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        o, f, g, pos = (_longs(table, c) for c in ("o", "f", "g", "pos"))
        same = (o[1:] == o[:-1]) & (f[1:] == f[:-1]) & (g[1:] == g[:-1])
        hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hit_or_edge = hit.copy()
        hit_or_edge[[0, -1]] = True
        edge = np.full(len(o), -1)
        edge[-1] = 1
        edge[0] = 0 if len(o) > 1 else 2
        out = pa.table({"pid": np.full(len(o), TaskContext.get().partitionId()), "edge": edge, "hit": hit, "o": o, "f": f, "g": g, "pos": pos}).filter(pa.array(hit_or_edge))
        yield from out.to_batches(max_chunksize=100_000)

    found = rows.repartitionByRange(_tasks(2 * n), "o", *abc, "pos").sortWithinPartitions("o", *abc, "pos").mapInArrow(compare, "pid long, edge long, hit boolean, o long, f long, g long, pos long")
    found = materialise(found)
    # the last row of a task and the first of the next are neighbours too: at most two rows a task
    w = Window.partitionBy(F.lit(0)).orderBy("pid", "edge")
    ends = found.where("edge >= 0")
    near = F.struct("o", "f", "g")
    across = ends.select("pos", ((F.lag(near).over(w) == near) | (F.lead(near).over(w) == near)).alias("hit")).where("hit").select("pos")
    return found.where("hit").select("pos").union(across).distinct()


def repeated_in(keyed: DataFrame, length: int) -> DataFrame:
    """(h, p, s, e): the repeated bytes of keyed (h, p, s, piece, key: a digest of piece), which start at s of a run, by the suffix sort.

    length: the bytes of a piece that stand for a string of LENGTH bytes."""
    distinct = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first("piece").alias("piece"))
    distinct = materialise(rank_column(distinct, [F.col("key")], "rid"))
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    starts = repeated_starts(distinct.select("rid", "piece"), total, length)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        pos = np.sort(_longs(table, "pos"))
        cut = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
        lo = pos[cut]
        hi = pos[np.append(np.flatnonzero(cut)[1:] - 1, len(pos) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lo // SPAN, lo % SPAN, hi % SPAN + LENGTH)], names=["rid", "a", "b"])

    found = starts.withColumn("_piece", F.floor(F.col("pos") / SPAN)).repartition(_tasks(total), "_piece").select("pos").mapInArrow(stretches, "rid long, a long, b long")
    of_key = found.join(distinct.select("rid", "key", "n"), "rid").where("n = 1").select("key", "a", "b")
    of_key = of_key.union(distinct.where("n > 1").select("key", F.lit(0).cast("long"), F.octet_length("piece").cast("long") - length + LENGTH))
    return keyed.select("h", "p", "s", "key").join(of_key, "key").select("h", "p", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b")).alias("e"))


def repeats(keyed: DataFrame) -> DataFrame:
    """(t1, t2, n, spans): for each distinct text of keyed (t1, t2, doc_id, text) its number of rows and the bytes [a, b) to remove.

    Texts fall into runs that follow the content, so repeated text gives equal runs, and those count
    once from there on; what runs share only in part goes into the suffix sort."""
    rows = materialise(runs(keyed))
    found = distinct_runs(rows)
    texts = materialise(keyed.groupBy(*T).agg(F.count("*").alias("n"), F.min("doc_id").alias("one_id")))
    pieces = materialise(cut_runs(keyed, texts, found.where("several")))
    sure, short = undecided(pieces)
    discard(pieces)
    whole = found.where("many").select("h", "p", F.lit(0).cast("long").alias("s"), (F.col("n") + LENGTH - 1).alias("e"))
    spans = materialise(sure.union(repeated_in(short, SHORT)).union(whole).groupBy("h", "p").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    # spans has each run once; a run that very many texts hold is split by the adaptive join
    at = rows.join(spans, ["h", "p"]).select(*T, F.explode(F.transform("spans", lambda x: F.struct((x["s"] + F.col("a")).alias("a"), (x["e"] + F.col("a")).alias("b")))).alias("span"))
    of_text = at.groupBy(*T).agg(F.collect_set("span").alias("spans"))
    return texts.select(*T, "n").join(of_text, T, "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs (doc_id, text).

    Removed is every byte covered by a string of LENGTH bytes that also starts elsewhere, in any
    row or in the same; strings are judged on the input and never cross rows. A null text counts
    as empty. A text of LENGTH bytes or more that several rows have, repeated rows included, goes
    whole. n_spans counts maximal removed runs. Extra columns are ignored; an empty table gives an
    empty table. The bytes that are kept may end inside a character."""
    keyed = docs.select("doc_id", "text", *_keys_of(F.col("text")))
    of_text = materialise(repeats(keyed))
    at = join_spread(keyed, of_text, T, "doc_id").select("doc_id", "text", "n", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, n, spans in zip(*(batch.column(c) for c in ("text", "n", "spans")), strict=True):
                data = (text.as_py() or "").encode()
                found = (len(data), 0, 0, data)
                if n.as_py() > 1 and len(data) >= LENGTH:
                    found = (len(data), len(data), 1, b"")
                elif spans.is_valid:
                    cover = np.zeros(len(data) + 1, np.int32)
                    for s in spans.as_py():
                        cover[s["a"]] += 1
                        cover[s["b"]] -= 1
                    gone = np.cumsum(cover)[:-1] > 0
                    edges = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
                    found = (len(data), int(gone.sum()), edges, np.frombuffer(data, np.uint8)[~gone].tobytes())
                for x, v in zip(out, found, strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in zip(("n_bytes", "n_removed", "n_spans"), out, strict=False)}, "kept": pa.array(out[3], pa.binary())})

    return at.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")
