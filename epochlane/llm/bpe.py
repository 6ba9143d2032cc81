"""Byte-level BPE: encoding by a segment tree over pair ranks, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from epochlane.llm.workers import tidy

#: Fixed values of the vocabulary's pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, where the classes are these letters, digits and blanks.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pieces that a task remembers at least before it lets older ones go, and the letters of one at most.
MEMO, MEMO_LETTERS = 80_000, 128
#: Letters of the texts that are cut at a time, and leaves of the largest trees that are merged in step.
CHUNK, MOST_LEAVES = 1 << 20, 64
NONE = 1 << 62
ID_MASK = (1 << 20) - 1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and the byte.

    Printable Latin-1 bytes stand for themselves, the others take the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def pair_key(a: int, b: int) -> int:
    return a << 20 | b


def merge_value(rank: int, merged: int) -> int:
    """A whole number in the order of ranks that holds the merged id too."""
    return rank << 20 | merged


def library_pieces(text: str) -> list[str]:
    """The pieces as the tokenizers library cuts them; slower than a pattern."""
    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


@cache
def odd_characters() -> str:
    """Characters that PIECES and the library class differently, as they know different Unicode versions."""
    split = regex.compile(PIECES).findall

    def differ(codes: list[int]) -> bool:
        text = "".join(f"a{chr(c)}{chr(c)}1" for c in codes)
        return split(text) != library_pieces(text)

    # planes 4 to 13 have no characters in any version, and 15 and 16 are for private use
    every = [c for c in (*range(1, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000))]
    blocks = [every[at : at + 256] for at in range(0, len(every), 256)]
    return "".join(chr(c) for block in blocks if differ(block) for c in block if differ([c]))


@dataclass
class Vocabulary:
    """What encoding needs of a vocabulary file."""

    byte_ids: list[int]
    merges: dict[int, int]
    tokens: dict[int, bytes]
    special: dict[str, int]

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        data = json.loads(text)
        ids, letters = data["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        of_byte = {b: c for c, b in letters.items()}
        merges = {pair_key(ids[a], ids[b]): merge_value(rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        return cls([ids[of_byte[b]] for b in range(256)], merges, tokens, special)


def merge_piece(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge until no pair is mergeable, each time the leftmost pair of the lowest rank.

    merges: pair_key() of two symbols to merge_value() of their merge. Leaf i of the tree holds the
    value of the pair that starts at symbol i, each inner node the least below it. The root shows
    whether a pair is left; going down, left first, finds it; a merge changes three leaves and the
    nodes above them. `symbols` is used up."""
    n = len(symbols)
    if n < 2:
        return symbols
    size, get = 1 << (n - 2).bit_length(), merges.get
    tree = [NONE] * (2 * size)
    tree[size : size + n - 1] = [get(a << 20 | b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != NONE:
        at = 1
        while at < size:
            at += at
            if tree[at] != least:
                at += 1
        i = at - size
        j = after[i]
        merged = symbols[i] = least & ID_MASK
        k = after[i] = after[j]
        symbols[j] = -1
        if k < n:
            before[k] = i
            tree[size + j] = NONE
            tree[at] = get(merged << 20 | symbols[k], NONE)
        else:
            tree[at] = NONE
            j = i
        h = before[i]
        if h >= 0:
            tree[size + h] = get(symbols[h] << 20 | merged, NONE)
        else:
            h = i
        # the nodes above the changed leaves, level by level; neighbours soon share them
        left, right, at = size + h >> 1, size + j >> 1, at >> 1
        while at:
            a, b = tree[at + at], tree[at + at + 1]
            tree[at] = a if a <= b else b
            if left != at:
                a, b = tree[left + left], tree[left + left + 1]
                tree[left] = a if a <= b else b
            if right != at:
                a, b = tree[right + right], tree[right + right + 1]
                tree[right] = a if a <= b else b
            left, right, at = left >> 1, right >> 1, at >> 1
    return [s for s in symbols if s >= 0]


class PairTable:
    """Merge values of pairs as two arrays with open addressing, for many look-ups at a time."""

    def __init__(self, merges: dict[int, int]) -> None:
        keys = np.fromiter(merges, np.int64, len(merges))
        values = np.fromiter(merges.values(), np.int64, len(merges))
        self.bits = max(4, (8 * len(merges)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            self.keys[slot[free[one]]], self.values[slot[free[one]]] = keys[free[one]], values[free[one]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge values of the pairs a, b; NONE where there is no merge or a symbol is negative."""
        keys = (a << 20) | b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


def merge_in_step(symbols: np.ndarray, pairs: PairTable) -> np.ndarray:
    """merge_piece() for many pieces at once: row by row the ids, -1 where nothing is left.

    symbols: a row a piece, its byte ids and then -1; one column more than a power of two, the number
    of leaves. Each round every unfinished piece goes down its own tree, merges once, and the changed
    leaves and the nodes above them are set anew."""
    n, width = symbols.shape
    size = width - 1
    depth = size.bit_length() - 1
    symbols = np.concatenate((symbols, np.full((n, 1), -1)), axis=1)  # column `width` stands for the end
    tree = np.full((n, 2 * size), NONE)
    tree[:, size:] = pairs.get(symbols[:, :size].ravel(), symbols[:, 1:width].ravel()).reshape(n, size)
    for level in range(depth - 1, -1, -1):
        lo = 1 << level
        np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2], out=tree[:, lo : 2 * lo])
    after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
    after[:, width] = width
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        least, at = tree[rows, 1], np.ones(len(rows), np.int64)
        for _ in range(depth):
            at *= 2
            at += tree[rows, at] != least
        i = at - size
        j = after[rows, i]
        k = after[rows, j]
        merged = least & ID_MASK
        symbols[rows, i], symbols[rows, j] = merged, -1
        after[rows, i], before[rows, k] = k, i
        h = before[rows, i]
        first = h < 0
        h[first] = i[first]
        over = j >= size  # the last symbol starts no pair
        tree[rows, size + np.where(over, i, j)] = NONE
        tree[rows, at] = pairs.get(merged, symbols[rows, k])
        tree[rows[~first], size + h[~first]] = pairs.get(symbols[rows[~first], h[~first]], merged[~first])
        changed = [at, size + h, size + np.where(over, i, j)]
        for _ in range(depth):
            for c in changed:
                c >>= 1
                tree[rows, c] = np.minimum(tree[rows, 2 * c], tree[rows, 2 * c + 1])
        rows = rows[tree[rows, 1] != NONE]
    return symbols


class Codec:
    """Encodes and decodes whole texts. It remembers pieces, at most MEMO older ones and MEMO and a chunk's new ones."""

    def __init__(self, words: Vocabulary, odd: str) -> None:
        self.words = words
        self.pieces, self.ascii_pieces = regex.compile(PIECES).findall, re.compile(ASCII_PIECES, re.ASCII).findall
        self.odd = frozenset(odd)
        assert min(odd, default="\x80") > "\x7f", "ASCII is taken for known"
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(words.special, key=len, reverse=True))) + ")") if words.special else None
        self.pairs, self.byte_ids = PairTable(words.merges), np.array(words.byte_ids)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _entry(self, piece: str, ids: list[int]) -> tuple[str, str]:
        """The ids, joined by commas, and the text that they decode to: whole characters, as every piece is encoded from such."""
        tokens = self.words.tokens
        text = b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")
        return ",".join(map(str, ids)), piece if text == piece else text  # one object where they are equal

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known, those with equally large trees in step."""
        if len(self.known) > MEMO:
            self.known, self.old = {}, self.known
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces - self.known.keys():
            if (found := self.old.get(piece)) is not None:
                self.known[piece] = found
                continue
            data = piece.encode()
            sizes.setdefault(1 << max(0, len(data) - 2).bit_length(), []).append((piece, data))
        for size, of in sizes.items():
            if size > MOST_LEAVES:
                for piece, data in of:
                    self.known[piece] = self._entry(piece, merge_piece(self.byte_ids[list(data)].tolist(), self.words.merges))
                continue
            raw = np.frombuffer(b"".join([data.ljust(size + 1, b"\0") for _, data in of]), np.uint8).reshape(-1, size + 1)
            length = np.fromiter((len(data) for _, data in of), np.int64, len(of))
            done = merge_in_step(np.where(np.arange(size + 1) < length[:, None], self.byte_ids[raw], -1), self.pairs)
            left = done >= 0
            flat, end = done[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
            for (piece, _), a, b in zip(of, [0, *end[:-1]], end, strict=True):
                self.known[piece] = self._entry(piece, flat[a:b])

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_pieces(text)
        if not self.odd.isdisjoint(text):
            return library_pieces(text)
        return self.pieces(text)

    def encode(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """For each text and piece the ids, joined by commas, and what they decode to; special tokens of the vocabulary are pieces of their own."""
        special = self.words.special
        cut = [[self.split(part) if k % 2 == 0 else part for k, part in enumerate(self.special.split(t))] if self.special is not None and any(s in t for s in special) else [self.split(t)] for t in texts]
        self.learn({piece for parts in cut for pieces in parts[::2] for piece in pieces})
        known = self.known
        out = []
        for parts in cut:
            found = list(map(known.__getitem__, parts[0]))
            for name, pieces in zip(parts[1::2], parts[2::2], strict=True):
                found += [self._entry(name, [special[name]]), *map(known.__getitem__, pieces)]
            out.append(found)
        for piece in [p for p in known if len(p) > MEMO_LETTERS]:
            del known[piece]
        return out

    @staticmethod
    def decode(encoded: list[tuple[str, str]]) -> str:
        return "".join([x[1] for x in encoded])


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about CHUNK letters."""
    run, n = [], 0
    for text in texts:
        run.append(text)
        n += len(text)
        if n >= CHUNK:
            yield run
            run, n = [], 0
    if run:
        yield run


@lru_cache(maxsize=1)
def _codec(vocabulary: str, odd: str) -> Codec:
    """The codec of a Python worker; its vocabulary, of fixed size, is kept for the worker's later tasks."""
    return Codec(Vocabulary.parse(vocabulary), odd)


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and the ids if asked for.

    docs: doc_id and text; other columns are ignored. vocabulary: path of the file, read
    on the driver; its bytes, of fixed size, go to the executors. A null text counts as
    empty: no token, the digests of nothing. Texts are taken one by one, in Arrow batches
    of their partition, so nothing is shuffled; repeated rows give repeated results.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), odd_characters()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        sha = hashlib.sha256
        for batch in batches:
            out: dict[str, list] = {"n": [], "i": [], "d": [], "ids": []}
            for run in chunks([t.as_py() or "" for t in batch.column("text")]):
                for parts in codec.encode(run):
                    ids = ",".join([x[0] for x in parts])
                    out["n"].append(ids.count(",") + 1 if ids else 0)
                    out["i"].append(sha(ids.encode()).hexdigest())
                    out["d"].append(sha(codec.decode(parts).encode()).hexdigest())
                    if with_ids:
                        out["ids"].append([int(x) for x in ids.split(",")] if ids else [])
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["i"], pa.string()), "decoded_sha256": pa.array(out["d"], pa.string())}
            if with_ids:
                cols["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)
        codec.forget()  # an idle worker holds no memo

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(encode), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
