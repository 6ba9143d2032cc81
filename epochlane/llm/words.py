"""Words of many texts at a time, as places in their joined bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of the texts that are taken at a time; a longer text is taken alone.
RUN = 1 << 18


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes are in one of the ranges, ends included."""
    inside = np.zeros(256, bool)
    for first, last in ranges:
        inside[first : last + 1] = True
    return inside


#: Bytes of words `[^\x20\x09-\x0D]+`, and of words of digits, letters and all that isn't ASCII.
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Run:
    """Some texts in lower case (A-Z only), joined by spaces; words: their first bytes, ends and texts."""

    n_texts: int
    data: bytes
    first: np.ndarray
    end: np.ndarray
    text: np.ndarray

    @property
    def bytes_(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)

    def words_of_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)


def runs(texts: pa.Array, inside: np.ndarray) -> Iterator[Run]:
    """The texts of an Arrow array in their order, in runs of about RUN bytes; nulls count as empty."""
    some, size = [], 0
    for x in texts.cast(pa.binary()):
        some.append(x.as_py() or b"")
        size += len(some[-1])
        if size >= RUN:
            yield _run(some, inside)
            some, size = [], 0
    if some:
        yield _run(some, inside)


def _run(texts: list[bytes], inside: np.ndarray) -> Run:
    data = b" ".join(texts).translate(LOWER)
    on = np.zeros(len(data) + 2, np.int8)
    on[1:-1] = inside[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(on))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return Run(len(texts), data, edges[::2], edges[1::2], np.searchsorted(starts, edges[::2], "right") - 1)
