"""What Python workers do between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, a function of a partition's batches, that at its end returns the memory of batches that are gone.

    Workers wait for further tasks, also of other operators; what they keep counts against the executor."""

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied
