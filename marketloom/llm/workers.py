"""Memory of Python workers, which outlive their tasks and serve one operator after another."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}  # what drops an operator's caches in this worker


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Keep an operator's caches from task to task until another operator's task begins here."""
    _held[owner] = drop


def begin(owner: str) -> None:
    """Drop what operators other than ``owner`` hold in this worker."""
    for other in [x for x in _held if x != owner]:
        _held.pop(other)()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, without the caches of other operators, its memory given back at the task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        yield from run(batches)
        give_back()

    return whole
