"""What a Python worker keeps between tasks.

Workers serve one task after another, of any operator, and Spark keeps them for as long as tasks come. An operator's tables (a tokenizer's
remembered parts, word hashes' powers) are worth keeping for its next task, not for another operator's."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

_LAST = [""]
_DROPS: list[Callable[[], object]] = []


def kept(drop: Callable[[], object]) -> None:
    """Register how to drop a table that a module keeps."""
    _DROPS.append(drop)


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def serving(name: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task of operator ``name``: what another operator has kept goes first, and free memory goes back at the end."""

    def task(batches: Iterator) -> Iterator:
        if _LAST[0] != name:
            for drop in _DROPS:
                drop()
            gc.collect()
            trim()
            _LAST[0] = name
        yield from run(batches)
        trim()

    return task
