"""Memory of Python workers, which outlive tasks and even stages.

An executor keeps its idle workers, and each holds what its allocators have not given back and what
earlier stages cached. :func:`lean` wraps the function of a Python stage: caches of other stages go before
it starts, and freed memory returns to the system when it ends.
"""

from __future__ import annotations

import ctypes
import sys
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Modules of this package that keep engines with caches, by the name of the stage that uses them.
CACHED = ("pieces", "tokenstore", "token_alignment")
_last = [0.0]


def forget(owner: str = "") -> None:
    """Drop the engines of all stages but ``owner``."""
    for name in CACHED:
        module = sys.modules.get(f"{__package__}.{name}")
        if module is not None and name != owner:
            module._engines.clear()


def trim(pause: float = 1.0) -> None:
    """Give freed memory back; not again within ``pause`` seconds, because groups may be many and small."""
    now = time.monotonic()
    if now - _last[0] < pause:
        return
    _last[0] = now
    from . import textbytes

    textbytes.shrink()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work: Callable, owner: str = "") -> Callable:
    """For ``mapInArrow``: an iterator of batches in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        yield from work(batches)
        trim(0.0)

    return run


def lean_group(work: Callable) -> Callable:
    """For ``applyInArrow`` on one group, or on two that were brought together."""

    def one(table: pa.Table) -> pa.Table:
        forget()
        out = work(table)
        trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        out = work(left, right)
        trim()
        return out

    return two if work.__code__.co_argcount == 2 else one
