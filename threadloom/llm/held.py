"""Large tables of a Python worker, which Spark keeps alive between tasks of different operators.

A worker holds the tables of one operator at a time: when another one begins, they go.  Large arrays
live in mappings of their own, so that what a task frees returns to the machine at once; the pages of
small ones, and those that Arrow's pool keeps, are given back when tables go and every few seconds.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable

import pyarrow as pa

_held: dict[object, object] = {}
#: Seconds between two returns of free pages; bytes from which an array has a mapping of its own.
EVERY, MAPPED = 5.0, 1 << 20
_M_MMAP_THRESHOLD = -3  # fixed value: glibc's number of this option
_last: float | None = None


def _return_pages(now_too: bool) -> None:
    global _last
    now = time.monotonic()
    if _last is not None and now - _last < EVERY and not now_too:
        return
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        if _last is None:
            libc.mallopt(_M_MMAP_THRESHOLD, MAPPED)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: its own allocator decides
        pass
    _last = now


def held(mark: object, make: Callable[[], object] | None = None):
    """What ``make`` gave for ``mark`` in this worker; what was held for any other mark is dropped."""
    if mark in _held:
        return _held[mark]
    dropped = bool(_held)
    if dropped:
        _held.clear()
        gc.collect()
    _return_pages(dropped)
    if make is not None:
        _held[mark] = make()
    return _held.get(mark)
