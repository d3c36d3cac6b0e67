"""Caches of Python workers. A worker serves the tasks of all stages, one after another, and keeps its modules' data:
of the caches here it holds one at a time, that of the operator whose task it runs."""

from __future__ import annotations

import ctypes

import pyarrow as pa

_held: dict = {}


def give_back() -> None:
    """What this worker has freed goes back to the system, as far as its allocators can tell: later stages' workers and the
    executor share the memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def own_cache(cache: dict, limit: int) -> dict:
    """``cache``, emptied if it has more than ``limit`` entries; another cache that this worker filled is emptied first."""
    global _held
    if _held is not cache:
        _held.clear()
        _held = cache
        give_back()
    if len(cache) > limit:
        cache.clear()
    return cache
