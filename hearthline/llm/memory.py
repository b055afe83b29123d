"""Memory of Python tasks: what a task took goes back to the system when it ends.

Spark reuses Python workers, so memory that a task's allocators keep would add up over stages.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, a function of a partition's batches, with its memory given back at the end. The
    cycle collector rests meanwhile: tasks make many objects and no cycles."""

    @functools.wraps(run)
    def task(*args):
        pa.set_memory_pool(pa.system_memory_pool())
        gc.disable()
        try:
            yield from run(*args)
        finally:
            gc.enable()
            _trim()

    return task
