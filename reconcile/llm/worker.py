"""Memory of Python workers, which Spark keeps and gives to one operator after another."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa


class _Owner:
    name: str | None = None
    drop: Callable[[], None] | None = None


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Memory that is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def enter(name: str, drop: Callable[[], None] | None = None) -> None:
    """Called by tasks of operator ``name``: what another operator left in this worker goes.

    ``drop`` forgets what ``name`` itself leaves here for its next tasks.
    """
    if _Owner.name == name:
        return
    if _Owner.drop:
        _Owner.drop()
    _Owner.name, _Owner.drop = name, drop
    release()
