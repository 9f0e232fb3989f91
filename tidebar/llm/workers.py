"""What a Python worker keeps from task to task: one operator's tables at a time, bounded in bytes.

A worker serves the tasks of many operators in turn. hold() gives an operator its own tables and drops those of every
other, so that a chain of operators needs the memory of one. Each table starts anew once it has grown beyond LIMIT
bytes by its own count; two workers of an executor share its memory, so LIMIT is for one of two."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Bytes that one operator's tables may hold in one worker, by their own count.
LIMIT = 80_000_000
#: Bytes of a small str or bytes object with its place in a dict and a number beside it, without its characters.
ENTRY = 190

_HELD: dict[str, dict[Any, Any]] = {}


def give_back() -> None:
    """Returns freed memory to the system: what Python, Arrow and the C library keep for later is no use to other processes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def hold(operator: str, key: Any, make: Callable[[], Any]) -> Any:
    """The operator's table for key, made once in a worker. Tables of other operators, and of other keys, go."""
    own = _HELD.get(operator)
    if own is None or key not in own:
        _HELD.clear()
        give_back()
        _HELD[operator] = own = {key: make()}
    elif len(_HELD) > 1:
        _HELD.clear()
        _HELD[operator] = own
    return own[key]
