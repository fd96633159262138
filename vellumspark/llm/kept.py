"""Tables that a Python worker keeps between tasks. They belong to the operator that ran last: when another one asks,
those of the others go, so that a worker that serves several operators holds one operator's tables."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]
