"""One large object for each Python worker: tables and caches of the operator that runs there now."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def resident(key: Any, build: Callable[[], Any]) -> Any:
    """The worker's object for ``key``; built where it isn't there, in the place of any other operator's.

    Spark keeps Python workers between stages, so what one operator leaves behind would add to the next one's memory. The other
    object is collected before the new one is built, also where it refers to itself, and Arrow gives back what it holds unused.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = build()
    return _held[key]
