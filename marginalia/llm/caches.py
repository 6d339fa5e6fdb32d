"""Worker-wide dictionaries of words, of which only the running operator's stay filled.

Python workers outlive a stage. Without this, a pipeline's stages would leave a full cache each.
"""

from __future__ import annotations

import ctypes
import gc

_all: list[dict] = []


def register(cache: dict) -> dict:
    _all.append(cache)
    return cache


def use(*caches: dict) -> None:
    """Empties every registered cache but these, and gives what they took back to the system."""
    full = [c for c in _all if not any(c is own for own in caches) and (len(c) if isinstance(c, dict) else c.size())]
    for c in full:
        c.clear()
    if full:
        trim()


def trim() -> None:
    """Free pages go back to the system, where its C library can do that."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
