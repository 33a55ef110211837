"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import sys
import types

import pyarrow as pa

KEPT = "_tabloom_kept"


def once(key, make):
    """The value made for this key in this process, made at the first call.

    Task functions are pickled by value, so a dictionary of this module would come with each
    task anew; the values live in a module that exists in the worker only.
    """
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def trimmed(run):
    """The task function, after which freed memory goes back to the system: kept workers stay small."""

    def outer(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return outer
