"""Registered queries: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("prepare", "resample", "encoding", "evaluation", "modelling")


def registry() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(importlib.import_module(f"{__name__}.{name}").QUERIES)
    return found
