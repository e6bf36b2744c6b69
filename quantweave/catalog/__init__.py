"""Registered queries with their SQL checks."""

from __future__ import annotations

import importlib

MODULES = ["flagship", "technical", "recursive", "rolling", "candles", "scans", "filters", "joins",
           "aggregates", "structure", "fundamentals", "features", "labels", "limits", "signals",
           "scoring", "models", "streams", "blocks"]


def load() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"quantweave.catalog.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"quantweave.catalog.{m}":
                raise
