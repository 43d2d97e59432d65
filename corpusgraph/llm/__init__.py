"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["near_duplicates", "repeated_lines", "splitting", "encoding", "packing", "subjects"]


def query_modules() -> list:
    """The modules with QUERIES and SQL."""
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
