"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("byte_bpe", "lm_scoring", "ngram_join", "packing", "quality", "sharding", "substring_dedup", "token_files", "url_filter", "voronoi_knn")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").ORACLE_SQL
    return out
