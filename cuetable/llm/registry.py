"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("neighbours", "exact_dedup", "pii", "token_counts", "near_dedup", "repeats", "language", "packing", "line_dedup", "mixing", "spelling", "hard_negatives", "lexicon")


def collect(attribute: str) -> dict:
    out = {}
    for name in MODULES:
        out.update(getattr(import_module(f"cuetable.llm.{name}"), attribute))
    return out
