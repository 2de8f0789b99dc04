"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("timeline", "captions", "markers", "quality", "review", "projects")


def collect(attribute: str) -> dict:
    out = {}
    for name in MODULES:
        out.update(getattr(import_module(f"cuetable.checks.{name}"), attribute))
    return out
