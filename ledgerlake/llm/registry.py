"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("chat_format", "secrets", "pii", "decontaminate", "packing", "near_dedup", "substring_dedup", "toxicity", "telephony", "warc")


def _collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
