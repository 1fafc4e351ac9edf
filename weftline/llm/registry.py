"""Every query of the corpus operators, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("chat_format", "exact_dedup", "licenses", "mixing", "ngram_join", "pieces", "pii", "sharding", "topk", "toxicity")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"weftline.llm.{name}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
