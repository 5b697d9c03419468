"""Queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "chat", "pii", "ngram_join", "decontam", "quality", "toxicity", "html_text", "ann", "passages", "align", "token_store", "prefix_trie")


def _gathered(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"talweg.llm.{name}"), what)
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracles() -> dict:
    return _gathered("ORACLES")
