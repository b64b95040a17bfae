"""Operators for language-model data on the catalogue's tables. Nothing outside imports this subpackage."""

from __future__ import annotations

from vitrine.registry import Registry

LLM = Registry()


def load() -> Registry:
    """Imports every query module of this subpackage once and returns its registry."""
    import vitrine.llm.queries  # noqa: F401

    return LLM
