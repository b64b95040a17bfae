"""The runnable queries outside the subpackage llm."""

from __future__ import annotations

from vitrine.registry import Registry

CORE = Registry()


def load() -> Registry:
    """Imports every query module once and returns the registry."""
    import vitrine.queries.ingest
    import vitrine.queries.learning
    import vitrine.queries.personal
    import vitrine.queries.pipeline
    import vitrine.queries.recommend
    import vitrine.queries.relational
    import vitrine.queries.search
    import vitrine.queries.stream  # noqa: F401

    return CORE
