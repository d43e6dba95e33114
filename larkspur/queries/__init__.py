"""Registered queries of the core, by topic."""

from __future__ import annotations

from larkspur.registry import Registry


def core() -> Registry:
    """All queries of the core."""
    from larkspur.queries import analytic, data_processing, dialect, other, relational, scalar

    registry = Registry()
    for module in (data_processing, relational, analytic, scalar, other, dialect):
        module.register(registry)
    return registry
