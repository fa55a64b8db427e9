"""Registered queries, by section."""

from __future__ import annotations

from types import ModuleType


def load() -> ModuleType:
    """The registry with all sections in it."""
    from tallybox.plans import audit_queries, fusion_queries, join_queries, metric_queries, projections, rank_queries, registry, source_queries, tile_queries  # noqa: F401

    return registry
