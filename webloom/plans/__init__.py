"""Named queries over the driver's tables."""

from __future__ import annotations


def registered():
    """(queries, oracle SQL) of all query modules."""
    from webloom.plans import catalogue_queries, crawl_queries, inference_queries, registry, telemetry_queries  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
