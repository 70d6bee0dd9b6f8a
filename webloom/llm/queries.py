"""All registered queries of this subpackage."""

from __future__ import annotations


def registered():
    """(queries, oracle SQL)."""
    from webloom.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13, registry  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
