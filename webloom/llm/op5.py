"""Query of operator 5: benchmark passages in all documents."""

from __future__ import annotations

from webloom.llm.decontam import leaks
from webloom.llm.registry import query, table


@query("op5_benchmark_leaks")
def benchmark_leaks(spark, folder):
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
