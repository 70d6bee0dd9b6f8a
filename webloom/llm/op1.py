"""Query of operator 1: near duplicates of all documents by four-word shingles."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm.neardup import near_duplicates
from webloom.llm.registry import query, table


@query("op1_near_duplicates")
def near_duplicate_documents(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"), size=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
