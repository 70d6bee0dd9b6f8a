"""Query of operator 8: all documents in length buckets and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm.packing import pack, words_in
from webloom.llm.registry import query, table


@query("op8_length_buckets")
def length_buckets(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack(docs, words_in(F.col("text")))
