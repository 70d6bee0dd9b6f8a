"""Query of operator 4: quality of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm import gam
from webloom.llm.registry import query, table

THRESHOLD = 0.3


def remainder(key, n: int):
    return F.crc32(key.cast("string").cast("binary")) % n


@query("op4_quality")
def quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = gam.train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    scored = gam.score(docs.select("doc_id", "text"), model)
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
