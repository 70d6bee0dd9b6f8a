"""Query of operator 9: language of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm import langid
from webloom.llm.op4 import remainder
from webloom.llm.registry import query, table


@query("op9_language")
def language(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "rejected")
