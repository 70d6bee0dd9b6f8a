"""Query of operator 10: surrogates for personal data in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm.pii import pseudonymise
from webloom.llm.registry import query, table

#: Key of the tests and checks; a job passes its own.
KEY = b"not a secret: key of the registered query"


@query("op10_surrogates")
def surrogates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY, found="entities").withColumn("n_entities", F.size("entities"))
