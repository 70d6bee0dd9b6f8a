"""The URL functions and the page shredder under SQL names, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from webloom.functions import urls
from webloom.sources.htmltree import PARSERS

_SCALARS = {
    "canonical_url(x STRING)": ("STRING", urls.canonical_sql("x")),
    "resolve_url(page STRING, link STRING)": ("STRING", urls.resolve_sql("page", "link")),
    "is_http(x STRING)": ("BOOLEAN", urls.is_http_sql("x")),
    "host_of(x STRING)": ("STRING", urls.host_sql("x")),
}


def register_functions(spark: SparkSession) -> None:
    """Temporary functions canonical_url, resolve_url, is_http, host_of, shred_page, shred_page_html."""
    for head, (kind, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("shred_page", PARSERS[False])
    spark.udf.register("shred_page_html", PARSERS[True])
