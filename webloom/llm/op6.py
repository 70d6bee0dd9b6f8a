"""Query of operator 6: all pages as WARC archives, read back."""

from __future__ import annotations

from webloom.llm import warc
from webloom.llm.common import work_folder
from webloom.llm.registry import query, table


@query("op6_warc_round_trip")
def warc_round_trip(spark, folder):
    archives = work_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), archives)
    records = warc.read_archives(spark, archives, payload="false")
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"
    )
