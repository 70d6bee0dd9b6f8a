"""Frontier expansion by depth (X15) and the link graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import canonical_url
from webloom.session import delete_folder, shuffle_files_go, work_folder

SLICE_ROWS = 20_000_000  # edges that are followed at a time, if the graph has no more


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the crawled page they lead to, NULL when it was not crawled.

    Several pages may share a canonical URL; the smallest id stands for them, so links stay single.
    """
    known = pages.groupBy(canonical_url(F.col("url")).alias("link")).agg(F.min("page_id").alias("to_page"))
    return links.join(known, "link", "left").select(F.col("page_id").alias("from_page"), "link", "to_page")


def expand_frontier(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """URLs reached from the seeds of each task and the depth they are first seen at.

    ``seeds``: task_id, url; ``edges``: src, dst. One round per depth: the last round's URLs meet the edges, targets are
    made distinct, what was seen falls away, and the rest is appended to the table of what was seen. That table lies
    in the checkpoint folder, bucketed by (task_id, url): a round moves its own targets to the buckets and nothing of
    the rounds before it, and a lost executor replays one round. Edges are written once, bucketed by ``src``, and not moved
    again. A round counts the edges that it follows before it moves anything; if they are more than the graph has and more than
    ``slice_rows``, it takes the tasks in slices, and the shuffle files of one go before the next begins. Rounds end when there is
    no edge to follow or after ``max_depth``, if that is given; at least one is run.
    """
    spark = seeds.sparkSession
    buckets, made = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    seen, folder, links, links_folder = f"frontier_{made}", work_folder(spark), f"links_{made}", work_folder(spark)
    key = ["task_id", "url"]

    def add(delta: DataFrame) -> None:
        table = delta.select(*key, "depth").write.mode("append").option("compression", "zstd")
        table.bucketBy(buckets, *key).sortBy(*key).option("path", folder).saveAsTable(seen)

    try:
        with shuffle_files_go(spark):
            table = edges.select("src", "dst").write.option("compression", "zstd").bucketBy(buckets, "src").sortBy("src", "dst")
            table.option("path", links_folder).saveAsTable(links)
            edges, depth = spark.table(links), 0
            most, degrees = max(edges.count(), slice_rows), edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
            add(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
            while depth < (max(max_depth, 1) if max_depth is not None else depth + 1):
                last = spark.table(seen).filter(F.col("depth") == depth).select("task_id", F.col("url").alias("src"))
                tasks = last.groupBy("src").agg(F.count(F.lit(1)).alias("tasks"))
                followed = tasks.join(degrees, "src").agg(F.sum(F.col("tasks") * F.col("n"))).first()[0]
                if not followed:
                    break
                depth += 1
                slices = -(-followed // most)
                for k in range(slices):
                    own = F.pmod(F.xxhash64("task_id"), F.lit(slices)) == k
                    # Distinct before the anti join: a hub's repeated targets are merged in the map tasks.
                    found = last.filter(own).join(edges, "src").select("task_id", F.col("dst").alias("url")).distinct()
                    # What other slices of the round have added belongs to other tasks.
                    known = spark.table(seen).filter(own & (F.col("depth") < depth)).select(*key)
                    add(found.join(known, key, "left_anti").withColumn("depth", F.lit(depth)))
        return spark.read.schema("task_id {}, url string, depth int".format(seeds.schema["task_id"].dataType.simpleString())).parquet(folder)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {seen}")  # the name only: its files stay
        spark.sql(f"DROP TABLE IF EXISTS {links}")
        delete_folder(spark, links_folder)
