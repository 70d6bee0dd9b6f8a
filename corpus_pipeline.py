"""Corpus pipeline: quality, near-dedup, decontamination, PII, packing; each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontam, gam, neardup, packing, pii, queries
from webloom.llm.common import keep, work_folder
from webloom.llm.op4 import THRESHOLD
from webloom.llm.op10 import KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = gam.train(docs, labels)
    return gam.score(docs, model, into="__score").filter(F.col("__score") >= THRESHOLD).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; rows without id stay.

    Repeated rows are one; an id with several texts keeps each of them.
    """
    found = neardup.near_duplicates(docs, size=5)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    out = pii.pseudonymise(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length in words, bucket, padded length, batch and slot.

    Rows are numbered in a work table, so repeated ids and rows without id keep their own texts.
    """
    rows = keep(docs.withColumn("__row", F.monotonically_increasing_id()), work_folder(spark, "pack"), "rows")
    placed = packing.pack(rows.select("__row", "text"), packing.words_in(F.col("text")), key="__row")
    return rows.join(placed, "__row").drop("__row")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("surrogates", surrogates),
    ("pack", pack),
]

#: The stages learn a model, estimate similarities and run dynamic programmes: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), folder, name)
    return docs


def registered():
    """(queries, oracle SQL) of the operators and the pipeline."""
    found, oracles = queries.registered()
    return found | {"pipeline": run}, oracles
