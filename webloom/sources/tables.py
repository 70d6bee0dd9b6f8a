"""Tables of the engine: reading them, their JSON columns, appending results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "array<struct<name:string,kind:string,expr:string,attr:string>>"
JOB = (
    "id string, task_id bigint, rule_id bigint, rule_version int, url string, depth int, priority int, "
    "attempt int, enqueued_at bigint"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, key: str = "id"
) -> DataFrame:
    """A live relational catalogue (S2), read in parallel by ranges of its numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .load()
    )


def decode_fields(text: Column) -> Column:
    """Field list from JSON; empty and NULL give an empty list (S3)."""
    parsed = F.from_json(F.nullif(text, F.lit("")), FIELDS)
    return F.coalesce(parsed, F.array().cast(FIELDS))


def decode_strings(text: Column) -> Column:
    parsed = F.from_json(F.nullif(text, F.lit("")), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def decode_map(text: Column) -> Column:
    parsed = F.from_json(F.nullif(text, F.lit("")), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def encode_fields(fields: Column) -> Column:
    """Field list as JSON (S4); a blank attr is left out, no list is '[]'."""
    slim = F.transform(
        fields,
        lambda f: F.struct(
            f["name"].alias("name"), f["kind"].alias("kind"), f["expr"].alias("expr"),
            F.nullif(f["attr"], F.lit("")).alias("attr"),
        ),
    )
    return F.coalesce(F.to_json(slim), F.lit("[]"))


def encode_strings(items: Column) -> Column:
    return F.coalesce(F.to_json(items), F.lit("[]"))


def encode_map(m: Column) -> Column:
    return F.coalesce(F.to_json(m), F.lit("{}"))


def decode_jobs(messages: DataFrame, column: str = "value") -> DataFrame:
    """Jobs from queue messages, batch or stream."""
    return messages.select(F.from_json(F.col(column).cast("string"), JOB).alias("job")).select("job.*")


def encode_jobs(jobs: DataFrame) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in JOB.split(",")]
    return jobs.select(F.to_json(F.struct(*[F.col(c) for c in names])).alias("value"))


def append_results(rows: DataFrame, path: str) -> None:
    """Append extraction results, one folder per task."""
    rows.write.mode("append").partitionBy("task_id").parquet(path)
