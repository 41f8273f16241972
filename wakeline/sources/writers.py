"""Writers. Each is one distributed job, committed whole by Spark's protocol."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def json_document(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one JSON document (a list). Larger ones raise: they belong in JSON lines."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: write JSON lines")
    one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def text_files(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def matrix(df: DataFrame, path: str, order: str, vector: str) -> None:
    """Vectors in order, as Parquet of array<float> (range-partitioned, so files follow the order)."""
    df.select(F.col(order), F.col(vector).cast("array<float>").alias(vector)).repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def factors(users: DataFrame, items: DataFrame, path: str) -> None:
    """A factor model as two tables."""
    tables({"users": users, "items": items}, path)


def tables(outputs: dict[str, DataFrame], path: str) -> None:
    """A set of tables under one folder, as a tree build leaves them, replaced as one: each is written to a folder of its own version, and only then a manifest of one row
    names the version. Until that row is there readers have the old set, and a run that dies leaves it as it was."""
    version = uuid.uuid4().hex
    for name, df in outputs.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark = next(iter(outputs.values())).sparkSession
    row = [(datetime.now(timezone.utc).replace(tzinfo=None), version, sorted(outputs))]
    spark.createDataFrame(row, "written_at timestamp_ntz, version string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The set of tables last written."""
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("written_at"), "version").first()
    return {name: spark.read.parquet(f"{path}/{last['version']}/{name}") for name in last["tables"]}


def snapshot(candidates: DataFrame, path: str) -> None:
    """The candidate lists a run ranked, for audit."""
    tables({"candidates": candidates.select("user_id", "target", "candidates")}, path)


def run_stats(spark: SparkSession, path: str, stats: dict) -> None:
    """A row of run metadata, appended; the parameters as JSON text."""
    row = [(datetime.now(timezone.utc).replace(tzinfo=None), json.dumps(stats, sort_keys=True, default=str))]
    spark.createDataFrame(row, "written_at timestamp_ntz, stats string").coalesce(1).write.mode("append").parquet(path)


