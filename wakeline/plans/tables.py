"""The pipeline's stages over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import contexts, items, memories, prep, segments
from wakeline.storage import keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def histories(spark: SparkSession, sf: str, least: int = 10, most: int = 5000) -> DataFrame:
    return prep.within_length(prep.latest_interactions(read(spark, sf, "ratings")), least, most)


def sequences(spark: SparkSession, sf: str, least: int = 10, most: int = 5000) -> DataFrame:
    return prep.leave_two_out(histories(spark, sf, least, most))


def info(spark: SparkSession, sf: str, variant: str = "extraction") -> DataFrame:
    return items.item_info(read(spark, sf, "items"), variant)


def records(spark: SparkSession, sf: str) -> DataFrame:
    return memories.one_record_per_id(read(spark, sf, "local_memory"))


def usable(spark: SparkSession, sf: str) -> DataFrame:
    return memories.usable_memories(records(spark, sf)).filter("invalid_reason is null")


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    return segments.one_assignment(read(spark, sf, "assignments"))


def segs(spark: SparkSession, sf: str, collapse: bool = False) -> DataFrame:
    return segments.segments(assignments(spark, sf), collapse)


def counts(spark: SparkSession, sf: str, max_order: int = 5) -> DataFrame:
    return keep(contexts.context_counts(contexts.observations(segs(spark, sf), max_order)), "context-counts")


def nodes(spark: SparkSession, sf: str, max_order: int = 5) -> DataFrame:
    return keep(contexts.activate(contexts.contexts(counts(spark, sf, max_order))), "nodes")


def state_members(spark: SparkSession, sf: str) -> DataFrame:
    a = assignments(spark, sf).select("memory_id", "state_id", F.col("cluster_similarity").alias("similarity"), F.col("assignment_accepted").alias("accepted"))
    return usable(spark, sf).join(a, "memory_id").withColumn("row_idx", F.col("precompute_id"))
