"""Profiles of states: who is in them, what is typical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def state_profiles(members: DataFrame) -> DataFrame:
    """One row a state_id: members, accepted, users, the majority (mechanism, scope, direction) of the accepted (all, if none is) and its
    share, similarity bounds, the medoid. members: memory_id, user_id, state_id, similarity, accepted, mechanism, scope, direction, row_idx."""
    m = members.withColumn("w", F.coalesce("accepted", F.lit(False)))
    base = m.groupBy("state_id").agg(
        F.count("*").alias("members"),
        F.count_if("w").alias("accepted"),
        F.countDistinct("user_id").alias("users"),
        F.avg("similarity").alias("mean_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.min_by("memory_id", F.struct(F.negative("similarity"), "row_idx")).alias("medoid"),
    )
    # majority by pre-aggregated counts: a state of any size is a few rows
    label = F.struct("mechanism", "scope", "direction")
    c = m.groupBy("state_id", label.alias("profile")).agg(F.count_if("w").alias("n_ok"), F.count("*").alias("n"), F.min(F.when(F.col("w"), F.col("row_idx"))).alias("first_ok"), F.min("row_idx").alias("first"))
    some = F.max("n_ok").over(Window.partitionBy("state_id")) > 0
    c = c.withColumn("votes", F.when(some, F.col("n_ok")).otherwise(F.col("n"))).withColumn("seen", F.when(some, F.col("first_ok")).otherwise(F.col("first")))
    top = c.filter("votes > 0").groupBy("state_id").agg(F.max_by(F.struct("profile", "votes"), F.struct("votes", F.negative("seen"))).alias("t"), F.sum("votes").alias("voters"))
    return base.join(top, "state_id").select("*", F.col("t.profile.mechanism").alias("mechanism"), F.col("t.profile.scope").alias("scope"), F.col("t.profile.direction").alias("direction"), (F.col("t.votes") / F.col("voters")).alias("majority_share")).drop("t", "voters")


def top_terms(members: DataFrame, column: str, most: int) -> DataFrame:
    """(state_id, rank, term, n): the most frequent entries of an array column a state; ties by first appearance (row_idx), then term."""
    c = members.select("state_id", "row_idx", F.explode(column).alias("term")).groupBy("state_id", "term").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"))
    w = Window.partitionBy("state_id").orderBy(F.desc("n"), "first", "term")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("state_id", "rank", "term", "n")


def first_texts(members: DataFrame, column: str, most: int) -> DataFrame:
    """(state_id, texts): up to `most` different texts of a state, first seen first."""
    c = members.filter(F.col(column).isNotNull()).groupBy("state_id", column).agg(F.min("row_idx").alias("first"))
    w = Window.partitionBy("state_id").orderBy("first", column)
    top = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return top.groupBy("state_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(column).alias("t")))), lambda x: x["t"]).alias("texts"))
