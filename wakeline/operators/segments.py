"""Ordered states per user: segments broken by rejected memories, collapsing, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_assignment(assignments: DataFrame) -> DataFrame:
    """Re-sent assignments as one row a memory (the latest, then the largest state)."""
    fields = [c for c in assignments.columns if c != "memory_id"]
    best = F.max_by(F.struct(*fields), F.struct("assigned_at", "state_id"))
    return assignments.filter("memory_id is not null").groupBy("memory_id").agg(best.alias("m")).select(*[F.col(c) if c == "memory_id" else F.col(f"m.{c}").alias(c) for c in assignments.columns])


def segments(assignments: DataFrame, collapse: bool = False) -> DataFrame:
    """(user_id, seg, pos, state_id, memory_ids, window_indices): runs of accepted memories in window order. A rejected memory
    ends its segment and is never bridged. With collapse, equal neighbours become one entry with their memories.
    Sorted per user once; no list grows beyond a collapsed run."""
    w = Window.partitionBy("user_id").orderBy("window_index", "memory_id")
    ok = F.coalesce("assignment_accepted", F.lit(False))
    runs = assignments.filter("user_id is not null").withColumn("cut", F.sum(F.when(ok, 0).otherwise(1)).over(w)).filter(ok)
    # segments are numbered without gaps
    first = F.when(F.lag("cut").over(w).eqNullSafe(F.col("cut")), 0).otherwise(1)
    runs = runs.withColumn("first", first).withColumn("seg", F.sum("first").over(w) - 1)
    v = Window.partitionBy("user_id", "seg").orderBy("window_index", "memory_id")
    if not collapse:
        return runs.select("user_id", "seg", (F.row_number().over(v) - 1).alias("pos"), "state_id", F.array("memory_id").alias("memory_ids"), F.array("window_index").alias("window_indices"))
    new = F.when(F.lag("state_id").over(v).eqNullSafe(F.col("state_id")), 0).otherwise(1)
    runs = runs.withColumn("new", new).withColumn("pos", F.sum("new").over(v) - 1)
    inner = F.array_sort(F.collect_list(F.struct("window_index", "memory_id")))
    g = runs.groupBy("user_id", "seg", "pos", "state_id").agg(inner.alias("l"))
    return g.select("user_id", "seg", "pos", "state_id", F.col("l.memory_id").alias("memory_ids"), F.col("l.window_index").alias("window_indices"))


def latest_suffix(assignments: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, suffix): up to `most` states after the user's last rejected memory, oldest first; users whose last memory is rejected are left out."""
    w = Window.partitionBy("user_id").orderBy(F.desc("window_index"), F.desc("memory_id"))
    ok = F.coalesce("assignment_accepted", F.lit(False))
    tail = assignments.filter("user_id is not null").withColumn("bad", F.sum(F.when(ok, 0).otherwise(1)).over(w)).withColumn("r", F.row_number().over(w))
    tail = tail.filter((F.col("bad") == 0) & (F.col("r") <= most))
    return tail.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("r").alias("o"), "state_id"))), lambda x: x["state_id"]).alias("suffix"))


def transitions(segs: DataFrame) -> DataFrame:
    """(user_id, seg, pos, state_id, next_state): adjacent entries of a segment."""
    v = Window.partitionBy("user_id", "seg").orderBy("pos")
    return segs.select("user_id", "seg", "pos", "state_id", F.lead("state_id").over(v).alias("next_state")).filter("next_state is not null")


def transition_stats(segs: DataFrame) -> DataFrame:
    t = transitions(segs)
    a = t.agg(F.count("*").alias("transitions"), F.coalesce(F.sum(F.when(F.col("state_id") == F.col("next_state"), 1)), F.lit(0)).alias("self_transitions"))
    return a.withColumn("self_ratio", F.coalesce(F.try_divide("self_transitions", "transitions"), F.lit(0.0)))
