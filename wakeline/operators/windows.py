"""Histories cut into chunks, and the structural facts of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.text import clean_text, extraction_value
from wakeline.operators.order import running_total


def chunk_windows(sequences: DataFrame, info: DataFrame, size: int = 3, last: int = 30, emit_at_end_without_metadata: bool = False) -> DataFrame:
    """(user_id, window_index, interaction_sequence): of the last `last` train items those with metadata; a window of the
    latest `size` valid items after every size-th one and at the end, where it may overlap the one before.

    The end is the last raw item; if that has no metadata nothing is emitted there, unless emit_at_end_without_metadata
    (the test-side rule, which also drops a window equal to the one before).
    """
    back = Window.partitionBy("user_id").orderBy(F.desc("pos"))
    recent = sequences.filter("split = 'train'").withColumn("back", F.row_number().over(back))
    recent = recent.filter(F.col("back") <= last) if last > 0 else recent
    known = recent.join(info, recent["item_id"].cast("string") == info["item_id"], "inner").select("user_id", "pos", "back", info["item_id"], "item_name", "item_category")
    order = Window.partitionBy("user_id").orderBy("pos")
    item = F.struct("item_id", "item_name", "item_category", F.lit("purchase").alias("action_type"))
    rows = (
        known.withColumn("valid", F.row_number().over(order))
        .withColumn("after", F.lead("pos").over(order))
        .withColumn("interaction_sequence", F.collect_list(item).over(order.rowsBetween(-(size - 1), 0)))
    )
    at_end = F.col("after").isNull() if emit_at_end_without_metadata else F.col("back") == 1
    rows = rows.filter((F.col("valid") % size == 0) | at_end)
    if emit_at_end_without_metadata:
        before = F.lag("interaction_sequence").over(order)
        rows = rows.withColumn("same", before.isNotNull() & (before == F.col("interaction_sequence"))).filter(~F.col("same"))
    return rows.withColumn("window_index", F.row_number().over(order) - 1).select("user_id", "window_index", "interaction_sequence")


def number_windows(windows: DataFrame, users: DataFrame) -> DataFrame:
    """windows with user_order and a dense precompute_id by (user_order, window_index), for the users listed (user_id, user_order).
    Offsets come from each user's count; the counts are cumulated range by range."""
    n = windows.groupBy("user_id").agg(F.count("*").alias("n")).join(users, "user_id")
    base = running_total(n, ["user_order"], F.col("n"), "base").select("user_id", "user_order", "base")
    return windows.join(base, "user_id").withColumn("precompute_id", F.col("base") + F.col("window_index")).drop("base")


def evidence(sequence: Column) -> Column:
    """Structural facts of a window: ids and known categories, blanks left out."""
    ids = F.filter(F.transform(sequence, lambda x: clean_text(x["item_id"])), lambda s: s != "")
    known = F.filter(F.transform(sequence, lambda x: clean_text(x["item_category"])), lambda s: (s != "") & (F.lower(s) != "unknown"))
    n, unique = F.size(ids), F.size(F.array_distinct(ids))
    return F.struct(
        n.alias("num_items"),
        unique.alias("num_unique_item_ids"),
        ((n >= 2) & (unique < n)).alias("has_exact_item_repeat"),
        ((n >= 2) & (unique == 1)).alias("all_same_item"),
        ((F.size(known) >= 2) & (F.size(F.array_distinct(known)) == 1)).alias("same_known_category"),
    )


def guard_labels(df: DataFrame, sequence: str = "interaction_sequence") -> DataFrame:
    """df with mechanism, scope and direction made consistent with the window, the log of changes and the evidence.

    Labels of literal repetition need a repeated id; where all ids are equal, the scope is always `same item`, the
    mechanism `repetition` if it was unknown or persistence, the direction `repeat` if unknown or stable.
    """
    d = df.withColumn("structural_evidence", evidence(F.coalesce(F.col(sequence), F.expr("cast(array() as array<struct<item_id:string,item_name:string,item_category:string,action_type:string>>)"))))
    value = {k: F.when(extraction_value(F.col(k)) == "", "unknown").otherwise(extraction_value(F.col(k))) for k in ("mechanism", "scope", "direction")}
    d = d.select("*", *[v.alias(f"_{k}") for k, v in value.items()])
    repeat, same = F.col("structural_evidence.has_exact_item_repeat"), F.col("structural_evidence.all_same_item")
    literal = {"mechanism": ("repetition", "unknown"), "scope": ("same item", "mixed"), "direction": ("repeat", "unknown")}
    forced = {"mechanism": ("repetition", ["unknown", "persistence"]), "scope": ("same item", None), "direction": ("repeat", ["unknown", "stable"])}
    log, out = [], {}
    for k, (bad, to) in literal.items():
        hit = ~repeat & (F.col(f"_{k}") == bad)
        log.append(F.when(hit, F.lit(f"{k}:{bad}->{to}:no_exact_item_repeat")))
        out[k] = F.when(hit, to).otherwise(F.col(f"_{k}"))
    for k, (to, only) in forced.items():
        hit = same & (F.col(f"_{k}").isin(only) if only else F.col(f"_{k}") != to)
        log.append(F.when(hit, F.concat(F.lit(f"{k}:"), F.col(f"_{k}"), F.lit(f"->{to}:all_same_item"))))
        out[k] = F.when(hit, to).otherwise(out[k])
    d = d.withColumn("consistency_adjustments", F.array_compact(F.array(*log)))
    return d.withColumns(out).drop(*[f"_{k}" for k in value])
