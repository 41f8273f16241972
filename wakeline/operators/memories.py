"""Behaviour records: contracts, normalisation, ids, views of the latest behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

from wakeline.functions.jsons import json_body
from wakeline.functions.text import clean_text, cluster_text, memory_id, profile_label, trajectory

#: version of the records the strict contract accepts: fixed value
SCHEMA_VERSION = "amem_local_memory_dual_behavior_v4"
REQUIRED = ("precompute_id", "user_id", "window_index", "behavior_explanation", "pattern_description", "keywords")


def contract_violations(records: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    """(precompute_id, violation) of rows the strict loader refuses: another version, a required field null, an id with two different records."""
    if "embedding" in records.columns:
        raise ValueError("records must not carry embeddings")
    absent = [c for c in REQUIRED if c not in records.columns]
    if absent:
        raise ValueError(f"records lack {absent}")
    checks = [F.when(~F.col("schema_version").eqNullSafe(version), "schema_version")] + [F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED]
    rows = records.withColumn("v", F.explode(F.array_compact(F.array(*checks)))).select("precompute_id", F.col("v").alias("violation"))
    body = F.xxhash64(*[F.col(c) for c in records.columns if c != "raw_response"])
    twice = records.filter("precompute_id is not null").groupBy("precompute_id").agg(F.countDistinct(body).alias("n")).filter("n > 1")
    return rows.unionByName(twice.select("precompute_id", F.lit("duplicate id").alias("violation"))).distinct()


def one_record_per_id(records: DataFrame, key: str = "precompute_id") -> DataFrame:
    """Re-sent rows as one. The smallest by the hash of its fields, should they differ."""
    fields = [c for c in records.columns if c != key]
    body = F.struct(F.xxhash64(*fields).alias("_h"), *fields)
    w = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(body, F.xxhash64(*fields)).alias("m"))
    return w.select(*[F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in records.columns])


def usable_memories(records: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, field: str = "structured_combined", rule: str = "builder") -> DataFrame:
    """records with invalid_reason (null where usable), clean labels, trajectory, focus and cluster text.

    Reasons, first match: parse_failed, missing_user, missing_dual, empty_cluster_text. include and exclude are tables of
    user_id (semi and anti join). Filter on invalid_reason to skip, or raise where it isn't null.
    """
    d = records
    if include is not None:
        d = d.join(include.select("user_id").distinct(), "user_id", "left_semi")
    if exclude is not None:
        d = d.join(exclude.select("user_id").distinct(), "user_id", "left_anti")
    sign = trajectory(F.col("trajectory_signature"), F.col("behavior_signature"), rule)
    focus = F.coalesce("semantic_focus", "keywords", F.array().cast("array<string>"))
    focus = F.slice(F.filter(F.transform(focus, clean_text), lambda s: s != ""), 1, 12)
    out = d.withColumns(
        {
            "memory_id": memory_id(None, F.col("precompute_id"), None, F.lit("")),
            "trajectory_signature": sign,
            "recommendation_behavior": clean_text(F.col("recommendation_behavior")),
            "semantic_focus": focus,
            **{k: profile_label(F.col(k), k, rule) for k in ("mechanism", "scope", "direction")},
        }
    ).withColumn("behavior_signature", F.col("trajectory_signature"))
    out = out.withColumn("cluster_text", cluster_text(F.col("mechanism"), F.col("scope"), F.col("direction"), F.col("trajectory_signature"), field))
    reason = (
        F.when(F.col("parse_ok").eqNullSafe(False), "parse_failed")
        .when(clean_text(F.col("user_id")) == "", "missing_user")
        .when((F.col("recommendation_behavior") == "") | (F.col("trajectory_signature") == ""), "missing_dual")
        .when(F.col("cluster_text") == "", "empty_cluster_text")
    )
    return out.withColumn("invalid_reason", reason)


def label_counts(records: DataFrame, label: str, order: str) -> DataFrame:
    """(value, n, share, first_seen): most common first, ties by first appearance."""
    c = records.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(total).select("value", "n", (F.col("n") / F.col("total")).alias("share"), "first_seen")  # total: one row


def to_memory(records: DataFrame) -> DataFrame:
    """Global memory rows of extraction records: thought_id is the precompute_id, absent fields get defaults."""
    seq = F.transform(
        F.coalesce("interaction_sequence", F.expr("cast(array() as array<struct<item_id:string,item_name:string,item_category:string,action_type:string>>)")),
        lambda x: F.struct(
            F.coalesce(x["item_id"], F.lit("")).alias("item_id"),
            F.coalesce(x["item_name"], F.lit("Unknown")).alias("item_name"),
            F.coalesce(x["item_category"], F.lit("Unknown")).alias("item_category"),
            F.coalesce(x["action_type"], F.lit("purchase")).alias("action_type"),
        ),
    )
    return records.select(
        F.col("precompute_id").alias("thought_id"),
        seq.alias("interaction_sequence"),
        F.coalesce("behavior_explanation", F.lit("")).alias("behavior_explanation"),
        F.coalesce("pattern_description", F.lit("")).alias("pattern_description"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.array().cast("array<bigint>").alias("links"),
        F.lit(0).alias("evolution_count"),
        F.col("user_id").alias("source_user_id"),
        F.col("window_index").alias("source_window_index"),
    )


def latest_behavior(records: DataFrame) -> DataFrame:
    """Per user the record of the last window: focus (up to 8, keywords where there is none), labels, and the pattern where no behaviour is given."""
    b = F.struct("window_index", "precompute_id", "recommendation_behavior", "pattern_description", "semantic_focus", "keywords", "mechanism", "scope", "direction", "trajectory_signature")
    m = records.groupBy("user_id").agg(F.max_by(b, F.struct("window_index", "precompute_id")).alias("m")).select("user_id", "m.*")
    focus = F.when(F.size(F.coalesce("semantic_focus", F.array().cast("array<string>"))) > 0, F.col("semantic_focus")).otherwise(F.coalesce("keywords", F.array().cast("array<string>")))
    return m.select("user_id", "window_index", F.coalesce(F.nullif(clean_text(F.col("recommendation_behavior")), F.lit("")), clean_text(F.col("pattern_description"))).alias("recommendation_behavior"), F.slice(focus, 1, 8).alias("semantic_focus"), "mechanism", "scope", "direction", "trajectory_signature")


def recent_evidence(records: DataFrame, n: int = 3) -> DataFrame:
    """(user_id, evidence): the last n windows' behaviours, oldest first, in compact form. A top-n window, so lists stay short."""
    w = Window.partitionBy("user_id").orderBy(F.desc("window_index"), F.desc("precompute_id"))
    top = records.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    e = F.struct("window_index", "recommendation_behavior", "semantic_focus", "trajectory_signature", "behavior_signature", "mechanism", "scope", "direction", "confidence")
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(e)).alias("evidence"))


def behavior_cache(rows: DataFrame, ok: str = "precompute_ok", behaviors: str = "generated_behaviors", order: str = "file_pos") -> DataFrame:
    """Usable test-behaviour rows: ok is true, at least one behaviour, sorted by window, the last row of a user wins."""
    kept = rows.filter(F.col(ok).eqNullSafe(True) & (F.size(behaviors) > 0))
    compare = lambda x, y: F.when(x["window_index"] < y["window_index"], -1).when(x["window_index"] > y["window_index"], 1).otherwise(0)
    last = kept.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "user_id"]), order).alias("m")).select("user_id", "m.*")
    return last.withColumn(behaviors, F.array_sort(behaviors, compare))


def successful_users(rows: DataFrame, ok: str = "precompute_ok", behaviors: str = "generated_behaviors") -> DataFrame:
    """Users with a row that has behaviours and isn't marked as failed; a missing mark is no failure."""
    return rows.filter(~F.col(ok).eqNullSafe(False) & (F.coalesce(F.size(behaviors), F.lit(0)) > 0)).select("user_id").distinct()


def parsed_response(c: Column, ddl: str) -> Column:
    """A model's answer as a struct of `ddl`: fences stripped, outermost braces; of a list its first object; null where it is no JSON, or holds no object."""
    kind = StructType.fromDDL(ddl)
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))
    listed = F.from_json(bare, ArrayType(StringType()))
    objects = F.filter(listed, lambda x: F.substring(F.trim(x), 1, 1) == "{")
    return F.when(F.substring(bare, 1, 1) == "[", F.from_json(F.try_element_at(objects, F.lit(1)), kind)).otherwise(F.from_json(json_body(c), kind))


def fallback_record(records: DataFrame) -> DataFrame:
    """Records with, where parsing failed, a text made from the window's categories, unknown labels and confidence 0."""
    cats = F.array_distinct(F.filter(F.transform("interaction_sequence", lambda x: clean_text(x["item_category"])), lambda s: s != ""))
    named = F.when(F.size(F.coalesce(cats, F.array().cast("array<string>"))) > 0, F.array_join(cats, ", ")).otherwise("unknown")
    bad = F.col("parse_ok").eqNullSafe(False)
    out = {"behavior_explanation": F.when(bad, F.concat(F.lit("Interacted with items in: "), named)).otherwise(F.col("behavior_explanation")), "confidence": F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))}
    out |= {k: F.when(bad, "unknown").otherwise(F.col(k)) for k in ("mechanism", "scope", "direction")}
    return records.withColumns(out)


def pending(tasks: DataFrame, written: DataFrame, keys: list[str], same: list[str] | None = None) -> DataFrame:
    """Tasks not yet written under the same versions (columns `same`): an anti join, for resuming."""
    return tasks.join(written.select(*keys, *(same or [])).distinct(), [*keys, *(same or [])], "left_anti")


def bounded_behavior(records: DataFrame, most_focus: int = 8) -> DataFrame:
    """Records with the confidence in [0, 1] (0 where it is none) and at most most_focus clean focus terms."""
    focus = F.filter(F.transform(F.coalesce("semantic_focus", F.array().cast("array<string>")), clean_text), lambda s: s != "")
    c = F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.0))
    return records.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(c), 0.0).otherwise(c))), "semantic_focus": F.slice(focus, 1, most_focus)})
