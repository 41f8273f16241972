"""Roll-ups of calls, evolutions, assignments and labels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import ranking


def call_rollup(calls: DataFrame) -> DataFrame:
    """(call_type, calls, input_tokens, output_tokens, seconds, mean_seconds, failed), each call_id once."""
    one = calls.groupBy("call_id").agg(F.min(F.struct("call_type", "input_tokens", "output_tokens", "elapsed_sec", "parse_ok")).alias("m")).select("m.*")
    return one.groupBy("call_type").agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum("elapsed_sec").alias("seconds"),
        F.avg("elapsed_sec").alias("mean_seconds"),
        F.count_if(F.col("parse_ok").eqNullSafe(False)).alias("failed"),
    )


def evolution_stats(memories: DataFrame) -> DataFrame:
    """One row: memories that never, once and more often evolved, the mean and the most."""
    one = memories.groupBy("thought_id").agg(F.max(F.coalesce("evolution_count", F.lit(0))).alias("n"))
    return one.agg(F.count("*").alias("memories"), F.count_if(F.col("n") == 0).alias("never"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("more"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def assignment_rollup(assignments: DataFrame) -> DataFrame:
    """One row: accepted share, reasons, quantiles of the margin (linear interpolation)."""
    ok = F.coalesce("assignment_accepted", F.lit(False))
    return assignments.agg(
        F.count("*").alias("assignments"),
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("accepted_share"),
        F.count_if(F.col("rejection_reason") == "low_similarity").alias("low_similarity"),
        F.count_if(F.col("rejection_reason") == "low_margin").alias("low_margin"),
        F.percentile("similarity_margin", 0.1).alias("margin_p10"),
        F.percentile("similarity_margin", 0.5).alias("margin_p50"),
    )


def size_distribution(assignments: DataFrame) -> DataFrame:
    """One row: states, singletons, the largest, quantiles of their sizes."""
    n = assignments.groupBy("state_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("states"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.9).alias("p90"))


def behavior_summary(records: DataFrame) -> DataFrame:
    """(field, value, n): counts of labels, parse results and focus terms, long form."""
    labels = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(F.col(k).cast("string"), F.lit("null")).alias("value")) for k in ("mechanism", "scope", "direction", "parse_ok")])).alias("x")).select("x.*")
    focus = records.select(F.lit("focus").alias("field"), F.explode("semantic_focus").alias("value")).filter("value is not null")
    return labels.unionByName(focus).groupBy("field", "value").agg(F.count("*").alias("n"))


def mapping_diagnostics(mapped: DataFrame, queried: DataFrame) -> DataFrame:
    """(what, value, n): accepted or not, reasons, own bucket or fallback, orders matched, ROOT fallbacks."""
    a = mapped.select(F.explode(F.array(F.struct(F.lit("accepted").alias("what"), F.col("accepted").cast("string").alias("value")), F.struct(F.lit("reason").alias("what"), F.col("reason").alias("value")), F.struct(F.lit("scope").alias("what"), F.when(F.col("fallback"), "all_states").otherwise("own_bucket").alias("value")))).alias("x")).select("x.*")
    b = queried.select(F.explode(F.array(F.struct(F.lit("matched_order").alias("what"), F.size("matched").cast("string").alias("value")), F.struct(F.lit("root_fallback").alias("what"), (F.size("context") == 0).cast("string").alias("value")))).alias("x")).select("x.*")
    return a.unionByName(b).groupBy("what", "value").agg(F.count("*").alias("n"))


def contexts_by_order(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.size("ctx").alias("context_order")).agg(F.count("*").alias("contexts"), F.count_if("active").alias("active"))


def protocol_summary(histories: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: users, shortest and longest training history, and users whose target also occurs in their own history."""
    h = histories.select("user_id", F.size("train").alias("n"), "train")
    leak = candidates.select("user_id", "target").join(h, "user_id").filter(F.array_contains("train", F.col("target"))).agg(F.count("*").alias("targets_in_history"))
    return h.agg(F.count("*").alias("users"), F.min("n").alias("min_history"), F.max("n").alias("max_history")).crossJoin(leak)  # one row each


def debug_rows(pairs: DataFrame, mode: str, most: int, seed: int = 42) -> DataFrame:
    """Users to look at, from (user_id, rank, base_rank): first, random (by hash), degraded, improved, largest_drop. A limit, as that is what is asked for."""
    d = pairs.withColumn("drop", F.col("rank") - F.col("base_rank"))
    order = {
        "first": ["user_id"],
        "random": [F.xxhash64(F.lit(seed), "user_id"), "user_id"],
        "degraded": ["user_id"],
        "improved": ["user_id"],
        "largest_drop": [F.desc("drop"), "user_id"],
    }[mode]
    d = d.filter("drop > 0") if mode in ("degraded", "largest_drop") else d.filter("drop < 0") if mode == "improved" else d
    return d.orderBy(*order).limit(most)


def incompatible(stored: dict, now: dict, keys: tuple[str, ...]) -> list[str]:
    """Settings under which an output was written that differ from those of now; a run that resumes raises on any."""
    return [f"{k}: {stored.get(k)!r} and {now.get(k)!r}" for k in keys if stored.get(k) != now.get(k)]


def settings_differ(stored: DataFrame, now: dict, keys: tuple[str, ...]) -> list[str]:
    """`incompatible` against the last row of stored run settings (written_at, stats), as writers.run_stats leaves them; none stored, none differ."""
    last = stored.orderBy(F.desc("written_at")).select("stats").first()
    return incompatible(json.loads(last["stats"]), json.loads(json.dumps(now, default=str)), keys) if last else []


def user_state_counts(assignments: DataFrame) -> DataFrame:
    """(user_id, states): how many different states each user's accepted memories are in."""
    return assignments.filter(F.coalesce("assignment_accepted", F.lit(False)) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.countDistinct("state_id").alias("states"))


def search_rollup(log: DataFrame) -> DataFrame:
    """(op, calls, comparisons, mean_ms) of search, add and update rows (op, comparisons, seconds)."""
    return log.groupBy("op").agg(F.count("*").alias("calls"), F.coalesce(F.sum("comparisons"), F.lit(0)).alias("comparisons"), (F.avg("seconds") * 1000).alias("mean_ms"))


def sample_text(row: DataFrame) -> DataFrame:
    """(user_id, text): a ranked user as text to read, from (user_id, mode, target, ranking, prompt)."""
    place = F.coalesce(F.nullif(F.array_position("ranking", F.col("target")), F.lit(0)).cast("string"), F.lit("none"))
    listed = F.array_join(F.transform("ranking", lambda x, i: F.format_string("%2d. %s%s", i + 1, x, F.when(x == F.col("target"), F.lit("  <- target")).otherwise(F.lit("")))), "\n")
    head = F.format_string("user %s, condition %s, target %s at %s", F.col("user_id").cast("string"), "mode", "target", place)
    return row.select("user_id", F.concat_ws("\n", head, listed, F.lit("--- prompt"), F.coalesce("prompt", F.lit(""))).alias("text"))


def ranked_rows(prompts: DataFrame, answered: DataFrame, candidates: DataFrame) -> DataFrame:
    """The output row of each ranked user and condition: (user_id, mode, target, candidates, ranking, rank, complete, reason) from labelled answers (user_id, mode, answer)."""
    d = prompts.select("user_id", "mode").join(answered.select("user_id", "mode", "answer"), ["user_id", "mode"], "left").join(candidates.select("user_id", "target", "candidates"), "user_id")
    d = d.withColumn("p", ranking.parse_labels(F.col("answer"), F.size("candidates")))
    d = d.withColumn("ranking", F.transform("p.positions", lambda i: F.element_at("candidates", i)))
    return d.select("user_id", "mode", "target", "candidates", "ranking", ranking.target_rank(F.col("ranking"), F.col("target")).alias("rank"), F.col("p.complete").alias("complete"), F.col("p.reason").alias("reason"))
