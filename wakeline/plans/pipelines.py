"""Whole runs: tables in, tables out. Each stage is one DataFrame plan; what several later stages read is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import contexts, items, memories, prep, providers, ranking, segments, states, vectors, windows
from wakeline.plans.config import EvalConfig, PrepConfig, TreeConfig, WindowConfig
from wakeline.storage import keep


def prepare(ratings: DataFrame, catalogue: DataFrame, config: PrepConfig | None = None) -> dict[str, DataFrame]:
    """items, sequences, negatives, candidates, and violations (empty in a sound run)."""
    c = config or PrepConfig()
    latest = prep.latest_interactions(ratings, c.min_rating)
    known = items.item_info(catalogue)
    histories = keep(prep.within_length(latest, c.min_items, c.max_items), "histories")
    sequences = keep(prep.leave_two_out(histories), "sequences")
    negatives = keep(prep.popularity_negatives(histories, c.negatives, c.seed), "negatives")
    candidates = ranking.candidate_lists(sequences, negatives, c.seed)
    bad = prep.negative_violations(negatives, histories, c.negatives).select(F.col("user_id").cast("string").alias("user_id"), F.lit("negatives").alias("what"))
    bad = bad.unionByName(ranking.candidate_violations(candidates, c.negatives + 1).select(F.col("user_id").cast("string").alias("user_id"), F.lit("candidates").alias("what")))
    return {"items": known, "sequences": sequences, "negatives": negatives, "candidates": candidates, "violations": bad}


def extract(sequences: DataFrame, info: DataFrame, config: WindowConfig | None = None) -> DataFrame:
    """Behaviour records of all windows by the rule-based provider, labels guarded."""
    c = config or WindowConfig()
    return windows.guard_labels(providers.rule_behavior(windows.chunk_windows(sequences, info, c.size, c.last)))


def build_tree(records: DataFrame, embedded: DataFrame, config: TreeConfig | None = None) -> dict[str, DataFrame]:
    """The tables of a tree build from records and their vectors (memory_id, embedding): cluster_inputs, vectors, assignments, states,
    segments, nodes, edges, next_states. A vector missing for a record, or no transition, raises."""
    c = config or TreeConfig()
    usable = memories.usable_memories(memories.one_record_per_id(records), field=c.cluster_text).filter("invalid_reason is null")
    usable = keep(usable.withColumn("bucket", F.concat_ws("|", *c.bucket)), "memories")
    joined = keep(usable.join(embedded.select("memory_id", F.col("embedding").cast("array<double>").alias("embedding")), "memory_id"), "embedded")
    if joined.count() != usable.count():
        raise ValueError("memories and vectors differ in number")
    labels, centres = vectors.bucketed_kmeans(joined, c.clusters, "memory_id", "bucket", "embedding", c.rounds, c.restarts, c.seed)
    placed = joined.join(labels.select("memory_id", "cluster_id"), "memory_id")
    checked = vectors.assignment_diagnostics(placed, centres, "memory_id", "bucket", "embedding", min_similarity=c.min_similarity, min_margin=c.min_margin, keep_ambiguous=c.keep_ambiguous)
    assigned = checked.join(usable.select("memory_id", "user_id", "window_index"), "memory_id").select(
        "memory_id", "user_id", "window_index", vectors.state_name(F.col("cluster_id")).alias("state_id"), F.col("similarity").alias("cluster_similarity"), F.col("margin").alias("similarity_margin"), F.col("accepted").alias("assignment_accepted"), F.col("reason").alias("rejection_reason")
    )
    assigned = keep(assigned, "assignments")
    members = usable.join(assigned.select("memory_id", "state_id", F.col("cluster_similarity").alias("similarity"), F.col("assignment_accepted").alias("accepted")), "memory_id").withColumn("row_idx", F.col("precompute_id"))
    segs = keep(segments.segments(assigned, c.collapse), "segments")
    counts = keep(contexts.context_counts(contexts.observations(segs, c.max_order)), "context-counts")
    if not counts.limit(1).count():
        raise ValueError("no transition")
    nodes = keep(contexts.activate(contexts.contexts(counts, c.count_mode, c.kappa), c.min_users, c.min_occurrences, c.min_jsd, c.promote_order1), "nodes")
    return {
        "cluster_inputs": usable.select("memory_id", "cluster_text"),
        "vectors": embedded,
        "assignments": assigned,
        "states": states.state_profiles(members).join(centres.select(vectors.state_name(F.col("cluster_id")).alias("state_id"), "centroid"), "state_id", "left"),
        "segments": segs,
        "nodes": nodes.join(contexts.backoff(nodes), "ctx", "left"),
        "edges": contexts.tree_edges(nodes),
        "next_states": contexts.next_states(nodes, c.top_next),
    }


def evaluate(rankings: DataFrame, candidates: DataFrame, config: EvalConfig | None = None) -> dict[str, DataFrame]:
    """rankings (user_id, mode, predicted): repaired against the candidates, ranked, measured; strict metrics take complete answers only."""
    c = config or EvalConfig()
    d = rankings.join(candidates, "user_id").withColumn("ranking", ranking.sanitize(F.col("predicted"), F.col("candidates"))).withColumn("complete", ranking.complete(F.col("predicted"), F.col("candidates")))
    ranked = d.select("user_id", "mode", "ranking", "complete", ranking.target_rank(F.col("ranking"), F.col("target")).alias("rank"))
    ranked = keep(ranked, "ranked")
    return {"ranked": ranked, "metrics": ranking.rank_metrics(ranked, c.ks), "strict_metrics": ranking.rank_metrics(ranked.filter("complete"), c.ks)}
