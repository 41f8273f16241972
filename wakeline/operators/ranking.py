"""Candidates, rankings and their measures."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded_shuffle(seed: int):
    """An array in the order random.Random(f"{seed}:{user}").shuffle leaves it: Python's generator, so a pandas UDF."""

    @F.pandas_udf("array<string>")
    def shuffle(users: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for us, lists in users:
            out = []
            for u, items in zip(us, lists, strict=True):
                a = list(items)
                random.Random(f"{seed}:{u}").shuffle(a)
                out.append(a)
            yield pd.Series(out)

    return shuffle


def candidate_lists(sequences: DataFrame, negatives: DataFrame, seed: int = 42) -> DataFrame:
    """(user_id, target, candidates): the test item and the user's test negatives, shuffled by the seed and the user; a user without negatives has the target alone. Lists are of 1 + negatives a user."""
    target = sequences.filter("split = 'test'").select("user_id", F.col("item_id").cast("string").alias("target"))
    neg = negatives.filter("split = 'test'").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col("item_id").cast("string").alias("i")))), lambda x: x["i"]).alias("neg"))
    both = target.join(neg, "user_id", "left").withColumn("all", F.concat(F.array("target"), F.coalesce("neg", F.array().cast("array<string>"))))
    return both.select("user_id", "target", seeded_shuffle(seed)(F.col("user_id").cast("string"), F.col("all")).alias("candidates"))


def candidate_violations(candidates: DataFrame, expected: int = 20) -> DataFrame:
    """(user_id, size, unique_size, targets): lists of another size, with repeats, or without the target exactly once."""
    d = candidates.select("user_id", F.size("candidates").alias("size"), F.size(F.array_distinct("candidates")).alias("unique_size"), F.size(F.filter("candidates", lambda c: c == F.col("target"))).alias("targets"))
    return d.filter((F.col("size") != expected) | (F.col("unique_size") != F.col("size")) | (F.col("targets") != 1))


def same_candidates(cached: DataFrame, candidates: DataFrame) -> DataFrame:
    """Users whose cached list isn't, as a multiset, the current one; both (user_id, candidates)."""
    a = cached.select("user_id", F.array_sort("candidates").alias("a"))
    return a.join(candidates.select("user_id", F.array_sort("candidates").alias("b")), "user_id", "left").filter(~F.col("a").eqNullSafe(F.col("b"))).select("user_id")


def history_identity(cache: DataFrame, histories: DataFrame, limit: int | None = None) -> DataFrame:
    """(user_id, same, first_difference): whether a cached history equals the last `limit` (else as many as cached) train items."""
    n = F.least(F.lit(limit) if limit else F.size("cached"), F.size("train"))
    d = cache.select("user_id", "cached").join(histories.select("user_id", "train"), "user_id").withColumn("now", F.slice("train", F.greatest(F.size("train") - n + 1, F.lit(1)), n))
    diff = F.array_position(F.transform(F.arrays_zip("cached", "now"), lambda x: x["cached"].eqNullSafe(x["now"])), False)
    return d.select("user_id", F.col("cached").eqNullSafe(F.col("now")).alias("same"), F.nullif(diff, F.lit(0)).alias("first_difference"))


def history_hash(items: Column) -> Column:
    """SHA-256 of the compact JSON array."""
    return F.sha2(F.to_json(items), 256)


def sanitize(predicted: Column, candidates: Column) -> Column:
    """Predicted ids that are candidates, first occurrence each, then the missing candidates in their order."""
    kept = F.array_distinct(F.filter(F.coalesce(predicted, F.array().cast("array<string>")), lambda x: F.array_contains(candidates, x)))
    return F.concat(kept, F.filter(candidates, lambda c: ~F.array_contains(kept, c)))


def complete(predicted: Column, candidates: Column) -> Column:
    return F.size(F.array_except(candidates, F.coalesce(predicted, F.array().cast("array<string>")))) == 0


def parse_labels(text: Column, n: Column) -> Column:
    """A struct (positions, complete, reason) of a `C07, C3, ...` answer: the first line that isn't blank, up to `]`; unknown and repeated
    labels dropped, missing ones appended."""
    line = F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s) != ""), F.lit(1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\[", ""), r"\].*$", "")
    found = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\bC\s*0*(\d{1,3})\b"), 1), lambda s: s.cast("int"))
    valid = F.filter(found, lambda x: (x >= 1) & (x <= n))
    unique = F.array_distinct(valid)
    missing = F.array_except(F.sequence(F.lit(1), n), unique)
    parts = F.array_compact(F.array(F.when(F.size(found) > F.size(valid), "out_of_range"), F.when(F.size(valid) > F.size(unique), "duplicate"), F.when(F.size(missing) > 0, "missing")))
    reason = F.when(F.size(parts) > 0, F.concat(F.lit("repaired_"), F.array_join(parts, "_and_"))).otherwise("complete")
    return F.struct(F.concat(unique, missing).alias("positions"), (F.size(parts) == 0).alias("complete"), reason.alias("reason"))


def target_rank(ranking: Column, target: Column) -> Column:
    """1-based place of the target; one more than the list where it is missing."""
    return F.coalesce(F.nullif(F.array_position(ranking, target), F.lit(0)), F.size(ranking) + 1).cast("int")


def order_by_score(scores: DataFrame, missing: float = 0.0) -> DataFrame:
    """(user_id, item_id, rank): by score, unknown items at `missing`, ties by the candidates' order. scores: user_id, cand_pos, item_id, score."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.coalesce("score", F.lit(missing))), "cand_pos")
    return scores.select("user_id", "item_id", F.row_number().over(w).alias("rank"))


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 15, 20)) -> DataFrame:
    """(mode, metric, value) from (mode, rank): Hit@K, NDCG@K, MRR, MeanRank, MedianRank, NumUsers. One aggregation, unpivoted."""
    r = F.col("rank")
    out = [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"Hit@{k}") for k in ks]
    out += [F.avg(F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"NDCG@{k}") for k in ks]
    out += [F.avg(1 / r).alias("MRR"), F.avg(r).alias("MeanRank"), F.percentile(r, 0.5).alias("MedianRank"), F.count("*").cast("double").alias("NumUsers")]
    wide = ranks.groupBy("mode").agg(*out)
    return wide.unpivot("mode", [c for c in wide.columns if c != "mode"], "metric", "value")


def list_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, ndcg, recall, users) from (user_id, truth, predicted): several relevant items; the ideal is sorted over the returned list,
    so items that weren't returned don't lower it; users without predictions are skipped."""
    hit = F.transform("predicted", lambda p: F.array_contains("truth", p).cast("int"))
    d = results.filter(F.size("predicted") > 0).withColumn("hit", hit).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    gain = lambda a, k: F.aggregate(F.transform(F.slice(a, 1, k), lambda x, i: x / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("dcg", gain(F.col("hit"), F.col("k"))).withColumn("ideal", gain(F.sort_array("hit", asc=False), F.col("k")))
    hits = F.aggregate(F.slice("hit", 1, F.col("k")), F.lit(0), lambda s, x: s + x)
    return d.groupBy("k").agg(F.avg(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))).alias("ndcg"), F.avg(F.coalesce(F.try_divide(hits, F.size("truth")), F.lit(0.0))).alias("recall"), F.count("*").alias("users"))


def metric_gains(metrics: DataFrame, mode: str, against: str) -> DataFrame:
    """(metric, gain) of one mode over another; for mean and median ranks less is more."""
    a = metrics.filter(F.col("mode") == mode).select("metric", F.col("value").alias("x"))
    b = metrics.filter(F.col("mode") == against).select("metric", F.col("value").alias("y"))
    sign = F.when(F.col("metric").isin("MeanRank", "MedianRank"), -1.0).otherwise(1.0)
    return a.join(b, "metric").select("metric", (sign * (F.col("x") - F.col("y"))).alias("gain"))


def candidate_cache(cached: DataFrame, current: DataFrame) -> DataFrame:
    """The cache with lists of users it lacks; a cached list that isn't, as a multiset, the current one raises."""
    if same_candidates(cached, current).limit(1).count():
        raise ValueError("cached candidates differ from the current ones")
    return cached.unionByName(current.join(cached.select("user_id"), "user_id", "left_anti").select(*cached.columns))


def override_candidates(computed: DataFrame, given: DataFrame, required: bool = False) -> DataFrame:
    """computed (user_id, target, candidates) with the lists of a file (user_id, candidates) in place of the computed ones. A given list with repeats or
    without its user's target exactly once raises; so does a user without one, where required."""
    g = given.select(F.col("user_id").cast("string").alias("_u"), F.col("candidates").alias("_c"))
    d = computed.withColumn("_u", F.col("user_id").cast("string")).join(g, "_u", "left")
    held = F.size(F.filter("_c", lambda c: c == F.col("target")))
    bad = d.filter((F.col("_c").isNotNull() & ((held != 1) | (F.size(F.array_distinct("_c")) != F.size("_c")))) | (F.lit(required) & F.col("_c").isNull()))
    if (r := bad.select("user_id").limit(1).collect()):
        raise ValueError(f"candidate list of {r[0][0]}: missing, repeated, or without the target exactly once")
    return d.select("user_id", "target", F.coalesce("_c", "candidates").alias("candidates"))


def checked_history(cache: DataFrame, histories: DataFrame, limit: int | None = None) -> DataFrame:
    """The cache, if every cached history is the current one; else raises with the first user and place that differ."""
    bad = history_identity(cache, histories, limit).filter("not same").limit(1).collect()
    if bad:
        raise ValueError(f"history of {bad[0]['user_id']} differs at {bad[0]['first_difference']}")
    return cache
