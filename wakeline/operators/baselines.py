"""Recommenders to compare with, and the tables neural ones train on. Stand-ins are named as such."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.storage import keep


def adjacency(pairs: DataFrame) -> DataFrame:
    """(user_id, item_id, weight): symmetric normalisation, 1 / sqrt(user degree * item degree), of each pair once."""
    e = pairs.select("user_id", "item_id").dropna().distinct()
    du = e.groupBy("user_id").agg(F.count("*").alias("du"))
    di = e.groupBy("item_id").agg(F.count("*").alias("di"))
    return e.join(du, "user_id").join(di, "item_id").select("user_id", "item_id", (1 / F.sqrt(F.col("du") * F.col("di"))).alias("weight"))


def _spread(edges: DataFrame, vectors: DataFrame, by: str, to: str, dims: int) -> DataFrame:
    """(to, v): the weighted sum of the neighbours' vectors. Sums are made in each task before the shuffle, so an item or user with a third of all edges
    leaves a task as one row."""
    schema = f"{to} bigint, v array<double>"

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(list(own), pa.int64()), pa.array([x.tolist() for x in own.values()], pa.list_(pa.float64()))], names=[to, "v"])
            own.clear()
            return b

        for b in batches:
            if not b.num_rows:
                continue
            k, w = b.column(0).to_numpy(), b.column(1).to_numpy()
            m = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(k), dims) * w[:, None]
            order = np.argsort(k, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(k[order]) != 0]))
            for i, s in zip(k[order][at].tolist(), np.add.reduceat(m[order], at), strict=True):
                own[i] = own[i] + s if i in own else s
            if len(own) > 100_000:
                yield out()
        yield out()

    part = edges.join(vectors, by).select(F.col(to).cast("long").alias(to), "weight", "v").mapInArrow(total, schema)
    return part.select(to, F.lit(1.0).alias("weight"), "v").repartition(to).mapInArrow(total, schema)


def propagate(edges: DataFrame, users: DataFrame, items: DataFrame, layers: int = 3) -> tuple[DataFrame, DataFrame]:
    """Light graph convolution: (user_id, v) and (item_id, v), the mean of the layers' embeddings (the input, arrays of one length, is layer 0). A layer is one
    join and one sum each way over rows of whole vectors; each is written once, as the next one and the mean read it."""
    edges = keep(edges, "edges")
    first = users.select(F.size("v").alias("n")).first()
    if first is None:
        return users, items
    u, i = keep(users, "layer"), keep(items, "layer")
    us, is_ = [u], [i]
    for _ in range(layers):
        u, i = keep(_spread(edges, i, "item_id", "user_id", first["n"]), "layer"), keep(_spread(edges, u, "user_id", "item_id", first["n"]), "layer")
        us.append(u)
        is_.append(i)

    def mean(parts: list[DataFrame], key: str) -> DataFrame:
        d = parts[0].withColumnRenamed("v", "v0")
        for k, p in enumerate(parts[1:], 1):
            d = d.join(p.withColumnRenamed("v", f"v{k}"), key, "left")
        zero = F.transform("v0", lambda x: F.lit(0.0))
        v = F.col("v0")
        for k in range(1, len(parts)):
            v = F.zip_with(v, F.coalesce(f"v{k}", zero), lambda a, b: a + b)
        return d.select(key, F.transform(v, lambda x: x / len(parts)).alias("v"))

    return mean(us, "user_id"), mean(is_, "item_id")


def next_items(sequences: DataFrame) -> DataFrame:
    """(user_id, pos, item_id, next_item): shifted targets of the train part, as causal models use."""
    w = Window.partitionBy("user_id").orderBy("pos")
    return sequences.filter("split = 'train'").withColumn("next_item", F.lead("item_id").over(w)).filter("next_item is not null").select("user_id", "pos", "item_id", "next_item")


def markov_scores(sequences: DataFrame) -> DataFrame:
    """(item_id, next_item, score): share of an item's successors; a stand-in for sequence models."""
    t = next_items(sequences).groupBy("item_id", "next_item").agg(F.count("*").alias("n"))
    total = t.groupBy("item_id").agg(F.sum("n").alias("all"))
    return t.join(total, "item_id").select("item_id", "next_item", (F.col("n") / F.col("all")).alias("score"))


def cloze_rows(sequences: DataFrame, rate: float = 0.2, seed: int = 42) -> DataFrame:
    """(user_id, pos, item_id, masked, action): positions chosen for a cloze task by a hash; of these 80 % become the mask, 10 % another
    item, 10 % stay."""
    u = F.pmod(F.xxhash64(F.lit(seed), "user_id", "pos"), F.lit(10_000)) / 10_000
    v = F.pmod(F.xxhash64(F.lit(seed + 1), "user_id", "pos"), F.lit(10_000)) / 10_000
    t = sequences.filter("split = 'train'").withColumn("masked", u < rate)
    return t.withColumn("action", F.when(~F.col("masked"), "none").when(v < 0.8, "mask").when(v < 0.9, "random").otherwise("keep")).select("user_id", "pos", "item_id", "masked", "action")


def als_factors(pairs: DataFrame, rank: int = 16, rounds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, features) of users and of items by implicit ALS: the native stand-in for a trained graph model, not that model."""
    from pyspark.ml.recommendation import ALS

    e = pairs.select(F.col("user_id").cast("int"), F.col("item_id").cast("int")).dropna().distinct().withColumn("r", F.lit(1.0))
    m = ALS(rank=rank, maxIter=rounds, seed=seed, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="r").fit(e)
    return m.userFactors, m.itemFactors


def scored_candidates(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(user_id, cand_pos, item_id, is_target, score): a candidate list's items with their scores (item_id, score), null where there is none."""
    rows = candidates.select("user_id", "target", F.posexplode("candidates").alias("cand_pos", "item_id"))
    return rows.join(scores.select(F.col("item_id").cast("string").alias("item_id"), "score"), "item_id", "left").select("user_id", "cand_pos", "item_id", (F.col("item_id") == F.col("target")).alias("is_target"), "score")


def cold_start(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: candidates and targets, and how many were never seen in training."""
    seen = vocabulary.filter("seen_in_train").select(F.col("item_id").cast("string").alias("item_id"), F.lit(True).alias("seen"))
    rows = candidates.select("target", F.explode("candidates").alias("item_id")).join(seen, "item_id", "left")
    new, is_target = F.col("seen").isNull(), F.col("item_id") == F.col("target")
    return rows.agg(F.count("*").alias("candidates"), F.count_if(new).alias("unseen_candidates"), F.count_if(is_target).alias("targets"), F.count_if(is_target & new).alias("unseen_targets"))
