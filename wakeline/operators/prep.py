"""Interactions to histories: latest rating per pair, length bounds, popularity, leave-two-out, sampled negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.storage import keep

#: an item catalogue is broadcast up to this many items (16 bytes each)
CATALOGUE_LIMIT = 20_000_000


def seconds(ts):
    """Epoch seconds; values in milliseconds are told by their size."""
    return F.when(ts > 100_000_000_000, F.floor(ts / 1000)).otherwise(ts)


def latest_interactions(ratings: DataFrame, min_rating: float = 0.5) -> DataFrame:
    """(user_id, item_id, rating, ts): the latest rating of each pair among those of at least min_rating, ties by the higher rating.
    Rows without user, item, rating or time are left out."""
    return (
        ratings.select("user_id", "item_id", "rating", seconds(F.col("ts")).cast("long").alias("ts"))
        .dropna()
        .filter(F.col("rating") >= min_rating)
        .groupBy("user_id", "item_id")
        .agg(F.max(F.struct("ts", "rating")).alias("m"))
        .select("user_id", "item_id", "m.rating", "m.ts")
    )


def within_length(latest: DataFrame, least: int = 10, most: int = 5000) -> DataFrame:
    """Interactions of users with least to most unique items (most <= 0: no upper bound). The counts are made before the join, so no user is gathered."""
    n = latest.groupBy("user_id").agg(F.count("*").alias("n_items")).filter(F.col("n_items") >= least)
    return latest.join(n.filter(F.col("n_items") <= most) if most > 0 else n, "user_id")


def popularity(histories: DataFrame) -> DataFrame:
    return histories.groupBy("item_id").agg(F.count("*").alias("users"))


def corpus_stats(histories: DataFrame) -> DataFrame:
    per_user = histories.groupBy("user_id").agg(F.count("*").alias("n"))
    a = per_user.agg(F.count("*").alias("users"), F.sum("n").alias("interactions"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))
    return a.crossJoin(histories.agg(F.countDistinct("item_id").alias("items")))  # one row by one row


def leave_two_out(histories: DataFrame) -> DataFrame:
    """(user_id, pos, item_id, split): by time and item; the last is test, the one before val, the rest train."""
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    left = F.col("n_items") - F.col("pos")
    split = F.when(left == 1, "test").when(left == 2, "val").otherwise("train")
    return histories.withColumn("pos", F.row_number().over(w) - 1).select("user_id", "pos", "item_id", split.alias("split"))


def last_n(sequences: DataFrame, n: int) -> DataFrame:
    """(user_id, items): the last n train items, oldest first. A top-n window, then lists of at most n."""
    w = Window.partitionBy("user_id").orderBy(F.desc("pos"))
    top = sequences.filter("split = 'train'").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("items"))


def train_vocabulary(catalogue: DataFrame, sequences: DataFrame) -> DataFrame:
    """(item_id string, source, first_user, first_seen): catalogue ids (source 0) first, then ids seen in training only, in order of users and of their histories; each once, where
    it is first seen. Ordered by the last three columns, ties by item, it is the vocabulary."""
    a = catalogue.select(F.col("item_id").cast("string").alias("item_id"), F.lit(0).alias("source"), F.lit(0).cast("long").alias("first_user"), F.lit(0).cast("long").alias("first_seen"))
    b = sequences.filter("split = 'train'").select(F.col("item_id").cast("string").alias("item_id"), F.lit(1).alias("source"), F.col("user_id").cast("long").alias("first_user"), F.col("pos").cast("long").alias("first_seen"))
    return a.unionByName(b).groupBy("item_id").agg(F.min(F.struct("source", "first_user", "first_seen")).alias("m")).select("item_id", "m.source", "m.first_user", "m.first_seen")


def uniform_hash(*parts):
    """A 48-bit number from the parts, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def popularity_negatives(histories: DataFrame, per_user: int = 19, seed: int = 42, splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(user_id, split, slot, item_id): per_user items a user has not touched, drawn without replacement in proportion to popularity.

    Draw j of a user falls on the item whose stretch of the cumulated popularity holds hash(seed, split, user, j); draws of
    items touched or drawn before are rejected. Draws are made in rounds of 32, 256, 2,048 ... for the users still short, so a
    user costs what their own history asks for; the items' stretches are two arrays of a catalogue's size, checked before they are
    broadcast. A user for whom a million draws don't suffice raises.
    """
    spark = histories.sparkSession
    histories = keep(histories.select("user_id", "item_id"), "touched")  # read by every round
    pop = popularity(histories).orderBy("item_id")
    items = pop.count()
    if items > CATALOGUE_LIMIT:
        raise ValueError(f"{items} items: over the catalogue that is broadcast")
    got = pop.toArrow()
    upper = np.cumsum(got["users"].to_numpy()) if items else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((upper, got["item_id"].to_numpy()))
    total = int(upper[-1]) if items else 1

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, ids = shared.value
        for b in batches:
            at = np.searchsorted(up, b.column(3).to_numpy(), "right")
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(ids[at])], names=["user_id", "split", "draw", "item_id"])

    short = histories.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, splits))).alias("split"))
    touched = histories.select("user_id", "item_id")
    done, draws = None, 32
    while True:
        u = uniform_hash(F.lit(seed), F.col("split"), F.col("user_id"), F.col("draw")) % total
        tries = short.select("user_id", "split", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("u", u)
        fresh = tries.mapInArrow(land, "user_id bigint, split string, draw int, item_id bigint").groupBy("user_id", "split", "item_id").agg(F.min("draw").alias("draw"))
        fresh = fresh.join(touched, ["user_id", "item_id"], "left_anti")
        w = Window.partitionBy("user_id", "split").orderBy("draw")
        taken = keep(fresh.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= per_user), "negatives")
        full = taken.filter(F.col("slot") == per_user).select("user_id", "split")
        part = taken.join(full, ["user_id", "split"], "left_semi").select("user_id", "split", "slot", "item_id")
        done = part if done is None else done.unionByName(part)
        short = keep(short.join(full, ["user_id", "split"], "left_anti"), "short-users")
        if not short.limit(1).count():
            return done
        if draws >= 1 << 20:
            raise ValueError("users with too few items left to draw from")
        draws *= 8


def negative_violations(negatives: DataFrame, histories: DataFrame, per_user: int = 19) -> DataFrame:
    """Users and splits with a wrong number of negatives, repeated ones, or one of their own items."""
    n = negatives.groupBy("user_id", "split").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("unique_items"))
    own = negatives.join(histories, ["user_id", "item_id"], "left_semi").groupBy("user_id", "split").agg(F.count("*").alias("own"))
    return n.join(own, ["user_id", "split"], "left").na.fill(0, ["own"]).filter((F.col("n") != per_user) | (F.col("unique_items") != F.col("n")) | (F.col("own") > 0))
