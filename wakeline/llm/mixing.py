"""Mixtures of sources: capped water-filling over shares, then seeded whole and fractional repetitions of documents."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from wakeline.storage import keep

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: how the public byte-level vocabularies part a text before merging: a fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with `tokens bigint`, the size of its column `text` under a public byte-level vocabulary; 0 for null. Whole texts. The vocabulary's file is
    read by the driver and broadcast (under 1 MB)."""
    schema = StructType([*df.drop("tokens").schema.fields, StructField("tokens", LongType())])
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, PATTERN)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "tokens"])

    return df.drop("tokens").mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """A source's clean spelling: lower case, trimmed, runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def water_fill(have: dict[str, int], share: dict[str, float], most: dict[str, int], total: float) -> dict[str, float]:
    """Repetitions (epochs) of each source so that the sizes come to `total` as near to the shares as the caps allow.

    Sources whose share would need more than their cap are clamped there; what they lack is spread over the others in
    proportion to their shares, until no other passes its cap. Sources of no size stay at 0.
    """
    epochs = {s: 0.0 for s in share}
    open_ = {s for s in share if have.get(s, 0) > 0 and share[s] > 0 and most[s] > 0}
    left = float(total)
    while open_ and left > 0:
        weight = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / weight >= most[s] * have[s]}
        if not over:
            for s in open_:
                epochs[s] = left * share[s] / weight / have[s]
            break
        for s in over:
            epochs[s] = float(most[s])
            left -= most[s] * have[s]
        open_ -= over
    return epochs


def largest_exact_total(have: dict[str, int], share: dict[str, float], most: dict[str, int]) -> float:
    """The largest total at which every source that has any text reaches its share (among these) within its cap."""
    some = {s: share[s] for s in share if share[s] > 0 and have.get(s, 0) > 0}
    return min((most[s] * have[s] * sum(some.values()) / w for s, w in some.items()), default=0.0)


def mix(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 42,
    vocabulary: str = VOCABULARY,
    share_of_caps: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(members, report). members: doc_id, source, tokens, copies (1 up) of each document used. report: a row per
    target source with target_share, max_repeats, documents, tokens (one pass), epochs, used_tokens, actual_share.

    docs needs doc_id, text and source, spelled as may be; a doc_id sent again counts once, with its smallest
    (source, text); null ids and null sources are left out, null texts have no tokens. targets are small by nature
    (a row per source) and read by the driver; repeated targets count once. total_tokens: None takes the largest total at which all shares
    are reached; a larger one clamps sources at max_repeats and spreads the rest. share_of_caps sets it to that part of all the caps allow. Empty tables give empty results.

    epochs = whole + fraction: every document is used `whole` times and those first in a seeded order once more, until
    the fraction's tokens are reached (to the nearest document). The order is a hash of (seed, doc_id); its cut is found
    with one histogram of hash ranges and one ordered range per source, so no source is sorted or gathered.
    """
    spark = docs.sparkSession
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().orderBy("source", "target_share", "max_repeats").collect()}
    sizes = "doc_id bigint, source string, tokens bigint, u bigint"
    if not want:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, copies bigint"), spark.createDataFrame([], "source string, target_share double, max_repeats int, documents bigint, tokens bigint, epochs double, used_tokens bigint, actual_share double")
    one = (
        count_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").filter(F.col("doc_id").isNotNull() & F.col("source").isin(list(want))), "text", vocabulary)
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", F.xxhash64("text").alias("x"), "tokens")).alias("m"))
        .select("doc_id", "m.source", "m.tokens", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1).alias("u"))
    )
    one = keep(one, "mixture-sizes")
    assert one.columns == [c.split()[0] for c in sizes.split(", ")]
    have = {r["source"]: r["t"] for r in one.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    share, most = {s: v[0] for s, v in want.items()}, {s: v[1] for s, v in want.items()}
    if share_of_caps is not None:
        total_tokens = share_of_caps * sum(most[s] * have.get(s, 0) for s in want)
    total = largest_exact_total(have, share, most) if total_tokens is None else total_tokens
    epochs = water_fill(have, share, most, total)

    # where the seeded order is cut: first the range of 4096 that holds the cut, then the document within it
    shift = 63 - 12
    hist = one.groupBy("source", F.shiftrightunsigned("u", shift).alias("r")).agg(F.sum("tokens").alias("t")).orderBy("source", "r").collect()
    whole = {s: min(int(epochs[s] + 1e-9), most[s]) for s in want}
    below: dict[str, tuple[int, float]] = {}
    for s in want:
        goal, run = (epochs[s] - whole[s]) * have.get(s, 0), 0
        below[s] = (-1, 0.0)
        if goal > 0:
            for h in (h for h in hist if h["source"] == s):
                if run + h["t"] >= goal:
                    below[s] = (h["r"], goal - run)
                    break
                run += h["t"]
    plan = spark.createDataFrame([(s, whole[s], *below[s]) for s in want], "source string, whole bigint, cut bigint, rest double")
    placed = one.join(F.broadcast(plan), "source").withColumn("r", F.shiftrightunsigned("u", shift))  # plan: a row per target source
    order = Window.partitionBy("source").orderBy("u", "doc_id")
    edge = placed.filter(F.col("r") == F.col("cut")).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    edge = edge.withColumn("more", (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("long")).drop("before")
    rest = placed.filter(F.col("r") != F.col("cut")).withColumn("more", (F.col("r") < F.col("cut")).cast("long"))
    members = rest.unionByName(edge).select("doc_id", "source", "tokens", (F.col("whole") + F.col("more")).alias("copies")).filter("copies > 0")
    used = members.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    spec = spark.createDataFrame([(s, float(share[s]), int(most[s]), float(epochs[s])) for s in want], "source string, target_share double, max_repeats int, epochs double")
    stock = one.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    report = spec.join(stock, "source", "left").join(used, "source", "left").na.fill(0, ["documents", "tokens", "used"])
    report = report.withColumn("actual_share", F.coalesce(F.col("used") / F.nullif(F.sum("used").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
    return members, report.select("source", "target_share", "max_repeats", "documents", "tokens", "epochs", F.col("used").alias("used_tokens"), "actual_share")
