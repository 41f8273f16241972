"""Frequent subsequences with gaps: event positions as bit vectors, patterns grown by shift-and-intersect, depth first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.storage import keep

_OUT = pa.schema([("pattern", pa.list_(pa.string())), ("entities", pa.int64())])


def _bitmaps(batches: Iterator[pa.RecordBatch], gap: int, least: Callable[[int], int], only: set[str] | None) -> tuple[dict[str, int], np.ndarray] | None:
    """A bit vector for each state that can be part of a pattern (one of `only`, or held by least(entities of the task) entities) and the first
    bit of each entity. Entities lie `gap` empty bits apart, so no shift reaches the next one. As a state held by a share of the entities takes that many positions, the vectors
    kept are at most 1 / share times as long as the task's events, however many states there are."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    t = pa.Table.from_batches(parts)
    ent = t["entity"].combine_chunks().dictionary_encode().indices.to_numpy()
    code = t["state"].combine_chunks().dictionary_encode()
    change = np.flatnonzero(np.diff(ent)) + 1
    ordinal = np.zeros(len(ent), np.int64)
    ordinal[change] = 1
    at = np.arange(len(ent)) + gap * np.cumsum(ordinal)
    starts = at[np.concatenate([[0], change])]
    maps, idx = {}, code.indices.to_numpy().astype(np.int64)
    names, rank = code.dictionary.to_pylist(), np.cumsum(ordinal)
    held = np.bincount(np.unique(idx * (rank[-1] + 1) + rank) // (rank[-1] + 1), minlength=len(names))
    order = np.argsort(idx, kind="stable")
    cut = np.searchsorted(idx[order], np.arange(len(names) + 1))
    for i, name in enumerate(names):
        if name in only if only is not None else held[i] >= least(len(starts)):
            bits = np.zeros(int(at[-1]) + 1, np.uint8)
            bits[at[order[cut[i] : cut[i + 1]]]] = 1
            maps[name] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return maps, starts


def _entities(bits: int, starts: np.ndarray) -> int:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    own = np.searchsorted(starts, np.flatnonzero(np.unpackbits(raw, bitorder="little")), "right")
    return int((np.diff(own) > 0).sum()) + 1


def _mine(maps, starts, gap, max_len, keep_at, follow):
    """(pattern, entities) depth first. follow: None, or the set of patterns (with all prefixes) to count."""

    def grow(pattern: tuple, ends: int):
        reach = 0
        for d in range(1, gap + 1):
            reach |= ends << d
        for s, m in maps.items():
            longer = (*pattern, s)
            if follow is not None and longer not in follow:
                continue
            hit = reach & m
            if hit.bit_count() >= keep_at:  # no more entities than bits
                n = _entities(hit, starts)
                if n >= keep_at:
                    yield longer, n
                    if len(longer) < max_len:
                        yield from grow(longer, hit)

    for s, m in maps.items():
        if follow is None or (s,) in follow:
            if m.bit_count() >= keep_at and (n := _entities(m, starts)) >= keep_at:
                yield (s,), n
                yield from grow((s,), m)


def frequent_sequences(
    df: DataFrame,
    entity: str,
    order: str,
    state: str,
    min_entities: int = 3,
    min_share: float = 0.02,
    max_gap: int = 3,
    min_len: int = 2,
    max_len: int = 4,
    entities_per_task: int = 4000,
) -> DataFrame:
    """(pattern array<string>, entities): state lists that occur in order, each next state 1 to max_gap places on,
    in at least min_entities entities and min_share of all.

    An entity's sequence is its states by `order`, each place once: rows that share entity and order count as one,
    with the largest state. Rows with a null entity, order or state are left out; an empty table gives no rows; other columns are
    not read.

    Two depth-first passes over tasks of about entities_per_task entities each. A pattern frequent overall is
    frequent, at the same share, in some task; the first pass collects those candidates, of which a task can have
    only as many as its entities' patterns over the share; the second counts exactly these everywhere. An entity
    with a third of all rows is one long bit vector of its task, counted once.
    """
    spark = df.sparkSession
    seq = (
        df.select(F.col(entity).alias("entity"), F.col(order).alias("place"), F.col(state).cast("string").alias("state"))
        .dropna()
        .groupBy("entity", "place")
        .agg(F.max("state").alias("state"))
    )
    n = seq.agg(F.countDistinct("entity")).first()[0]
    if not n:
        return spark.createDataFrame([], "pattern array<string>, entities bigint")
    need = max(min_entities, int(np.ceil(round(min_share * n, 9))))
    tasks = max(1, n // entities_per_task)  # none has so few entities that a share of them is one
    seq = keep(seq, "sequences")
    by_task = seq.repartition(tasks, "entity").sortWithinPartitions("entity", "place").select("entity", "state")

    def one_pass(follow: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share = lambda entities: max(1, -(-need * entities // n))
            got = _bitmaps(batches, max_gap, share, None if follow is None else {s for p in follow for s in p})
            if got is None:
                return
            maps, starts = got
            least = 1 if follow is not None else share(len(starts))
            rows = [(list(p), c) for p, c in _mine(maps, starts, max_gap, max_len, least, follow)]
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.record_batch([pa.array([p for p, _ in part], pa.list_(pa.string())), pa.array([c for _, c in part], pa.int64())], schema=_OUT)

        return by_task.mapInArrow(run, "pattern array<string>, entities bigint")

    found = one_pass(None)
    if tasks > 1:
        likely = frozenset(tuple(r["pattern"]) for r in found.select("pattern").distinct().toLocalIterator())
        found = one_pass(likely).groupBy("pattern").agg(F.sum("entities").alias("entities"))
    return found.filter((F.size("pattern") >= min_len) & (F.col("entities") >= need))
