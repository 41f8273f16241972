"""Clusters of mutually similar records: hashed weighted features, distributed k-means with parallel oversampled seeding,
members nearest each centroid, and an exact check of every cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.near_duplicates import components
from wakeline.llm.vectors import EPS, best_centre, bounds, draw_far, exact_cosine, foreign, hashed_texts, matrix, means, settle, usable_vectors, vector_table
from wakeline.storage import keep


def kmeans(table: DataFrame, n: int, near: float, join: float, seed: int = 42, most: int = 4096) -> np.ndarray:
    """Centres of spherical, trimmed k-means: seeding draws 2 sqrt(n) vectors (at most `most`) in each of three parallel
    rounds by squared distance, the oversampled seeds are reduced by weight, then Lloyd rounds follow. While many vectors stay near no
    centre, the same is done for these alone. The centres number at most 3 * most, whatever the data."""
    k = int(min(most, max(16, 2 * math.sqrt(n))))
    centres, far_before = np.zeros((0, 0), np.float32), n
    for level in range(3):
        beyond = near if level else None
        pool = centres
        for r in range(3):
            drawn = draw_far(table, pool, k if r else max(16, k // 4), seed + 10 * level + r, beyond)
            pool = np.concatenate([pool, drawn]) if pool.size else drawn
        if not len(pool):
            return np.zeros((0, 1), np.float32)
        centres, far = settle(table, pool, near, join, len(centres) + k if centres.size else k)
        if not len(centres) or far < 2000 or far > 0.9 * far_before:
            break
        far_before = far
    return centres


def _emit(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def _check(t: pa.Table, alike: float) -> pa.Table:
    """Of two blocks of a cell's rim and of the intruders that came: ('c', cell) linked to what its vectors show. A row (cell, '!') marks
    a cell whose members aren't all alike; links name intruders' own cells, or their keys where they have none."""
    key, home, cell, block = t["key"].to_numpy(), t["home"].to_numpy(), int(t["cell"][0].as_py()), t["g"].to_numpy()
    raw, u = matrix(t["v"])
    one, other = block == block.min(), block == block.max()
    lone = int(t["lo"][0].as_py()) != int(t["hi"][0].as_py()) and block.min() == block.max()  # the other block is empty
    out = []
    for inside in () if lone else (True, False):
        for a, b in ((one, other),) if inside or block.min() == block.max() else ((one, other), (other, one)):
            i, j = np.flatnonzero(((home == cell) == inside) & a), np.flatnonzero((home == cell) & b)
            for x in range(0, len(i), 1024):
                p = i[x : x + 1024]
                s = u[p] @ u[j].T
                if inside:
                    r, c = np.nonzero(s < alike + EPS)
                    if len(r) and (exact_cosine(raw[p[r]], raw[j[c]]) < alike).any():
                        out.append((f"c{cell}", "!"))
                        break
                else:
                    r, c = np.nonzero(s >= alike - EPS)
                    ok = exact_cosine(raw[p[r]], raw[j[c]]) >= alike if len(r) else np.zeros(0, bool)
                    out += [(f"c{cell}", f"c{home[k]}" if home[k] >= 0 else f"r{key[k]}") for k in np.unique(p[r[ok]])]
    out = sorted(set(out))
    return pa.table({"x": pa.array([a for a, _ in out], pa.string()), "y": pa.array([b for _, b in out], pa.string())})


def _rest_links(t: pa.Table, alike: float) -> pa.Table:
    """Of two blocks of vectors near no centre, or one: links (a, b) that connect all that are alike across the two, or within the one. A forest, so no more rows than vectors."""
    t = t.sort_by("key")
    key, g, (raw, u) = t["key"].to_numpy(), t["g"].to_numpy(), matrix(t["v"])
    one, other = np.flatnonzero(g == t["lo"][0].as_py()), np.flatnonzero(g == t["hi"][0].as_py())
    lead = np.arange(len(key))
    for x in range(0, len(one), 512):
        i = one[x : x + 512]
        p, q = np.nonzero(u[i] @ u[other].T >= alike - EPS)
        p, q = i[p], other[q]
        ok = p != q
        p, q = p[ok], q[ok]
        ok = exact_cosine(raw[p], raw[q]) >= alike if len(p) else np.zeros(0, bool)
        for i, j in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
            while lead[i] != i:
                lead[i] = i = lead[lead[i]]
            while lead[j] != j:
                lead[j] = j = lead[lead[j]]
            if i != j:
                lead[max(i, j)] = min(i, j)
    at = np.flatnonzero(lead != np.arange(len(lead)))
    return pa.table({"a": pa.array(key[at]), "b": pa.array(key[lead[at]])})


def rest_links(rest: DataFrame, n: int, alike: float, window: int, most: int = 65_536) -> DataFrame:
    """(a, b): links that connect all of n vectors (key, v) that are alike, every pair compared: quadratic work, in blocks of `window` to `most` vectors."""
    blocks = max(-(-n // most), min(8, -(-n // window)), 1)
    sent = rest.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("g", "o").alias("lo"), F.greatest("g", "o").alias("hi"), "g", "key", "v")
    return sent.groupBy("lo", "hi").applyInArrow(lambda t: _rest_links(t, alike), "a bigint, b bigint").distinct()


def largest_first(u: np.ndarray, raw: np.ndarray, alike: float, held: int = 50_000) -> np.ndarray:
    """Of unit rows in order of their keys, the first row of the set each belongs to. The row alike to most rows left starts a set, and of the rows
    alike to all of the set the one alike to most others of these joins, until none is left (ties: the smaller key); then
    the next set is formed of the rest. Where linked rows are all alike, that is the linked rows. Which of up to `held` candidates are alike is kept as bits, of
    more it is computed again as rows drop out, so memory is in proportion to the rows."""

    def alike_bits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty((len(i), (len(j) + 7) // 8), np.uint8)
        step = max(1, min(1024, (1 << 25) // max(1, len(j))))
        for x in range(0, len(i), step):
            s = u[i[x : x + step]] @ u[j].T
            hit = s >= alike
            p, q = np.nonzero(np.abs(s - alike) < EPS)
            if len(p):
                hit[p, q] = exact_cosine(raw[i[x + p]], raw[j[q]]) >= alike
            hit[i[x : x + step, None] == j[None, :]] = False
            out[x : x + step] = np.packbits(hit, axis=1)
        return out

    def degrees(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, min(4096, (1 << 30) // max(1, len(j))))
        return np.concatenate([np.bitwise_count(alike_bits(i[x : x + step], j)).sum(axis=1, dtype=np.int64) for x in range(0, len(i), step)]) if len(i) else np.zeros(0, np.int64)

    lead, left = np.arange(len(u)), np.arange(len(u))
    degree = degrees(left, left)
    while len(left) and degree.max() > 0:
        start = left[degree.argmax()]
        near = left[np.unpackbits(alike_bits(np.array([start]), left)[0], count=len(left)).astype(bool)]
        bits = alike_bits(near, near) if len(near) <= held else None
        free = np.ones(len(near), bool)
        own = degrees(near, near) if bits is None else np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        members = [start]
        while free.any():
            if own[free].min() == free.sum() - 1:  # all that are left are alike
                members += near[free].tolist()
                break
            best = int(np.where(free, own, -1).argmax())
            members.append(int(near[best]))
            row = alike_bits(near[[best]], near)[0] if bits is None else bits[best]
            keep_ = free & np.unpackbits(row, count=len(near)).astype(bool)
            gone = free & ~keep_
            if bits is not None:
                own -= np.bitwise_count(bits & np.packbits(gone)).sum(axis=1, dtype=np.int64)
            elif keep_.any():
                own[keep_] -= degrees(near[keep_], near[gone])
            free = keep_
        members = np.array(sorted(members))
        lead[members] = members[0]
        rest = ~np.isin(left, members)
        left, degree = left[rest], degree[rest] - degrees(left[rest], members)
    return lead


def _divide(t: pa.Table, alike: float, held: int) -> pa.Table:
    t = t.sort_by("key")
    key, (raw, u) = t["key"].to_numpy(), matrix(t["v"])
    return pa.table({"lead": pa.array(key[largest_first(u, raw, alike, held)]), "key": pa.array(key)})


def clusters(
    df: DataFrame,
    key: str,
    vector: str,
    dims: int = 64,
    alike: float = 0.85,
    near: float = 0.89,
    join: float = 0.87,
    seed: int = 42,
    rim_block: int = 8192,
    window: int = 2048,
    divide_rows: int = 50_000,
) -> DataFrame:
    """(cluster_key, key): members of each cluster of two or more; cluster_key is its smallest key.

    Members of a cluster are all alike (cosine at least `alike`) to each other, and clusters don't overlap. Where the
    vectors linked to each other are all alike, they are one cluster; where not, the linked group is divided into sets that are all alike,
    largest first (largest_first: by degree, as the largest of all can't be found in bounded time). Vectors that are null, of
    another length, not finite or all zero, and null keys, are in no cluster. A key sent again counts once (its smallest bytes); equal
    vectors are compared once and come out with all their keys. An empty table gives no rows; other columns are not read.

    k-means finds the cells. Then every vector is held against the exact bounds of all cells: members within half the
    angle of alikeness of their centre need no check; the rim is compared within the cell, and with the vectors of elsewhere that
    come into question, in blocks. Vectors near no centre are compared with each other, every pair of them, in blocks of `window` or more: quadratic
    work. Only cells that fail, and linked rests, are gathered and divided, a linked group in one task, whatever its size; memory is in proportion to the group
    (of up to divide_rows candidates for a set, the bits that tell which are alike are kept besides). No size changes the result.
    """
    table, copies = vector_table(df, key, vector, dims, buckets=1 << max(0, (dims - 1).bit_length()))
    spark = table.sparkSession
    n = table.count()
    schema = "cluster_key bigint, key bigint"
    if not n:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    centres = kmeans(table, n, near, join, seed)
    b = bounds(table, centres, near, alike)
    theta = math.acos(alike)
    shared = spark.sparkContext.broadcast((centres, np.where(b.size > 0, np.cos(np.minimum(theta + b.radius, math.pi)) - EPS, 2.0).astype(np.float32), b))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value[0]
        for x in batches:
            nearest, cos = best_centre(matrix(x.column(1))[1], c)
            yield pa.record_batch([x.column(0), pa.array(np.where(cos < near, -1, nearest).astype(np.int32))], names=["key", "home"])

    def rim_rows(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of the rows that must be compared in a cell: its rim, and intruders."""
        c, reach, bb = shared.value
        limit = np.minimum(theta - bb.radius, bb.intruder - theta) - 1e-3
        home, cos = best_centre(u, c)
        home[cos < near] = -1
        own = np.flatnonzero((home >= 0) & (np.arccos(np.clip(cos, -1, 1)) >= limit[home]))
        guests = [(r, cells) for r, cells, _ in foreign(u, c, reach, near)]
        row = np.concatenate([own, *(r for r, _ in guests)])
        return row, np.concatenate([home[own], *(x for _, x in guests)]), home[row]

    def rim_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centres), np.int64)
        for x in batches:
            n += np.bincount(rim_rows(matrix(x.column(0))[1])[1], minlength=len(centres))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["c", "n"])

    got = table.select("v").mapInArrow(rim_sizes, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    blocks = np.ones(len(centres) + 1, np.int64)
    blocks[got["c"].to_numpy()] = -(-got["n"].to_numpy() // rim_block)  # a crowded rim is compared block by block
    parts = spark.sparkContext.broadcast(blocks)

    def rim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            key_, v = x.column(0).to_numpy(), x.column(1).to_pylist()
            row, cell, home = rim_rows(matrix(x.column(1))[1])
            many = parts.value[cell]
            g = ((key_[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many
            rep = np.repeat(np.arange(len(row)), many)
            o = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            rows = [(int(cell[k]), int(min(g[k], b)), int(max(g[k], b)), int(g[k]), int(key_[row[k]]), int(home[k]), v[row[k]]) for k, b in zip(rep.tolist(), o.tolist(), strict=True)]
            yield _emit(rows, ["cell", "lo", "hi", "g", "key", "home", "v"], [pa.int64()] * 6 + [pa.binary()])

    placed = keep(table.mapInArrow(place, "key bigint, home int"), "placed")
    links = keep(table.mapInArrow(rim, "cell bigint, lo bigint, hi bigint, g bigint, key bigint, home bigint, v binary").groupBy("cell", "lo", "hi").applyInArrow(lambda t: _check(t, alike), "x string, y string").distinct(), "cell-links")
    rest = keep(table.join(placed.filter("home < 0").select("key"), "key"), "rest")
    lone = rest.count()
    edges = rest_links(rest, lone, alike, window).select(F.concat(F.lit("r"), "a").alias("x"), F.concat(F.lit("r"), "b").alias("y"))
    edges = keep(links.filter("y <> '!'").unionByName(edges).distinct(), "links")
    group = components(edges, "x", "y")
    odd = links.filter("y = '!'").select(F.col("x").alias("node")).distinct().join(group, "node", "left_anti").select("node", F.col("node").alias("component"))
    group = keep(group.unionByName(odd), "odd-groups")

    # odd groups are divided; all other cells are clusters as they stand
    node = F.when(F.col("home") >= 0, F.concat(F.lit("c"), "home")).otherwise(F.concat(F.lit("r"), "key"))
    named = placed.withColumn("node", node).join(group, "node", "left")
    odd_rows = keep(named.filter("component is not null").select("component", "key").join(table, "key"), "odd-rows")
    divided = odd_rows.groupBy("component").applyInArrow(lambda t: _divide(t.select(["key", "v"]), alike, divide_rows), "lead bigint, key bigint").select(F.col("lead").alias("cluster_key"), "key")
    whole = named.filter("component is null and home >= 0").select("home", "key")
    first = whole.groupBy("home").agg(F.min("key").alias("cluster_key"))  # a row a cell: bounded by the number of centres
    out = divided.unionByName(whole.join(F.broadcast(first), "home").select("cluster_key", "key"))
    if copies is not None:
        out = out.withColumnRenamed("key", "rep").join(copies, "rep", "left").select("cluster_key", F.coalesce("key", "rep").alias("key"))
    size = out.groupBy("cluster_key").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_key")
    return out.join(size, "cluster_key", "left_semi").select("cluster_key", F.col("key").alias(key))


def member_cosines(members: DataFrame, df: DataFrame, key: str, vector: str, dims: int = 64) -> DataFrame:
    """members (cluster_key, key) with centroid_cosine: to the mean of the cluster's own unit vectors. The means are summed in each task
    before they are shuffled, so a cluster with a third of all rows leaves a task as one row; they are joined back by cluster."""
    rows = keep(members.select("cluster_key", F.col(key).alias("key")).join(usable_vectors(df, key, vector, dims).select("key", "v"), "key"), "member-vectors")
    schema = "cluster_key bigint, s binary"

    def summed(unit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}

            def out() -> pa.RecordBatch:
                b = pa.record_batch([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["cluster_key", "s"])
                total.clear()
                return b

            for b in batches:
                if not b.num_rows:
                    continue
                c = b.column(0).to_numpy()
                if unit:
                    raw = matrix(b.column(1))[0].astype(np.float64)
                    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                else:
                    x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(len(c), -1)
                order = np.argsort(c, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(c[order]) != 0]))
                for k, s in zip(c[order][at].tolist(), np.add.reduceat(x[order], at), strict=True):
                    total[k] = total[k] + s if k in total else s
                if unit and len(total) > 50_000:
                    yield out()
            yield out()

        return run

    part = rows.select("cluster_key", "v").mapInArrow(summed(True), schema)
    mean = part.repartition("cluster_key").mapInArrow(summed(False), schema)

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = matrix(b.column(2))[0].astype(np.float64)
            s = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(len(raw), -1) if b.num_rows else raw
            d = np.sqrt(np.einsum("ij,ij->i", raw, raw) * np.einsum("ij,ij->i", s, s))
            cos = np.einsum("ij,ij->i", raw, s) / np.maximum(d, 1e-300)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.round(cos, 9))], names=["cluster_key", "key", "centroid_cosine"])

    joined = rows.join(mean, "cluster_key").select("cluster_key", "key", "v", "s")
    return joined.mapInArrow(cosine, "cluster_key bigint, key bigint, centroid_cosine double").withColumnRenamed("key", key)


def describe(members: DataFrame, df: DataFrame, key: str, text: str, typical: int = 3) -> DataFrame:
    """(cluster_key, size, typical array<string>) of members (cluster_key, key, centroid_cosine): each cluster's size and the texts of
    its members nearest to the centroid (ties: the smaller key; a null text stays null; of a key sent again the smallest text counts)."""
    size = members.groupBy("cluster_key").agg(F.count("*").alias("size"))
    w = Window.partitionBy("cluster_key").orderBy(F.desc("centroid_cosine"), key)
    top = members.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= typical).select("cluster_key", "place", key)
    texts = df.select(key, text).join(top.select(key), key, "left_semi").groupBy(key).agg(F.min(text).alias("text"))
    named = top.join(texts, key, "left").groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return size.join(named, "cluster_key").select("cluster_key", "size", F.col("t.text").alias("typical"))


def text_clusters(df: DataFrame, key: str, text: str, k: int = 64, buckets: int = 256, seed: int = 42, rounds: int = 10) -> DataFrame:
    """(cluster_key, key, centroid_cosine): every text in one of up to k clusters by its words, cluster_key the smallest key of its cluster.

    Words become hashed weighted features (vectors.hashed_texts); seeds are drawn in three parallel rounds, 2 k each, by squared
    distance from those before, the k of most weight stay, and spherical k-means runs `rounds` rounds, each one scan with partial
    sums. Null keys, null texts and texts without words are in no cluster; of a key sent again one row counts; an empty table gives no rows.
    """
    features = keep(hashed_texts(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text)), key, text, buckets), "features")
    table, copies = vector_table(features, key, "vector", buckets)
    pool = np.zeros((0, buckets), np.float32)
    for r in range(3):
        drawn = draw_far(table, pool, 2 * k if r else k, seed + r, None)
        pool = np.concatenate([pool, drawn]) if len(pool) else drawn
    spark = df.sparkSession
    if not len(pool):
        return spark.createDataFrame([], "cluster_key bigint, key bigint, centroid_cosine double").withColumnRenamed("key", key)
    centres, _ = settle(table, pool, -2.0, 2.0, k, 1)
    for _ in range(rounds):
        before = centres
        centres, n, _ = means(table, centres, -2.0)
        centres = centres[n > 0]
        if centres.shape == before.shape and np.abs(centres - before).max() < 1e-6:
            break
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(best_centre(matrix(b.column(1))[1], shared.value)[0].astype(np.int32))], names=["key", "home"])

    placed = keep(table.mapInArrow(place, "key bigint, home int"), "placed-texts")
    if copies is not None:
        placed = placed.withColumnRenamed("key", "rep").join(copies, "rep", "left").select(F.coalesce("key", "rep").alias("key"), "home")
    first = placed.groupBy("home").agg(F.min("key").alias("cluster_key"))  # k rows
    members = placed.join(F.broadcast(first), "home").select("cluster_key", F.col("key").alias(key))
    return member_cosines(members, features, key, "vector", buckets)
