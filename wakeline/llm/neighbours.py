"""Most similar vectors for every vector: shifted Hilbert curves, range-partitioned; each window of a curve is compared as a whole with
itself and its neighbours, and the curves' lists are merged and ranked again. An exact check then completes what the windows cannot prove."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.vectors import EPS, best_centre, bounds, exact_cosine, foreign, matrix, settle, vector_table
from wakeline.storage import keep

_LIST = "key bigint, nbr bigint, cos double"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each integer point (n, dims), coordinates below 2**bits, along the Hilbert curve; bits * dims <= 62.

    Gray-code form: from the highest bit down, a set bit of a coordinate reflects the first one's lower bits and a clear one
    swaps them; the coordinates' bits, interleaved, are the position.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[dims - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Curve:
    """A Hilbert ordering of unit vectors: projected on random orthogonal axes, shifted, put on a grid."""

    def __init__(self, number: int, dims: int, axes: int = 8, bits: int = 7, seed: int = 42):
        r = np.random.default_rng([seed, number])
        self.bits = bits
        self.axes = np.linalg.qr(r.normal(size=(dims, dims)))[0][:, : min(axes, dims)].astype(np.float32)
        self.scale = 4.0 / math.sqrt(dims)  # four standard deviations of a coordinate either way, and the shift
        self.shift = r.uniform(0, 0.5, size=self.axes.shape[1])

    def __call__(self, u: np.ndarray) -> np.ndarray:
        x = (u @ self.axes / self.scale + 1) / 2.5 + self.shift / 2.5
        return hilbert(np.clip(np.floor(x * (1 << self.bits)), 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def nearest(qkey, qraw, qu, tkey, traw, tu, k: int, alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query key, target key, cosine rounded to 9 decimals): the k targets of highest cosine at least `alike` of each query, itself
    left out, ties by the smaller key. tkey ascends. Single precision finds candidates, double precision ranks them."""
    out: list[tuple] = []
    m = len(tkey)
    width = 32
    padded = -(-m // width) * width
    step = int(min(1024, max(64, 12_000_000 // padded)))  # about 50 MB of products at once
    for i in range(0, len(qkey), step):
        n = len(qkey[i : i + step])
        s = np.full((n, padded), -2, np.float32)
        s[:, :m] = qu[i : i + step] @ tu.T
        at = np.minimum(np.searchsorted(tkey, qkey[i : i + step]), m - 1)
        self_ = np.flatnonzero(tkey[at] == qkey[i : i + step])
        s[self_, at[self_]] = -2
        take = k + 3
        groups = padded // width
        if groups > take:  # the best `take` lie in the `take` groups of highest maxima
            top = s.reshape(n, groups, width).max(axis=2)
            g = np.argpartition(top, groups - take, axis=1)[:, groups - take :]
            idx = (g[:, :, None] * width + np.arange(width)).reshape(n, -1)
        else:
            idx = np.broadcast_to(np.arange(padded), (n, padded))
        val = np.take_along_axis(s, idx, axis=1)
        if val.shape[1] > take:
            p = np.argpartition(val, val.shape[1] - take, axis=1)[:, val.shape[1] - take :]
            idx, val = np.take_along_axis(idx, p, axis=1), np.take_along_axis(val, p, axis=1)
        ranked = np.sort(val, axis=1)
        kth = ranked[:, max(0, ranked.shape[1] - k)]
        least = np.maximum(kth - 4 * EPS * 0.1, alike - EPS)
        crowded = (ranked[:, 0] >= least) & (m > take)  # more may tie than were taken
        r, c = np.nonzero((val >= least[:, None]) & ~crowded[:, None])
        c = idx[r, c]
        for row in np.flatnonzero(crowded):
            more = np.flatnonzero(s[row] >= least[row])
            r, c = np.concatenate([r, np.full(len(more), row)]), np.concatenate([c, more])
        if not len(r):
            continue
        cos = exact_cosine(qraw[i + r], traw[c])
        ok = cos >= alike
        r, c, cos = r[ok], c[ok], np.round(cos[ok], 9)
        order = np.lexsort((tkey[c], -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        ok = place < k
        out.append((qkey[i + r[ok]], tkey[c[ok]], cos[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def _curve_centres(table: DataFrame, n: int, curve: Curve, near: float, join: float, most: int = 4096) -> np.ndarray:
    """Centres from pivots along the curve: one vector of each stretch of it (the most significant bits of the position, hashed
    to `most` places), settled by trimmed means; twice more over the vectors near none, on shorter stretches."""
    spark = table.sparkSession
    k = int(min(most, max(16, 4 * math.sqrt(n))))
    centres, before = np.zeros((0, 1), np.float32), n
    total = curve.bits * curve.axes.shape[1]
    for level, bits in enumerate((12, 20, 30)):
        shared = spark.sparkContext.broadcast(centres)

        def pivots(batches: Iterator[pa.RecordBatch], shared=shared, level=level, bits=bits) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[int, bytes]] = {}
            for b in batches:
                key, (_, u) = b.column(0).to_numpy(), matrix(b.column(1))
                if level:
                    ok = best_centre(u, shared.value)[1] < near
                    key, u = key[ok], u[ok]
                if not len(key):
                    continue
                place = (curve(u) >> max(0, total - bits)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                place = (place % np.uint64(k)).astype(np.int64)
                for i in np.lexsort((key, place)):
                    old = best.get(int(place[i]))
                    if old is None or key[i] < old[0]:
                        best[int(place[i])] = (int(key[i]), u[i].tobytes())
            yield pa.record_batch([pa.array(list(best), pa.int64()), pa.array([x[0] for x in best.values()], pa.int64()), pa.array([x[1] for x in best.values()], pa.binary())], names=["place", "key", "v"])

        got = table.select("key", "v").mapInArrow(pivots, "place bigint, key bigint, v binary").groupBy("place").agg(F.min(F.struct("key", "v")).alias("m")).select("m.v").toArrow()
        drawn = matrix(got["v"])[1]
        if not len(drawn):
            break
        pool = np.concatenate([centres, drawn]) if len(centres) else drawn
        centres, far = settle(table, pool, near, join, len(centres) + k)
        if not len(centres) or far < 2000 or far > 0.9 * before:
            break
        before = far
    return centres


def _lists(key, nbr, cos) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key), pa.array(nbr), pa.array(cos)], names=["key", "nbr", "cos"])


def along(table: DataFrame, curve: Curve, n: int, window: int, windows_a_task: int) -> DataFrame:
    """(place, key, v) of the vectors, range-partitioned by their place on the curve, about windows_a_task windows a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            u = matrix(x.column(1))[1]
            yield pa.record_batch([pa.array(curve(u) if len(u) else np.zeros(0, np.int64)), x.column(0), x.column(1)], names=["place", "key", "v"])

    parts = max(1, -(-n // (window * windows_a_task)))
    return table.select("key", "v").mapInArrow(run, "place bigint, key bigint, v binary").repartitionByRange(parts, "place", "key")


def windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice, slice]]:
    """(keys, raw, unit, a window's rows, the rows of it and of its neighbours on both sides) along a partition of a curve."""
    parts = [x for x in batches if x.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).sort_by([("place", "ascending"), ("key", "ascending")])
    key, (raw, u) = t["key"].to_numpy(), matrix(t["v"])
    for i in range(0, len(key), window):
        yield key, raw, u, slice(i, min(i + window, len(key))), slice(max(0, i - window), min(i + 2 * window, len(key)))


def curve_lists(table: DataFrame, n: int, k: int, alike: float, curves: list[Curve], window: int, windows_a_task: int = 8) -> DataFrame:
    """(key, nbr, cos): of each curve, the k nearest of every vector in its window and the two beside it. Work a vector: curves * 3 * window."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, raw, u, own, near in windows_of(batches, window):
            order = np.argsort(key[near])
            t = np.arange(near.start, near.stop)[order]
            yield _lists(*nearest(key[own], raw[own], u[own], key[t], raw[t], u[t], k, alike))

    out = None
    for c in curves:
        one = along(table, c, n, window, windows_a_task).mapInArrow(compare, _LIST)
        out = one if out is None else out.unionByName(one)
    return out


def nearest_vectors(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    alike: float = 0.85,
    dims: int = 64,
    curves: int = 4,
    window: int = 2048,
    near: float = 0.89,
    join: float = 0.87,
    exact: bool = True,
    rest_curves: int = 8,
) -> DataFrame:
    """(key, neighbor, cosine): the up to k other vectors of highest cosine, at least `alike`, of every vector; the cosine
    rounded to 9 decimals, ties to the smaller key.

    Vectors that are null, of another length, not finite or all zero, and null keys, take no part. A key sent again counts once
    (its smallest bytes). Equal vectors are compared once, and each of them gets the smallest keys of its group. An empty table
    gives no rows; other columns are not read.

    Each curve range-partitions the vectors by their place on it; every window of `window` vectors meets itself and the windows
    beside it, whole, and the curves' lists are merged and ranked again. That alone has the recall the README gives.

    With `exact` the lists are then completed where vectors lie in tight cells: the cells' exact bounds (vectors.py) tell which cells may hold
    a vector alike to another's, and the vectors of a cell meet it, and whatever the bounds leave, in blocks of at most 8,192 by
    65,536, so a cell with a third of all rows is spread over many tasks. That work is quadratic in a cell. Vectors near no centre are not
    compared with each other one by one: rest_curves more curves are laid through these alone, which for up to one window and its
    neighbours is every pair and beyond has the curves' recall.
    """
    table, copies = vector_table(df, key, vector, dims)
    spark = table.sparkSession
    n = table.count()
    if not n:
        return spark.createDataFrame([], f"{key} bigint, neighbor bigint, cosine double")
    every = [Curve(c, dims) for c in range(curves)]
    lists = keep(curve_lists(table, n, k, alike, every, window), "window-lists")
    if exact:
        lists = lists.unionByName(_completed(table, n, k, alike, every[0], near, join, rest_curves, dims, window))

    # at most k entries of each curve and block: bounded for a key
    merged = lists.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.negative("cos").alias("c"), "nbr"))), 1, k).alias("l"))
    if copies is None:
        out = merged.select("key", F.explode("l").alias("x")).select("key", "x.nbr", F.negative("x.c").alias("cos"))
    else:
        w = Window.partitionBy("rep").orderBy("key")
        first = copies.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1).groupBy("rep").agg(F.collect_list("key").alias("ks"))
        flat = merged.select("key", F.explode("l").alias("x")).select("key", "x.nbr", F.col("x.c").alias("c"))
        flat = flat.unionByName(first.select(F.col("rep").alias("key"), F.col("rep").alias("nbr"), F.lit(-1.0).alias("c")))
        flat = flat.join(first.withColumnRenamed("rep", "nbr"), "nbr", "left").select("key", "c", F.explode(F.coalesce("ks", F.array("nbr"))).alias("nbr"))
        best = flat.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(F.struct("c", "nbr"))), 1, k + 1).alias("l"))
        each = best.withColumnRenamed("key", "rep").join(copies, "rep", "left").select(F.coalesce("key", "rep").alias("key"), "l")
        out = each.select("key", F.explode(F.slice(F.filter("l", lambda x: x["nbr"] != F.col("key")), 1, k)).alias("x")).select("key", "x.nbr", F.negative("x.c").alias("cos"))
    return out.select(F.col("key").alias(key), F.col("nbr").alias("neighbor"), F.col("cos").alias("cosine"))


def _completed(table: DataFrame, n: int, k: int, alike: float, curve: Curve, near: float, join: float, rest_curves: int, dims: int, window: int) -> DataFrame:
    """(key, nbr, cos): the k nearest of every vector within its own cell and those its bounds leave; for vectors near no centre, along curves of their own."""
    spark = table.sparkSession
    centres = _curve_centres(table, n, curve, near, join)
    b = bounds(table, centres, near, alike)
    cells = len(centres)
    theta = math.acos(alike)
    reach = np.where(b.size > 0, np.cos(np.minimum(theta + b.radius, math.pi)) - EPS, 2.0).astype(np.float32)
    shared = spark.sparkContext.broadcast((centres, reach))

    def demand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many vectors of elsewhere ask in each cell, and how many of those near no centre are to be found there; at -1 the latter's number."""
        c, r = shared.value
        ask, guest, lone = np.zeros(cells, np.int64), np.zeros(cells, np.int64), 0
        for x in batches:
            u = matrix(x.column(1))[1]
            home, cos = best_centre(u, c)
            far = cos < near
            lone += int(far.sum())
            for rows, to, _ in foreign(u, c, r, near):
                ask += np.bincount(to, minlength=cells)
                guest += np.bincount(to[far[rows]], minlength=cells)
        at = np.flatnonzero(ask)
        yield pa.record_batch([pa.array([*at, -1], pa.int64()), pa.array([*ask[at], lone], pa.int64()), pa.array([*guest[at], 0], pa.int64())], names=["c", "ask", "guest"])

    got = table.select("key", "v").mapInArrow(demand, "c bigint, ask bigint, guest bigint").groupBy("c").agg(F.sum("ask").alias("ask"), F.sum("guest").alias("guest")).toArrow()
    at, more = got["c"].to_numpy(), got["ask"].to_numpy()
    lone = int(more[at < 0].sum())
    asks, targets = b.size.copy(), b.size.copy()
    asks[at[at >= 0]] += more[at >= 0]
    targets[at[at >= 0]] += got["guest"].to_numpy()[at >= 0]
    qb, tb = np.maximum(1, -(-asks // 8192)), np.maximum(1, -(-targets // 65536))
    plan = spark.sparkContext.broadcast((qb, tb))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, r), (qb_, tb_) = shared.value, plan.value
        base = np.concatenate([[0], np.cumsum(qb_ * tb_)])
        for x in batches:
            keys, v = x.column(0).to_numpy(), x.column(1)
            u = matrix(v)[1]
            home, cos = best_centre(u, c)
            far = cos < near
            # (row, cell, is to be found there); all of them ask
            own = np.flatnonzero(~far)
            jobs = [(own, home[own], np.ones(len(own), bool))]
            jobs += [(rows, to, far[rows]) for rows, to, _ in foreign(u, c, r, near)]
            out_r, out_c, out_t = (np.concatenate([j[i] for j in jobs]) for i in range(3))
            h = (keys[out_r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            q, t = (h % qb_[out_c].astype(np.uint64)).astype(np.int64), (h // np.uint64(7) % tb_[out_c].astype(np.uint64)).astype(np.int64)
            rows_, grid, role = [], [], []
            for role_, ok, other, own_block in ((1, np.ones(len(out_r), bool), tb_[out_c], q), (2, out_t, qb_[out_c], t)):
                i = np.flatnonzero(ok)
                rep = np.repeat(i, other[i])
                o = np.arange(len(rep)) - np.repeat(np.cumsum(other[i]) - other[i], other[i])
                rows_.append(out_r[rep])
                grid.append(base[out_c[rep]] + (own_block[rep] * tb_[out_c[rep]] + o if role_ == 1 else o * tb_[out_c[rep]] + own_block[rep]))
                role.append(np.full(len(rep), role_))
            rows_, grid, role = (np.concatenate(z) for z in (rows_, grid, role))
            # a vector that asks and is found in the same place is sent once
            code = rows_.astype(np.int64) * (1 << 40) + grid
            order = np.argsort(code, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(order) else order
            role = np.add.reduceat(role[order], head) if len(order) else role
            lead = order[head]
            for i in range(0, len(lead), 20_000):
                s = lead[i : i + 20_000]
                yield pa.record_batch([pa.array(grid[s]), pa.array(keys[rows_[s]]), pa.array(role[i : i + 20_000].astype(np.int32)), v.take(pa.array(rows_[s]))], names=["grid", "key", "role", "v"])

    def complete(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        keys, role, (raw, u) = t["key"].to_numpy(), t["role"].to_numpy(), matrix(t["v"])
        q, f = (role & 1) > 0, (role & 2) > 0
        if not q.any() or not f.any():
            return pa.Table.from_batches([_lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))])
        return pa.Table.from_batches([_lists(*nearest(keys[q], raw[q], u[q], keys[f], raw[f], u[f], k, alike))])

    out = table.select("key", "v").mapInArrow(send, "grid bigint, key bigint, role int, v binary").groupBy("grid").applyInArrow(complete, _LIST)
    if not lone:
        return out

    def near_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = np.flatnonzero(best_centre(matrix(x.column(1))[1], shared.value[0])[1] < near)
            yield x.take(pa.array(ok))

    rest = keep(table.select("key", "v").mapInArrow(near_none, "key bigint, v binary"), "rest")
    laid = [Curve(100 + c, dims) for c in range(rest_curves if lone > 2 * window else 1)]  # two windows are beside each other on any curve
    return out.unionByName(curve_lists(rest, lone, k, alike, laid, window))


def mutual_pairs(neighbours: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(a, b), a < b: pairs of which at least one is a neighbor of the other."""
    return neighbours.select(F.least(key, "neighbor").alias(a), F.greatest(key, "neighbor").alias(b)).distinct()
