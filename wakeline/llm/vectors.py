"""Vectors as tables of raw bytes, and tight cells around centres with exact bounds on where alike vectors can be.

All similarity is the cosine. A cell is a centre and the vectors nearest to it within `near`; its radius is the largest
angle among them. By the triangle inequality a vector can be alike to a member of a cell only if its angle to the cell's
centre is at most the angle of alikeness plus the radius, which leaves few cells to look at and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import words
from wakeline.storage import keep

#: added to bounds that are tested in single precision
EPS = 1e-5


def hashed_slots(n: int, buckets: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of features 0..n-1. For n <= buckets (a power of two) an odd multiplier makes it one to one, so that
    cosines stay as they are; beyond, features share buckets with random signs, as feature hashing does."""
    i = np.arange(n, dtype=np.uint64)
    bucket = (i * np.uint64(0x9E3779B1 | 1) + np.uint64(seed)) % np.uint64(buckets)
    sign = np.array([1.0 if xxhash.xxh32_intdigest(f"{seed}:{k}") & 1 else -1.0 for k in range(n)], np.float32)
    return bucket.astype(np.int64), sign


def hashed_texts(df: DataFrame, key: str, text: str, buckets: int = 256, table_size: int = 1 << 18) -> DataFrame:
    """(key, vector array<float>): words as hashed, signed features weighted by (1 + ln of their count) * ln((1 + n) / (1 + rows that hold
    the word)), unit length; null where no word weighs anything. Rows are counted exactly, in a table of fixed size by word hash."""

    def hashes(t: str | None) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([xxhash.xxh64_intdigest(w) for w in words(t)], np.uint64)
        return np.unique(h, return_counts=True) if len(h) else (h, np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(table_size, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for t in b.column(0).to_pylist():
                n[(hashes(t)[0] % np.uint64(table_size)).astype(np.int64)] += 1
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(n[at], rows))], names=["c", "n"])

    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    got = src.select("t").mapInArrow(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    c, n = got["c"].to_numpy(), got["n"].to_numpy()
    weight = np.zeros(table_size)
    weight[c[c >= 0]] = n[c >= 0]
    shared = df.sparkSession.sparkContext.broadcast(np.log((1 + n[c < 0].sum()) / (1 + weight)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                h, k = hashes(t)
                x = np.zeros(buckets)
                if len(h):
                    w = (1 + np.log(k)) * shared.value[(h % np.uint64(table_size)).astype(np.int64)]
                    np.add.at(x, ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), w * np.where(h >> np.uint64(63), 1, -1))
                norm = float(np.linalg.norm(x))
                out.append((x / norm).astype(np.float32) if norm > 1e-9 else None)
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["key", "vector"])

    return src.mapInArrow(run, "key bigint, vector array<float>").withColumnRenamed("key", key)


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int, buckets: int | None = None) -> DataFrame:
    """(key bigint, h binary, v binary): usable vectors (dims finite numbers, not all zero), each key once, with a digest.

    A key sent again counts once, with its smallest bytes. With `buckets`, dimensions are put in hashed slots.
    """
    slots = hashed_slots(dims, buckets) if buckets else None
    width = buckets or dims

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            size = np.where(np.asarray(col.is_valid()), np.diff(col.offsets.to_numpy()), -1)
            at = np.flatnonzero(size == dims)
            start = col.offsets.to_numpy()[:-1][at]
            flat = col.values.to_numpy(zero_copy_only=False).astype(np.float32)
            x = flat[start[:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims), np.float32)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, at = x[ok] + np.float32(0), at[ok]  # no negative zeros
            if slots:
                y = np.zeros((len(x), width), np.float32)
                np.add.at(y.T, slots[0], (x * slots[1]).T)
                x = y
            raw = [r.tobytes() for r in x]
            yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["key", "h", "v"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v")).filter("key is not null and v is not null")
    return rows.mapInArrow(encode, "key bigint, h binary, v binary").groupBy("key").agg(F.min(F.struct("h", "v")).alias("m")).select("key", "m.h", "m.v")


def vector_table(df: DataFrame, key: str, vector: str, dims: int, buckets: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(vectors, copies). vectors (key bigint, v binary): usable vectors, equal ones once under their smallest key. copies (key, rep): the
    members of groups of equal vectors, or None."""
    one = keep(usable_vectors(df, key, vector, dims, buckets), "vectors")
    twice = keep(one.groupBy("h").agg(F.min("key").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("h", "rep"), "equal-vectors")
    if not twice.limit(1).count():
        return one.select("key", "v"), None
    copies = one.select("key", "h").join(twice, "h").select("key", "rep")
    lone = one.join(twice, "h", "left").filter("rep is null or rep = key").select("key", "v")
    return keep(lone, "vectors"), copies


def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(raw float32 rows, unit float32 rows) of a binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(n, -1)
    wide = raw.astype(np.float64)
    return raw, (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of raw rows a[i], b[i] in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _random(key: np.ndarray, seed: int) -> np.ndarray:
    """A uniform number in (0, 1) from each key and the seed."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def best_centre(u: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, cosine) of unit rows."""
    if not len(centres):
        return np.full(len(u), -1), np.full(len(u), -1.0, np.float32)
    home, cos = np.empty(len(u), np.int64), np.empty(len(u), np.float32)
    for i in range(0, len(u), 2048):
        s = u[i : i + 2048] @ centres.T
        home[i : i + 2048] = s.argmax(axis=1)
        cos[i : i + 2048] = s[np.arange(len(s)), home[i : i + 2048]]
    return home, cos


def draw_far(table: DataFrame, centres: np.ndarray, many: int, seed: int, beyond: float | None) -> np.ndarray:
    """`many` vectors drawn with chances in proportion to the squared distance from the nearest centre (at most `beyond` alike, if
    given). Each task keeps the first of an exponential race, as many as are wanted in all; so do their union."""
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pool = shared.value, []
        for b in batches:
            key, (_, u) = b.column(0).to_numpy(), matrix(b.column(1))
            cos = best_centre(u, c)[1]
            d2 = np.maximum(2 - 2 * cos.astype(np.float64), 1e-9) if len(c) else np.ones(len(u))
            race = -np.log(_random(key, seed)) / d2
            ok = np.flatnonzero(cos < beyond) if beyond is not None else np.arange(len(u))
            pool += [(race[i], u[i].tobytes()) for i in ok[np.argsort(race[ok])[:many]]]
            if len(pool) > 4 * many:
                pool = sorted(pool)[:many]
        pool = sorted(pool)[:many]
        yield pa.record_batch([pa.array([p for p, _ in pool], pa.float64()), pa.array([v for _, v in pool], pa.binary())], names=["race", "v"])

    got = table.select("key", "v").mapInArrow(run, "race double, v binary").orderBy("race", "v").limit(many).toArrow()
    return matrix(got["v"])[1] if got.num_rows else np.zeros((0, centres.shape[1]), np.float32)


def means(table: DataFrame, centres: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit mean, number) of the vectors nearest to each centre within `near`, and how many vectors are near none."""
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, n, far = np.zeros(c.shape, np.float64), np.zeros(len(c), np.int64), 0
        for b in batches:
            u = matrix(b.column(0))[1]
            home, cos = best_centre(u, c)
            ok = cos >= near
            far += int((~ok).sum())
            h = home[ok]
            order = np.argsort(h, kind="stable")
            hs = h[order]
            if len(hs):
                cut = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                sums[hs[cut]] += np.add.reduceat(u[ok][order].astype(np.float64), cut)
                n += np.bincount(h, minlength=len(c))
        at = np.flatnonzero(n)
        ids = np.concatenate([at, [-1]])
        yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([n[at], [far]])), pa.array([*(sums[i].tobytes() for i in at), np.zeros(c.shape[1]).tobytes()], pa.binary())], names=["c", "n", "s"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for c, n, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                m, t = total.get(c, (0, 0.0))
                total[c] = (m + n, t + np.frombuffer(s, np.float64))
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].tobytes() for x in total.values()], pa.binary())], names=["c", "n", "s"])

    schema = "c bigint, n bigint, s binary"
    got = table.select("v").mapInArrow(local, schema).repartition(4, "c").mapInArrow(combine, schema).toArrow()
    c, n = got["c"].to_numpy(), got["n"].to_numpy()
    out, count = centres.astype(np.float64).copy(), np.zeros(len(centres), np.int64)
    for i, m, s in zip(c, n, got["s"].to_pylist(), strict=True):
        if i >= 0:
            v = np.frombuffer(s, np.float64)
            out[i], count[i] = v / max(np.linalg.norm(v), 1e-12), m
    return out.astype(np.float32), count, int(n[c == -1].sum())


def absorb(centres: np.ndarray, weight: np.ndarray, join: float, most: int) -> np.ndarray:
    """The centres of most weight, each taking in those at least `join` alike to it (weighted mean). Weightless ones go."""
    out: list[np.ndarray] = []
    for i in np.argsort(-weight, kind="stable"):
        if weight[i] == 0 or len(out) >= most:
            break
        out.append(i)
    order = np.array(out, np.int64)
    c, w = centres[order].astype(np.float64), weight[order].astype(np.float64)
    free, merged = np.ones(len(c), bool), []
    for i in range(len(c)):
        if free[i]:
            own = np.flatnonzero(free & (c @ c[i] >= join))
            own = own if i in own else np.append(own, i)
            free[own] = False
            m = (c[own] * w[own, None]).sum(axis=0)
            merged.append(m / max(np.linalg.norm(m), 1e-12))
    return np.array(merged, np.float32).reshape(-1, centres.shape[1])


def settle(table: DataFrame, seeds: np.ndarray, near: float, join: float, most: int, rounds: int = 3) -> tuple[np.ndarray, int]:
    """(centres, vectors near none): rounds of trimmed means, close centres joining before each."""
    c, far = seeds, 0
    for _ in range(rounds):
        c, n, far = means(table, c, near)
        c = absorb(c, n, join, most)
        if not len(c):
            break
    return c, far


class Bounds:
    """Of each cell: members, the radius (largest angle), and the least angle at which a vector of elsewhere comes into question."""

    def __init__(self, size: np.ndarray, radius: np.ndarray, intruder: np.ndarray):
        self.size, self.radius, self.intruder = size, radius, intruder


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.asarray(cos, np.float64), -1, 1))


def _per_cell(table: DataFrame, k: int, run: Callable, how) -> np.ndarray:
    got = table.select("key", "v").mapInArrow(run, "c bigint, n bigint, x double").groupBy("c").agg(F.sum("n").alias("n"), how("x").alias("x")).toArrow()
    return got["c"].to_numpy(), got["n"].to_numpy(), got["x"].to_numpy()


def bounds(table: DataFrame, centres: np.ndarray, near: float, alike: float) -> Bounds:
    """Two scans; what comes back is one row a cell."""
    k, theta = len(centres), math.acos(alike)
    sc = table.sparkSession.sparkContext
    shared = sc.broadcast(centres)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low = np.zeros(k, np.int64), np.ones(k)
        for b in batches:
            home, cos = best_centre(matrix(b.column(1))[1], shared.value)
            ok = cos >= near
            n += np.bincount(home[ok], minlength=k)
            np.minimum.at(low, home[ok], cos[ok])
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at]), pa.array(low[at])], names=["c", "n", "x"])

    c, n, x = _per_cell(table, k, radii, F.min)
    size, radius = np.zeros(k, np.int64), np.zeros(k)
    size[c], radius[c] = n, _angle(x - EPS)
    reach = sc.broadcast(np.where(size > 0, np.cos(np.minimum(theta + radius, math.pi)) - EPS, 2.0).astype(np.float32))

    def intruders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n = np.full(k, -2.0), np.zeros(k, np.int64)
        for b in batches:
            u = matrix(b.column(1))[1]
            for r, cells, cos in foreign(u, shared.value, reach.value, near):
                np.maximum.at(top, cells, cos)
                n += np.bincount(cells, minlength=k)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at]), pa.array(top[at])], names=["c", "n", "x"])

    c, _, x = _per_cell(table, k, intruders, F.max)
    intruder = np.full(k, math.inf)
    intruder[c] = _angle(np.minimum(x + EPS, 1))
    return Bounds(size, radius, intruder)


def foreign(u: np.ndarray, centres: np.ndarray, reach: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, cosines): for each vector the cells, other than its own, that may hold one alike to it."""
    for i in range(0, len(u), 2048):
        s = u[i : i + 2048] @ centres.T if len(centres) else np.zeros((len(u[i : i + 2048]), 0), np.float32)
        if not s.shape[1]:
            return
        hit = s >= reach
        home = s.argmax(axis=1)
        own = s[np.arange(len(s)), home] >= near
        hit[np.flatnonzero(own), home[own]] = False
        r, c = np.nonzero(hit)
        yield r + i, c, s[r, c]
