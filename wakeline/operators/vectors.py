"""Vectors: normalising, exact search, bucketed clustering, assignment checks, term weights, cluster quality."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.storage import keep

#: the side of a search or an assignment that is broadcast may have so many values (64 MB as single precision)
BROADCAST_VALUES = 16_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(eps)))


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _small(df: DataFrame, id_: str, vector: str, *more: str) -> pa.Table:
    """A table that is broadcast, after its size has been checked."""
    size = df.agg(F.sum(F.size(vector)).alias("n")).first()["n"] or 0
    if size > BROADCAST_VALUES:
        raise ValueError(f"{size} values: over what is broadcast; search in blocks of queries")
    return df.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), *more).orderBy("id").toArrow()


def exact_top_k(queries: DataFrame, base: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", keep_self: bool = False) -> DataFrame:
    """(query, id, rank, cosine): the k base vectors of highest cosine of each query; ties by the smaller id, at 9 decimals.

    A stated set of queries, checked for size, against all rows: each batch of the base is multiplied with the queries once and
    leaves k rows a query; k rows a query and task are merged.
    """
    q = _small(queries, id_, vector)
    sc = base.sparkSession.sparkContext
    shared = sc.broadcast((q["id"].to_numpy(), _units(_matrix(q["v"].combine_chunks()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv = shared.value
        kept: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for b in batches:
            bid, m = b.column(0).to_numpy(), _units(_matrix(b.column(1)))
            for i in range(0, len(qid), 1024):
                s = np.round(qv[i : i + 1024] @ m.T, 9) if len(m) else np.zeros((len(qid[i : i + 1024]), 0))
                if not keep_self:
                    s[qid[i : i + 1024, None] == bid[None, :]] = -9
                take = min(k, s.shape[1])
                if not take:
                    continue
                least = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
                r, c = np.nonzero(s >= least[:, None])
                kept.append((qid[i + r], bid[c], s[r, c]))
            if len(kept) > 16:
                kept = [_best(kept, k)]
        a, i, s = _best(kept, k)
        ok = s > -9
        yield pa.record_batch([pa.array(a[ok]), pa.array(i[ok]), pa.array(s[ok])], names=["query", "id", "cosine"])

    rows = base.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna().mapInArrow(run, "query bigint, id bigint, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "id", "rank", "cosine")


def _best(parts: list[tuple], k: int) -> tuple:
    q, i, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    ok = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[ok], i[ok], s[ok]


def centroids(df: DataFrame, bucket: str, vector: str) -> DataFrame:
    """(bucket, n, centroid): the unit mean of each bucket's vectors, summed dimension by dimension with partial sums."""
    dims = df.select(bucket, F.posexplode(vector).alias("d", "x")).groupBy(bucket, "d").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    c = dims.groupBy(bucket).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    return c.select(bucket, "n", l2_normalize(F.col("c")).alias("centroid"))


def allocate(sizes: DataFrame, clusters: int, bucket: str = "bucket", size: str = "n") -> DataFrame:
    """(bucket, n, clusters): one cluster a bucket, the others one by one to the bucket of most members a cluster (then the larger,
    then the later name), none beyond its members. That greedy is the first `clusters - buckets` of all (bucket, j) by size / j."""
    b = sizes.count()
    if b > clusters:
        raise ValueError(f"{b} buckets need at least as many clusters, not {clusters}")
    more = sizes.withColumn("j", F.explode(F.sequence(F.lit(1), F.least(F.col(size), F.lit(clusters)).cast("int")))).filter(F.col("j") < F.col(size))
    extra = more.orderBy(F.desc(F.col(size) / F.col("j")), F.desc(size), F.desc(bucket)).limit(clusters - b).groupBy(bucket).agg(F.count("*").alias("extra"))
    return sizes.join(extra, bucket, "left").select(bucket, size, (1 + F.coalesce("extra", F.lit(0))).alias("clusters"))


def bucketed_kmeans(df: DataFrame, clusters: int, id_: str, bucket: str, vector: str, rounds: int = 300, restarts: int = 20, seed: int = 42, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(labels, states): spherical k-means within each bucket, all buckets and all restarts in the same passes. labels (id, bucket, cluster_id);
    states (cluster_id, bucket, centroid). Cluster ids are dense over the buckets in order of their names. More clusters than vectors, or
    fewer than buckets, raise.

    A bucket's seeds are drawn as k-means++ does, over up to 64 candidates a cluster of each bucket (those of the smallest hashes; a top-k by partial
    aggregation, so no bucket is gathered). Each round is one scan with partial sums for all restarts that still move: their centres
    (restarts * clusters * dims values, checked) are broadcast, and a row a centre comes back. A restart stops when its cost falls by less than
    `tolerance` of itself, or after `rounds`; the one of least cost stays.
    """
    spark = df.sparkSession
    rows = keep(df.select(F.col(id_).alias("id"), F.col(bucket).alias("b"), F.col(vector).cast("array<double>").alias("v")).dropna(), "bucketed")
    n = rows.count()
    if clusters > n:
        raise ValueError(f"{clusters} clusters of {n} vectors")
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"))
    plan = sorted(((r["b"], r["clusters"]) for r in allocate(sizes, clusters, "b", "n").collect()), key=lambda x: x[0])
    first = {b: sum(k for _, k in plan[:i]) for i, (b, _) in enumerate(plan)}
    count = {b: k for b, k in plan}
    kind = dict(rows.dtypes)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for x in batches:
            us, names, vs = x.column(2).to_pylist(), x.column(0).to_pylist(), x.column(1)
            for i, (b, u) in enumerate(zip(names, us, strict=True)):
                heap, most = best.setdefault(b, []), 64 * count[b]
                if len(heap) < most:
                    heapq.heappush(heap, (-u, i, vs[i].as_py()))
                elif -heap[0][0] > u:
                    heapq.heapreplace(heap, (-u, i, vs[i].as_py()))
        out = [(b, -u, v) for b, heap in best.items() for u, _, v in heap]
        cols = zip(*out, strict=True) if out else [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (x.schema.field(0).type, pa.int64(), pa.list_(pa.float64())), strict=True)], names=["b", "u", "v"])

    got = rows.select("b", "v", F.xxhash64(F.lit(seed), "id").alias("u")).mapInArrow(draw, f"b {kind['b']}, u bigint, v array<double>").collect()
    pools: dict = {}
    for r in sorted(got, key=lambda r: r["u"]):
        if len(pools.setdefault(r["b"], [])) < 64 * count[r["b"]]:
            pools[r["b"]].append(r["v"])
    dims = len(got[0]["v"])
    if restarts * clusters * dims > BROADCAST_VALUES:
        raise ValueError("restarts * clusters * dims: over what is broadcast")
    centres = np.zeros((restarts, clusters, dims))
    for b, k in plan:
        m = _units(np.array(pools[b]))
        for r in range(restarts):
            rng = np.random.default_rng([seed, r, first[b]])
            at = [int(rng.integers(len(m)))]
            far = 1 - m @ m[at[0]]
            while len(at) < k:
                p = np.maximum(far, 1e-12)
                at.append(int(rng.choice(len(m), p=p / p.sum())))
                far = np.minimum(far, 1 - m @ m[at[-1]])
            centres[r, first[b] : first[b] + k] = m[at]

    def scan(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(new centres, costs) of the restarts in c, in one pass."""
        shared = spark.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            sums, cost, seen = np.zeros_like(c), np.zeros(c.shape[:2]), np.zeros(c.shape[:2], np.int64)
            for x in batches:
                m, names = _units(_matrix(x.column(1))), np.array(x.column(0).to_pylist(), dtype=object)
                for b in set(names):
                    at, own = np.flatnonzero(names == b), slice(first[b], first[b] + count[b])
                    for r in range(len(c)):
                        s = m[at] @ c[r, own].T
                        a = s.argmax(axis=1)
                        np.add.at(sums[r, own], a, m[at])
                        seen[r, own] += np.bincount(a, minlength=count[b])
                        cost[r, own] += np.bincount(a, 1 - s[np.arange(len(at)), a], minlength=count[b])
            r, k = np.nonzero(seen)
            yield pa.record_batch([pa.array(r), pa.array(k), pa.array(cost[r, k]), pa.array([x.tobytes() for x in sums[r, k]], pa.binary())], names=["r", "k", "cost", "s"])

        def add(t: pa.Table) -> pa.Table:
            s = np.sum([np.frombuffer(x) for x in t["s"].to_pylist()], axis=0)
            return pa.table({"r": t["r"].slice(0, 1), "k": t["k"].slice(0, 1), "cost": pa.array([float(np.sum(t["cost"].to_numpy()))]), "s": pa.array([s.tobytes()], pa.binary())})

        schema = "r bigint, k bigint, cost double, s binary"
        t = rows.select("b", "v").mapInArrow(run, schema).groupBy("r", "k").applyInArrow(add, schema).toArrow()
        out, cost = c.copy(), np.zeros(len(c))
        if t.num_rows:
            out[t["r"].to_numpy(), t["k"].to_numpy()] = np.array([np.frombuffer(x) for x in t["s"].to_pylist()])
            np.add.at(cost, t["r"].to_numpy(), t["cost"].to_numpy())
        norm = np.linalg.norm(out, axis=2, keepdims=True)
        return np.where(norm > 1e-12, out / np.maximum(norm, 1e-12), c), cost

    costs, moving = np.full(restarts, math.inf), np.arange(restarts)
    for _ in range(rounds):
        new, now = scan(centres[moving])
        centres[moving] = new
        still = costs[moving] - now > tolerance * np.maximum(now, 1e-12)
        costs[moving] = np.minimum(costs[moving], now)
        moving = moving[still | ~np.isfinite(now)]
        if not len(moving):
            break
    best = centres[int(costs.argmin())]
    shared = spark.sparkContext.broadcast(best)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            m, names = _units(_matrix(x.column(2))), np.array(x.column(1).to_pylist(), dtype=object)
            ids = np.zeros(len(names), np.int32)
            for b in set(names):
                at = np.flatnonzero(names == b)
                ids[at] = first[b] + (m[at] @ shared.value[first[b] : first[b] + count[b]].T).argmax(axis=1)
            yield pa.record_batch([x.column(0), x.column(1), pa.array(ids)], names=["id", "b", "cluster_id"])

    labels = rows.mapInArrow(label, f"id {kind['id']}, b {kind['b']}, cluster_id int").withColumnsRenamed({"id": id_, "b": bucket})
    owner = [(first[b] + j, b, best[first[b] + j].tolist()) for b, k in plan for j in range(k)]
    return labels, spark.createDataFrame(owner, f"cluster_id int, {bucket} {kind['b']}, centroid array<double>")


def run_kmeans(df: DataFrame, clusters: int, id_: str, vector: str, bucket: str | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """k-means over all vectors as one bucket (mode `global`, no bucket) or within each bucket. More clusters than vectors raise."""
    if bucket is not None:
        return bucketed_kmeans(df, clusters, id_, bucket, vector, **settings)
    labels, states = bucketed_kmeans(df.withColumn("_all", F.lit("all")), clusters, id_, "_all", vector, **settings)
    return labels.drop("_all"), states.drop("_all")


def state_name(cluster: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(cluster.cast("string"), 3, "0"))


def assignment_diagnostics(memories: DataFrame, states: DataFrame, id_: str, bucket: str, vector: str, cluster: str = "cluster_id", min_similarity: float = 0.55, min_margin: float = 0.02, keep_ambiguous: bool = False) -> DataFrame:
    """(id, cluster, similarity, best_other, margin, global_top1, global_top2, accepted, reason): how well each memory sits in its cluster.

    best_other is the best of the other clusters of its bucket; without one, margin is null and no obstacle. low_similarity comes before
    low_margin. One scan against the broadcast centres (checked for size).
    """
    c = _small(states, "cluster_id", "centroid", bucket)
    shared = memories.sparkSession.sparkContext.broadcast((c["id"].to_numpy(), np.array(c[bucket].to_pylist(), dtype=object), _units(_matrix(c["v"].combine_chunks()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owner, m = shared.value
        place = {int(x): i for i, x in enumerate(ids)}
        for x in batches:
            s = _units(_matrix(x.column(3))) @ m.T
            own = np.array([place[int(k)] for k in x.column(2).to_pylist()], np.int64)
            at = np.arange(len(s))
            sim = s[at, own]
            mine = owner[None, :] == np.array(x.column(1).to_pylist(), dtype=object)[:, None]
            mine[at, own] = False
            other = np.where(mine, s, -np.inf).max(axis=1) if len(s) else np.zeros(0)
            top = -np.sort(-s, axis=1)[:, :2]
            none = ~np.isfinite(other)
            yield pa.record_batch(
                [x.column(0), x.column(2), pa.array(sim), pa.array(other, mask=none), pa.array(sim - other, mask=none), pa.array(top[:, 0] if len(s) else sim), pa.array(top[:, 1] if top.shape[1] > 1 else sim, mask=np.full(len(s), top.shape[1] < 2))],
                names=["id", "cluster_id", "similarity", "best_other", "margin", "global_top1", "global_top2"],
            )

    kind = dict(memories.dtypes)[id_]
    rows = memories.select(F.col(id_).alias("id"), F.col(bucket).alias("b"), F.col(cluster).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v")).dropna()
    d = rows.mapInArrow(run, f"id {kind}, cluster_id bigint, similarity double, best_other double, margin double, global_top1 double, global_top2 double")
    low_sim, low_margin = F.col("similarity") < min_similarity, F.coalesce(F.col("margin") < min_margin, F.lit(False))
    ok = F.lit(True) if keep_ambiguous else ~low_sim & ~low_margin
    return d.withColumn("accepted", ok).withColumn("reason", F.when(low_sim, "low_similarity").when(low_margin, "low_margin")).withColumnRenamed("id", id_)


def map_to_states(behaviors: DataFrame, states: DataFrame, id_: str, bucket: str, vector: str, min_similarity: float = 0.55, min_margin: float = 0.02, filtered: bool = True) -> DataFrame:
    """(id, cluster_id, similarity, margin, fallback, accepted, reason): the nearest state of the behaviour's own bucket, or of all where
    the bucket has none (never accepted then). margin: best less second best, null where there is one only. Reasons are joined by +."""
    c = _small(states, "cluster_id", "centroid", bucket)
    shared = behaviors.sparkSession.sparkContext.broadcast((c["id"].to_numpy(), np.array(c[bucket].to_pylist(), dtype=object), _units(_matrix(c["v"].combine_chunks()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owner, m = shared.value
        for x in batches:
            s = np.round(_units(_matrix(x.column(2))) @ m.T, 12)
            mine = owner[None, :] == np.array(x.column(1).to_pylist(), dtype=object)[:, None]
            missing = ~mine.any(axis=1)
            s = np.where(mine | missing[:, None], s, -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")  # ids ascend: ties go to the smaller
            at = np.arange(len(s))
            top = s[at, order[:, 0]]
            second = s[at, order[:, 1]] if s.shape[1] > 1 else np.full(len(s), -np.inf)
            none = ~np.isfinite(second)
            yield pa.record_batch([x.column(0), pa.array(ids[order[:, 0]].astype(np.int64)), pa.array(top), pa.array(top - second, mask=none), pa.array(missing)], names=["id", "cluster_id", "similarity", "margin", "fallback"])

    kind = dict(behaviors.dtypes)[id_]
    rows = behaviors.select(F.col(id_).alias("id"), F.col(bucket).alias("b"), F.col(vector).cast("array<double>").alias("v")).dropna()
    d = rows.mapInArrow(run, f"id {kind}, cluster_id bigint, similarity double, margin double, fallback boolean")
    low_margin = F.coalesce(F.col("margin") < min_margin, F.lit(False))
    reason = F.concat_ws("+", F.when(F.col("fallback"), "missing_compatible_mechanism_bucket"), F.when(F.col("similarity") < min_similarity, "low_similarity"), F.when(low_margin, "low_margin"))
    return d.withColumn("reason", reason).withColumn("accepted", F.lit(True) if not filtered else F.col("reason") == "").withColumnRenamed("id", id_)


def cluster_quality(df: DataFrame, vector: str = "embedding", cluster: str = "label") -> DataFrame:
    """One row: clusters, inertia, Calinski-Harabasz and Davies-Bouldin, from sums a dimension and two scans of distances."""
    rows = df.select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).dropna()
    dims = rows.select("c", F.posexplode("v").alias("d", "x"))
    per = dims.groupBy("c", "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    mean = per.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    all_ = per.groupBy("d").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"))
    between = per.join(all_, "d").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"))
    dist2 = F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    spread = rows.join(F.broadcast(mean), "c").withColumn("d2", dist2).groupBy("c").agg(F.sum("d2").alias("ss"), F.avg(F.sqrt("d2")).alias("s"), F.count("*").alias("n"))
    s = spread.join(mean.select("c", "m"), "c")
    # clusters against clusters: as many rows as the square of their number, bounded by the configured count
    pair = s.select(F.col("c").alias("a"), F.col("s").alias("sa"), F.col("m").alias("ma")).join(F.broadcast(s.select(F.col("c").alias("b"), F.col("s").alias("sb"), F.col("m").alias("mb"))), F.expr("a <> b"))
    gap = F.sqrt(F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    db = pair.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / gap).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    total = spread.agg(F.count("*").alias("clusters"), F.sum("ss").alias("inertia"), F.sum("n").alias("n"))
    one = total.crossJoin(between).crossJoin(db)  # one row each
    ch = (F.col("between") / (F.col("clusters") - 1)) / (F.col("inertia") / (F.col("n") - F.col("clusters")))
    return one.select("clusters", "inertia", ch.alias("calinski_harabasz"), "davies_bouldin")


def tfidf(df: DataFrame, id_: str, text: str, stop_words: list[str], max_features: int = 8000) -> DataFrame:
    """(id, term, tf, df, weight): words and pairs of adjacent words, lower-cased, stop words out first; the max_features terms of most
    occurrences (ties by term); weight tf * (ln((1 + n) / (1 + df)) + 1), unit length a document. Words have two or more characters."""
    ws = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda w: ~w.isin(stop_words))
    d = df.select(id_, ws.alias("w")).withColumn("two", F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    tf = keep(d.select(id_, F.explode(F.concat("w", "two")).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("tf")), "term-counts")
    vocabulary = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    n = df.agg(F.count("*").alias("docs"))
    w = keep(tf.join(F.broadcast(vocabulary), "term"), "weighed-terms").crossJoin(n).withColumn("raw", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))  # max_features rows; one row
    norm = w.groupBy(id_).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return w.join(norm, id_).select(id_, "term", "tf", "df", (F.col("raw") / F.col("norm")).alias("weight"))


def silhouette(df: DataFrame, vector: str = "embedding", cluster: str = "label") -> float:
    """Mean silhouette by cosine, from per-cluster sums (no pairs are made)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(cluster).cast("double").alias("prediction")).dropna()
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="cosine").evaluate(rows)
