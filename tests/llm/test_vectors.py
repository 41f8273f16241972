"""Clusters and neighbours against all pairs: unusable vectors, scaled and equal ones, ties, repeated rows, unclean clusters."""

import numpy as np
import pytest

from wakeline.llm import clusters, neighbours, vectors

DIMS = 16


def _data(seed, n=12, spread=0.18, sizes=(2, 60)):
    r = np.random.default_rng(seed)
    out = []
    for c in r.normal(size=(n, DIMS)):
        c /= np.linalg.norm(c)
        for _ in range(r.integers(*sizes)):
            v = c + r.normal(size=DIMS) * spread / np.sqrt(DIMS)
            out.append(v * r.uniform(0.2, 3))
    out += list(r.normal(size=(15, DIMS)))
    x = np.array(out, np.float32)
    return x[r.permutation(len(x))]


def _frame(spark, x, copies=()):
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    rows += [(len(x) + j, x[i].tolist(), "") for j, i in enumerate(copies)]
    rows += [rows[0], (9001, None, ""), (9002, [0.0] * DIMS, ""), (9003, [1.0] * (DIMS - 1), ""), (9004, [float("nan")] * DIMS, ""), (None, [1.0] * DIMS, ""), (9005, [float("inf")] + [1.0] * (DIMS - 1), "")]
    return spark.createDataFrame(rows, "id bigint, v array<float>, key string")


def _cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


def _greedy(x, alike):
    """Sets that are all alike, the largest first: by degree, each joined by the candidate alike to most candidates left."""
    s = _cosines(x) >= alike
    np.fill_diagonal(s, False)
    left, out = set(range(len(x))), []
    while left:
        start = min(left, key=lambda i: (-sum(s[i, j] for j in left), i))
        own, cand = [start], {j for j in left if s[start, j]}
        while cand:
            best = min(cand, key=lambda i: (-sum(s[i, j] for j in cand), i))
            own.append(best)
            cand = {j for j in cand if s[best, j]}
        left -= set(own)
        out.append(own)
    return {i: min(c) for c in out if len(c) > 1 for i in c}


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.18), (2, 0.25), (3, 0.6)])
def test_clusters_against_all_pairs(spark, seed, spread):
    x = _data(seed, spread=spread)
    for block in (8192, 10):
        got = {r["id"]: r["cluster_key"] for r in clusters.clusters(_frame(spark, x), "id", "v", DIMS, rim_block=block).collect()}
        assert got == _greedy(x, 0.85)


def test_cluster_copies_and_empty(spark):
    x = _data(4)
    got = {r["id"]: r["cluster_key"] for r in clusters.clusters(_frame(spark, x, [3, 3, 5]), "id", "v", DIMS).collect()}
    assert got == _greedy(np.concatenate([x, x[[3, 3, 5]]]), 0.85)
    e = spark.createDataFrame([], "id bigint, v array<float>")
    assert clusters.clusters(e, "id", "v", DIMS).count() == 0


def test_parted_groups_stay_alike(spark):
    x = _data(3, n=4, spread=0.6, sizes=(60, 90))
    got = clusters.clusters(_frame(spark, x), "id", "v", DIMS, divide_rows=20).collect()
    s, of = _cosines(x), {}
    for r in got:
        of.setdefault(r["cluster_key"], []).append(r["id"])
    assert len({r["id"] for r in got}) == len(got)
    assert all(min(c) == k and (s[np.ix_(c, c)] >= 0.85).all() for k, c in of.items())


@pytest.mark.parametrize("times", [1, 2])
def test_vectors_near_no_centre_are_linear_work(spark, times):
    r = np.random.default_rng(times)
    x = r.normal(size=(1500 * times, DIMS)).astype(np.float32)
    pairs = np.concatenate([x, x[:100] + 0.05 * r.normal(size=(100, DIMS)).astype(np.float32)])
    got = {q["id"]: q["cluster_key"] for q in clusters.clusters(_frame(spark, pairs), "id", "v", DIMS, window=256).collect()}
    assert np.mean([got.get(len(x) + i) == i for i in range(100)]) >= 0.9


def test_typical_members_are_nearest_their_own_centroid(spark):
    x = _data(3, spread=0.6)
    d = _frame(spark, x)
    members = clusters.clusters(d, "id", "v", DIMS)
    got = {r["id"]: (r["cluster_key"], r["centroid_cosine"]) for r in clusters.member_cosines(members, d, "id", "v", DIMS).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    own = {}
    for i, (c, _) in got.items():
        own.setdefault(c, []).append(i)
    assert len(own) > 10
    for c, ids in own.items():
        m = u[ids].sum(axis=0)
        for i in ids:
            assert got[i][0] == c and abs(got[i][1] - u[i] @ m / np.linalg.norm(m)) < 1e-6


def test_text_clusters_part_topics(spark):
    r = np.random.default_rng(1)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    rows = [(i, " ".join(r.choice(topics[i % 3], 8)) + " the and") for i in range(90)] + [(5, "the"), (200, None), (201, "!"), (None, "a1")]
    d = spark.createDataFrame(rows, "id bigint, t string")
    got = {x["id"]: x for x in clusters.text_clusters(d, "id", "t", 3).collect()}
    assert set(got) == set(range(90))
    of = [{got[i]["cluster_key"] for i in range(t, 90, 3) if i != 5} for t in range(3)]
    assert all(len(s) == 1 for s in of) and len(set.union(*of)) == 3
    assert clusters.text_clusters(d.limit(0), "id", "t").count() == 0


def test_describe(spark):
    m = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.1)], "cluster_key bigint, id bigint, centroid_cosine double")
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "d")], "id bigint, text string")
    r = clusters.describe(m, t, "id", "text", 3).first()
    assert (r["size"], r["typical"]) == (4, ["b", None, "a"])


def test_hashed_features():
    bucket, sign = vectors.hashed_slots(16, 16)
    assert len(set(bucket)) == 16 and set(sign) <= {1.0, -1.0}


def test_hashed_texts(spark):
    d = spark.createDataFrame([(1, "red harbor"), (2, "harbor RED"), (3, None), (4, "!")], "id bigint, t string")
    got = {r["id"]: r["vector"] for r in vectors.hashed_texts(d, "id", "t").collect()}
    assert got[1] == got[2] and got[3] is None and got[4] is None and abs(sum(v * v for v in got[1]) - 1) < 1e-5


def _neighbours(x, k, alike):
    s = np.round(_cosines(x), 9)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(x)):
        at = np.flatnonzero(s[i] >= alike)
        out |= {(i, int(j)) for j in at[np.lexsort((at, -s[i, at]))][:k]}
    return out


@pytest.mark.parametrize(("seed", "spread", "window"), [(1, 0.2, 8192), (2, 0.2, 40), (3, 0.6, 40)])
def test_neighbours_against_all_pairs(spark, seed, spread, window):
    x = _data(seed, spread=spread)
    got = {(r["id"], r["neighbor"]) for r in neighbours.nearest_vectors(_frame(spark, x), "id", "v", dims=DIMS, window=window).collect()}
    assert got == _neighbours(x, 5, 0.85)


def test_neighbours_of_equal_vectors(spark):
    x = _data(5)
    copies = [7] * 9 + [11]
    got = {(r["id"], r["neighbor"]) for r in neighbours.nearest_vectors(_frame(spark, x, copies), "id", "v", dims=DIMS).collect()}
    assert got == _neighbours(np.concatenate([x, x[copies]]), 5, 0.85)
    assert neighbours.nearest_vectors(spark.createDataFrame([], "id bigint, v array<float>"), "id", "v", dims=DIMS).count() == 0


def test_windows_alone_find_most(spark):
    x = _data(6, n=6, sizes=(80, 120))
    want = _neighbours(x, 5, 0.85)
    got = {(r["id"], r["neighbor"]) for r in neighbours.nearest_vectors(_frame(spark, x), "id", "v", dims=DIMS, window=100, curves=4, exact=False).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_hilbert_visits_every_cell_by_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = neighbours.hilbert(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_no_size_changes_the_clusters(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, DIMS)).astype(np.float32)
    x = np.concatenate([x, x[:100] + 0.05 * r.normal(size=(100, DIMS)).astype(np.float32)])  # nearly all near no centre, many windows of them
    got = {q["id"]: q["cluster_key"] for q in clusters.clusters(_frame(spark, x), "id", "v", DIMS, window=64).collect()}
    some = np.flatnonzero((_cosines(x) >= 0.85).sum(axis=1) > 1)
    assert got == {some[i]: some[k] for i, k in _greedy(x[some], 0.85).items()} and len(got) >= 200
    x = _data(3, n=4, spread=0.6, sizes=(60, 90))  # linked groups that aren't all alike
    got = {q["id"]: q["cluster_key"] for q in clusters.clusters(_frame(spark, x), "id", "v", DIMS, divide_rows=20).collect()}
    assert got == _greedy(x, 0.85)
