"""Queries do the whole job: what a cut would drop is there."""

import hashlib
import math
import random
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pytest

from wakeline.operators import segments
from wakeline.plans import catalog


@pytest.fixture(scope="module")
def hot_user(spark, tmp_path_factory):
    """Ratings with a user who touched 1,100 of 1,160 items: (folder, items of each user)."""
    r = random.Random(3)
    touched = {1: set(r.sample(range(1160), 1100))} | {u: set(r.sample(range(1160), 60)) for u in range(2, 22)}
    data = [(u, i, 4.0, k) for u, items in touched.items() for k, i in enumerate(sorted(items))]
    sf = str(tmp_path_factory.mktemp("hot"))
    spark.createDataFrame(data, "user_id bigint, item_id bigint, rating double, ts bigint").write.parquet(f"{sf}/ratings.parquet")
    return sf, touched


def test_hot_user_gets_negatives(spark, hot_user):
    sf, touched = hot_user
    users = Counter(i for items in touched.values() for i in items)
    ids = sorted(users)
    upper = list(accumulate(users[i] for i in ids))
    want = set()
    for u, own in touched.items():
        for split in ("val", "test"):
            got, draw = [], 0
            while len(got) < 19:
                draw += 1
                h = int(hashlib.md5(f"42:{split}:{u}:{draw}".encode()).hexdigest()[:12], 16) % upper[-1]
                i = ids[bisect_right(upper, h)]
                if i not in own and i not in got:
                    got.append(i)
            want |= {(u, split, k, i) for k, i in enumerate(got, 1)}
    assert {(x["user_id"], x["split"], x["slot"], x["item_id"]) for x in catalog.queries()["popularity_negatives"](spark, sf).collect()} == want


def test_hot_user_gets_candidates(spark, hot_user):
    sf, touched = hot_user
    got = {x["user_id"]: x for x in catalog.queries()["candidate_lists"](spark, sf).collect()}
    assert got.keys() == touched.keys() and len(got[1]["candidates"].split(",")) == 20
    # of the lists the query breaks, all come out, and none of the others
    assert {x["user_id"] for x in catalog.queries()["candidate_violations"](spark, sf).collect()} == {u for u in touched if u % 5 < 3}


def _walked(spark, sf):
    """Contexts of up to five states and what each user's walk finds, without Spark's plans: (counts, walks)."""
    from wakeline.plans import tables as T

    segs, cnt = {}, Counter()
    for x in T.segs(spark, sf).collect():
        segs.setdefault((x["user_id"], x["seg"]), []).append((x["pos"], x["state_id"]))
    for (u, _), q in segs.items():
        q = [s for _, s in sorted(q)]
        cnt.update((tuple(q[i - k : i]), u, q[i]) for i in range(1, len(q)) for k in range(min(i, 5) + 1))
    own, users, weight = Counter(), {}, {}
    for (c, u, _), n in cnt.items():
        own[c, u] += n
        users.setdefault(c, set()).add(u)
    for (c, u, t), n in cnt.items():
        w = weight.setdefault(c, Counter())
        w[t] += n / own[c, u]
    raw = {c: {t: x / sum(w.values()) for t, x in w.items()} for c, w in weight.items()}
    seen = Counter()
    for (c, _), n in own.items():
        seen[c] += n

    def jsd(p, q):
        half = lambda a, b: sum(0.5 * x * math.log2(2 * x / (x + b.get(t, 0))) for t, x in a.items() if x > 1e-12)
        return half(p, q) + half(q, p)

    on = {c for c in raw if not c or len(users[c]) >= 3 and seen[c] >= 3 and (len(c) == 1 or jsd(raw[c], raw[c[1:]]) >= 0.05)}

    def smooth(c, t):
        if not c:
            return raw[c].get(t, 0.0)
        a = len(users[c]) / (len(users[c]) + 5)
        return a * raw[c].get(t, 0.0) + (1 - a) * smooth(c[1:], t)

    walks = {}
    for x in segments.latest_suffix(T.assignments(spark, sf), 5).collect():
        q = tuple(x["suffix"])
        known = [q[len(q) - k :] for k in range(len(q) + 1) if q[len(q) - k :] in raw]
        context = [c for c in known if c in on][-1]
        t, p = min(((t, smooth(context, t)) for t in raw[()]), key=lambda x: (-round(x[1], 12), x[0]))
        walks[x["user_id"]] = ("|".join(known[-1]), "|".join(context), "history_exhausted" if len(known[-1]) == len(q) else "missing_reverse_edge", t, round(p, 6))
    return cnt, on, walks


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_trees_have_five_orders(spark, sf):
    q = catalog.queries()
    cnt, on, walks = _walked(spark, sf)
    by_order = {x["context_order"]: (x["contexts"], x["active"]) for x in q["contexts_by_order"](spark, sf).collect()}
    every = {c for c, _, _ in cnt}
    assert by_order == {k: (sum(len(c) == k for c in every), sum(len(c) == k for c in on)) for k in range(6)} and by_order[5][0] > 0
    n = Counter()
    for (c, _, t), k in cnt.items():
        n["|".join(c), t] += k
    assert {(x["ctx"], x["target"]): x["n"] for x in q["context_counts"](spark, sf).collect()} == n
    got = {x["user_id"]: (x["matched"], x["context"], x["stop"], x["next_state"], round(x["probability"], 6)) for x in q["tree_query"](spark, sf).collect()}
    assert got.keys() == walks.keys() and {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in walks.items()}
    assert all(abs(got[u][4] - w[4]) < 2e-6 for u, w in walks.items())
