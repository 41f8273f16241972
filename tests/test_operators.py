"""Hand-made fixtures for ties, bounds, nulls and empty tables; invariants."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions import jsons, text
from wakeline.operators import baselines, contexts, items, memories, pool, prep, providers, ranking, reports, segments, states, vectors, windows

RATINGS = "user_id bigint, item_id bigint, rating double, ts bigint, extra string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest_tie_takes_the_higher_rating_and_reads_milliseconds(spark):
    d = spark.createDataFrame([(1, 7, 2.0, 100, ""), (1, 7, 5.0, 100, ""), (1, 8, 3.0, 1_700_000_000_000, ""), (1, 9, None, 5, ""), (None, 1, 1.0, 1, ""), (1, 6, 0.1, 5, "")], RATINGS)
    assert rows(prep.latest_interactions(d)) == [(1, 7, 5.0, 100), (1, 8, 3.0, 1_700_000_000)]


def test_length_bounds_are_inclusive_and_three_items_split(spark):
    d = spark.createDataFrame([(u, i, 4.0, i, "") for u, n in ((1, 2), (2, 3), (3, 5), (4, 6)) for i in range(n)], RATINGS)
    h = prep.within_length(prep.latest_interactions(d), 3, 5)
    assert {r["user_id"] for r in h.collect()} == {2, 3}
    assert [r["split"] for r in prep.leave_two_out(h).filter("user_id = 2").orderBy("pos").collect()] == ["train", "val", "test"]


def test_empty_tables(spark):
    d = spark.createDataFrame([], RATINGS)
    h = prep.within_length(prep.latest_interactions(d))
    assert prep.leave_two_out(h).count() == 0 and prep.popularity(h).count() == 0 and prep.popularity_negatives(h).count() == 0
    e = spark.createDataFrame([], "id bigint, b string, v array<float>")
    assert vectors.exact_top_k(e.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), e.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), 3).count() == 0


def test_negatives_hold_their_invariants(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(u, i, 4.0, k, "") for u in range(20) for k, i in enumerate(r.sample(range(60), 12))] + [(99, i, 4.0, i, "") for i in range(40)], RATINGS)
    h = prep.within_length(prep.latest_interactions(d))
    n = prep.popularity_negatives(h)
    assert n.count() == 21 * 2 * 19
    assert prep.negative_violations(n, h).count() == 0


def test_movies_and_item_defaults(spark):
    m = spark.createDataFrame([(1, "A", "x|y"), (2, None, items.NO_GENRES), (3, " ", None)], "movieId bigint, title string, genres string")
    got = {r["item_id"]: (r["title"], r["genres"]) for r in items.from_movies(m).collect()}
    assert got == {"1": ("A", ["x", "y"]), "2": ("Movie 2", []), "3": ("Movie 3", [])}
    d = spark.createDataFrame([("1", None, None, None, ["a", "b", "c", "d"]), ("2", " T x ", "m", "c", None), ("2", None, None, None, [])], "item_id string, title string, main_cat string, category string, genres array<string>")
    assert rows(items.item_info(d)) == [("1", "Item 1", "a > b > c > d"), ("2", "T x", "m")]
    assert rows(items.item_info(d, "flat"))[0] == ("1", "Unknown Item 1", "a > b > c")


def _sequence(spark, ids, known):
    s = spark.createDataFrame([(1, p, i, "train") for p, i in enumerate(ids)], "user_id bigint, pos int, item_id bigint, split string")
    info = spark.createDataFrame([(str(i), f"n{i}", "c") for i in known], "item_id string, item_name string, item_category string")
    return s, info


@pytest.mark.parametrize(("ids", "known", "want", "test_side"), [([1], [1], ["1"], ["1"]), ([1, 2, 3, 4], [1, 2, 3, 4], ["1,2,3", "2,3,4"], ["1,2,3", "2,3,4"]), ([1, 2, 3, 9], [1, 2, 3], ["1,2,3"], ["1,2,3"]), ([1, 2, 9], [1, 2], [], ["1,2"]), ([1, 2, 3, 4, 5, 6, 7], range(1, 8), ["1,2,3", "4,5,6", "5,6,7"], ["1,2,3", "4,5,6", "5,6,7"])])
def test_chunks(spark, ids, known, want, test_side):
    s, info = _sequence(spark, ids, known)
    for flag, expected in ((False, want), (True, test_side)):
        w = windows.chunk_windows(s, info, emit_at_end_without_metadata=flag).orderBy("window_index")
        assert [",".join(x["item_id"] for x in r["interaction_sequence"]) for r in w.collect()] == expected


def test_labels(spark):
    d = spark.createDataFrame([("Same-Artist",), ("switching",), ("same collection/series",), ("",), (None,), ("shifting ",)], "x string")
    assert [r[0] for r in d.select(text.profile_label(F.col("x"), "scope", "inference")).collect()] == ["same creator", "switching", "same series", "unknown", "unknown", "shifting"]
    assert [r[0] for r in d.select(text.profile_label(F.col("x"), "mechanism")).collect()] == ["same artist", "shifting", "same collection/series", "unknown", "unknown", "shifting"]


def test_guardrails(spark):
    item = "array<struct<item_id:string,item_name:string,item_category:string,action_type:string>>"
    seq = lambda *ids: [(i, "n", "c", "purchase") for i in ids]
    d = spark.createDataFrame([(1, "repetition", "same item", "repeat", seq("1", "2", "3")), (2, "shifting", "mixed", "stable", seq("1", "1", "1")), (3, None, None, None, None)], f"i int, mechanism string, scope string, direction string, interaction_sequence {item}")
    got = {r["i"]: r for r in windows.guard_labels(d).collect()}
    assert (got[1]["mechanism"], got[1]["scope"], got[1]["direction"], len(got[1]["consistency_adjustments"])) == ("unknown", "mixed", "unknown", 3)
    assert (got[2]["mechanism"], got[2]["scope"], got[2]["direction"]) == ("shifting", "same item", "repeat")
    assert (got[3]["mechanism"], got[3]["structural_evidence"]["num_items"]) == ("unknown", 0)


def test_json_bodies(spark):
    d = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('pre {"a": {"b": 2}} post',), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(jsons.json_body(F.col("t"))).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', "none", None]
    assert jsons.first_value('a {bad} [1, {"x": "}]"}] tail') == '[1, {"x": "}]"}]'
    assert [r[0] for r in d.select(jsons.extract_json("t")).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]


ASSIGN = "memory_id string, user_id string, window_index int, state_id string, assignment_accepted boolean, assigned_at timestamp, clash string"


def test_segments_break_and_collapse(spark):
    d = spark.createDataFrame([("m1", "u", 0, "A", True, None, ""), ("m2", "u", 1, "X", False, None, ""), ("m3", "u", 2, "B", True, None, ""), ("m4", "u", 3, "B", True, None, ""), ("m4", "u", 3, "B", True, None, ""), (None, "u", 9, "Z", True, None, ""), ("m5", None, 1, "Q", True, None, "")], ASSIGN)
    one = segments.one_assignment(d)
    assert [(r["seg"], r["pos"], r["state_id"]) for r in segments.segments(one).orderBy("seg", "pos").collect()] == [(0, 0, "A"), (1, 0, "B"), (1, 1, "B")]
    c = segments.segments(one, collapse=True).orderBy("seg", "pos").collect()
    assert [(r["state_id"], r["memory_ids"]) for r in c] == [("A", ["m1"]), ("B", ["m3", "m4"])]
    assert segments.transition_stats(segments.segments(one)).first()["self_transitions"] == 1
    assert segments.latest_suffix(one).first()["suffix"] == ["B", "B"]


def _segs(spark, seqs):
    return spark.createDataFrame([(u, 0, p, s) for u, q in seqs.items() for p, s in enumerate(q)], "user_id string, seg int, pos int, state_id string")


def _direct(seqs, order=5, kappa=5.0):
    """Counts, smoothing and divergence by plain recursion."""
    import math
    from collections import defaultdict

    c = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for u, q in seqs.items():
        for t in range(1, len(q)):
            for n in range(min(order, t) + 1):
                c[tuple(q[t - n : t])][u][q[t]] += 1
    raw = {}
    for ctx, us in c.items():
        w = defaultdict(float)
        for ts in us.values():
            for t, n in ts.items():
                w[t] += n / sum(ts.values())
        raw[ctx] = {t: x / sum(w.values()) for t, x in w.items()}

    def smooth(ctx):
        if not ctx:
            return raw[()]
        lam, up = len(c[ctx]) / (len(c[ctx]) + kappa), smooth(ctx[1:])
        return {t: lam * raw[ctx].get(t, 0) + (1 - lam) * up[t] for t in up}

    def jsd(p, q):
        k = set(p) | set(q)
        m = {t: (p.get(t, 0) + q.get(t, 0)) / 2 for t in k}
        return sum(0.5 * d[t] * math.log2(d[t] / m[t]) for d in (p, q) for t in d if d[t] > 0)

    return raw, {x: smooth(x) for x in raw}, {x: jsd(raw[x], raw[x[1:]]) if x else 0.0 for x in raw}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from(["u1", "u2", "u3", "u4"]), st.lists(st.sampled_from("ABCD"), min_size=2, max_size=9), min_size=1))
def test_contexts_equal_direct_recursion(spark, seqs):
    raw, smooth, div = _direct(seqs)
    got = contexts.activate(contexts.contexts(contexts.context_counts(contexts.observations(_segs(spark, seqs))))).collect()
    assert {tuple(r["ctx"]) for r in got} == set(raw)
    for r in got:
        x = tuple(r["ctx"])
        assert r["raw"] == pytest.approx(raw[x]) and r["smoothed"] == pytest.approx(smooth[x]) and r["jsd"] == pytest.approx(div[x], abs=1e-9)
        assert sum(r["smoothed"].values()) == pytest.approx(1) and 0 <= r["jsd"] <= 1 and 0 < r["lambda"] <= 1
    assert contexts.orphans(spark.createDataFrame([(r["ctx"],) for r in got], "ctx array<string>")).count() == 0


def test_tree_miss_falls_back_to_root(spark):
    n = contexts.activate(contexts.contexts(contexts.context_counts(contexts.observations(_segs(spark, {"u": "ABAB", "v": "ABC"})))))
    q = contexts.query_tree(n, spark.createDataFrame([("x", ["Z"]), ("y", ["A"])], "user_id string, suffix array<string>"))
    got = {r["user_id"]: r for r in q.collect()}
    assert (got["x"]["matched"], got["x"]["context"], got["x"]["stop"]) == ([], [], "missing_reverse_edge")
    assert (got["y"]["matched"], got["y"]["stop"]) == (["A"], "history_exhausted")
    assert contexts.tree_edges(n).count() == n.count() - 1


def test_ranking_repairs(spark):
    d = spark.createDataFrame([(["b", "zz", "b", "a"], ["a", "b", "c"]), (None, ["a"])], "p array<string>, c array<string>")
    assert [r[0] for r in d.select(ranking.sanitize(F.col("p"), F.col("c"))).collect()] == [["b", "a", "c"], ["a"]]
    t = spark.createDataFrame([("C07, c 3, C99, C07",)], "t string").select(ranking.parse_labels(F.col("t"), F.lit(8)).alias("p")).first()["p"]
    assert t["positions"] == [7, 3, 1, 2, 4, 5, 6, 8] and not t["complete"] and t["reason"] == "repaired_out_of_range_and_duplicate_and_missing"
    r = spark.createDataFrame([(["a", "b"], "b"), (["a"], "z")], "r array<string>, t string")
    assert [x[0] for x in r.select(ranking.target_rank(F.col("r"), F.col("t"))).collect()] == [2, 2]


def test_shuffle_is_pythons(spark):
    c = spark.createDataFrame([("u1", ["a", "b", "c", "d"])], "user_id string, l array<string>").select(ranking.seeded_shuffle(42)("user_id", "l")).first()[0]
    want = ["a", "b", "c", "d"]
    random.Random("42:u1").shuffle(want)
    assert c == want


def test_metric_edges(spark):
    m = {(r["metric"]): r["value"] for r in ranking.rank_metrics(spark.createDataFrame([("m", 1), ("m", 5), ("m", 6)], "mode string, rank int"), (1, 5)).collect()}
    assert m["Hit@5"] == pytest.approx(2 / 3) and m["Hit@1"] == pytest.approx(1 / 3) and m["MedianRank"] == 5
    d = spark.createDataFrame([("u", ["a", "b"], ["a", "x"]), ("v", ["a"], [])], "user_id string, truth array<string>, predicted array<string>")
    r = ranking.list_metrics(d, (2,)).first()
    assert (r["users"], r["ndcg"], r["recall"]) == (1, 1.0, 0.5)


def test_candidates_cache_and_order(spark):
    c = spark.createDataFrame([("u", "a", ["a", "b"]), ("v", "a", ["b", "b"])], "user_id string, target string, candidates array<string>")
    assert [r["user_id"] for r in ranking.candidate_violations(c, 2).collect()] == ["v"]
    assert [r["user_id"] for r in ranking.same_candidates(c, spark.createDataFrame([("u", ["b", "a"]), ("v", ["b"])], "user_id string, candidates array<string>")).collect()] == ["v"]
    s = spark.createDataFrame([("u", 0, "a", None), ("u", 1, "b", 0.0), ("u", 2, "c", 1.0)], "user_id string, cand_pos int, item_id string, score double")
    assert [r["item_id"] for r in ranking.order_by_score(s).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r["item_id"] for r in ranking.order_by_score(s, float("-inf")).orderBy("rank").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize(("sims", "want"), [([], "no_memories:store"), ([0.1], "all_low:store"), ([0.7, 0.1], "medium:update+store"), ([0.9, 0.9, 0.7], "high_majority:update"), ([0.9, 0.1, 0.1, 0.7], "low_majority:store"), ([0.9, 0.9, 0.7, 0.7, 0.1], "high_share:update+store"), ([0.9, 0.7, 0.7, 0.1], "mixed:update+store")])
def test_zones(spark, sims, want):
    low, high = pool.thresholds(F.lit(0))
    d = spark.createDataFrame([(sims,)], "s array<double>")
    assert d.select(pool.zone(F.col("s"), F.lit(len(sims)), low, high)).first()[0] == want


def test_fold_and_config(spark):
    with pytest.raises(ValueError, match="low"):
        pool.PoolConfig(low=0.9, high=0.8)
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "thought_id bigint, embedding array<float>")
    got = {r["thought_id"]: r for r in pool.fold(d).collect()}
    assert (got[1]["stored"], got[2]["stored"], got[2]["updated"], got[3]["zone"], len(got)) == (True, False, [1], "all_low:store", 3)
    assert all(r["stored"] for r in pool.fold(d, pool.PoolConfig(evolving=False)).collect())
    assert pool.dimension_violations(d, 2).collect()[0]["thought_id"] == 5
    assert pool.replace_vectors(d, spark.createDataFrame([(1, [5.0, 5.0])], "thought_id bigint, embedding array<float>")).filter("thought_id = 1").first()["embedding"] == [5.0, 5.0]


def test_greedy_allocation_equals_the_ranked_form(spark):
    r = random.Random(3)
    for _ in range(3):
        sizes = {f"b{i}": r.randint(1, 30) for i in range(r.randint(1, 6))}
        k = r.randint(len(sizes), sum(sizes.values()))
        want = dict.fromkeys(sizes, 1)
        while sum(want.values()) < min(k, sum(sizes.values())):
            want[max((b for b in sizes if want[b] < sizes[b]), key=lambda b: (sizes[b] / want[b], sizes[b], b))] += 1
        got = vectors.allocate(spark.createDataFrame(list(sizes.items()), "bucket string, n bigint"), k)
        assert {x["bucket"]: x["clusters"] for x in got.collect()} == want
    with pytest.raises(ValueError, match="buckets"):
        vectors.allocate(spark.createDataFrame([("a", 1), ("b", 1)], "bucket string, n bigint"), 1)


def test_kmeans_separates_and_stays_in_buckets(spark):
    r = random.Random(5)
    pts = [(i, "a" if i % 3 else "b", [1.0 + r.random() / 50, r.random() / 50] if i % 2 else [r.random() / 50, 1.0]) for i in range(60)]
    d = spark.createDataFrame(pts, "vec_id bigint, label string, embedding array<float>")
    labels, st_ = vectors.bucketed_kmeans(d, 4, "vec_id", "label", "embedding")
    owner = {x["cluster_id"]: x["label"] for x in st_.collect()}
    got = {x["vec_id"]: (x["label"], x["cluster_id"]) for x in labels.collect()}
    assert all(owner[c] == b for b, c in got.values())
    assert len({got[i][1] for i, b, _ in pts if b == "a" and i % 2}) == 1
    one = vectors.assignment_diagnostics(d.filter("vec_id = 1").withColumn("cluster_id", F.lit(7)), spark.createDataFrame([(7, "a", [1.0, 0.0])], "cluster_id int, label string, centroid array<double>"), "vec_id", "label", "embedding").first()
    assert one["margin"] is None and one["accepted"]


def test_map_falls_back_and_rejects(spark):
    s = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0])], "cluster_id int, label string, centroid array<double>")
    b = spark.createDataFrame([(1, "a", [1.0, 0.1]), (2, "z", [1.0, 0.0])], "vec_id bigint, label string, embedding array<float>")
    got = {r["vec_id"]: r for r in vectors.map_to_states(b, s, "vec_id", "label", "embedding").collect()}
    assert got[1]["accepted"] and not got[2]["accepted"] and got[2]["reason"] == "missing_compatible_mechanism_bucket"


def test_memory_contract_and_views(spark):
    d = spark.createDataFrame([(1, "u", 0, "e", "p", ["k"], memories.SCHEMA_VERSION), (1, "u", 0, "other", "p", ["k"], memories.SCHEMA_VERSION), (2, None, 0, "e", "p", None, "old")], "precompute_id bigint, user_id string, window_index int, behavior_explanation string, pattern_description string, keywords array<string>, schema_version string")
    assert {(r["precompute_id"], r["violation"]) for r in memories.contract_violations(d).collect()} == {(1, "duplicate id"), (2, "schema_version"), (2, "missing user_id"), (2, "missing keywords")}
    with pytest.raises(ValueError, match="embeddings"):
        memories.contract_violations(d.withColumn("embedding", F.lit(1)))
    c = spark.createDataFrame([("u", True, [(1, "b"), (0, "a")], 0), ("u", True, [(3, "c")], 1), ("v", None, [(0, "x")], 0), ("w", False, [(0, "x")], 0), ("z", True, [], 0)], "user_id string, precompute_ok boolean, generated_behaviors array<struct<window_index:int,m:string>>, file_pos int")
    assert [(r["user_id"], [b["m"] for b in r["generated_behaviors"]]) for r in memories.behavior_cache(c).collect()] == [("u", ["c"])]
    assert {r["user_id"] for r in memories.successful_users(c).collect()} == {"u", "v"}
    assert memories.pending(c.select("user_id"), c.filter("user_id = 'u'").select("user_id"), ["user_id"]).count() == 3


def test_state_profile_majority_and_medoid(spark):
    m = spark.createDataFrame([("m1", "u", "C1", 0.9, True, "a", "s", "d", 0), ("m2", "v", "C1", 0.9, True, "b", "s", "d", 1), ("m3", "v", "C1", 0.5, False, "b", "s", "d", 2)], "memory_id string, user_id string, state_id string, similarity double, accepted boolean, mechanism string, scope string, direction string, row_idx bigint")
    r = states.state_profiles(m).first()
    assert (r["members"], r["accepted"], r["users"], r["medoid"], r["mechanism"], r["majority_share"]) == (3, 2, 2, "m1", "a", 0.5)


def test_models_and_providers(spark):
    d = spark.createDataFrame([("x",), ("y",)], "prompt string")
    assert {r["answer"] for r in providers.answered_by(d, lambda ts: [t.upper() for t in ts]).collect()} == {"X", "Y"}
    assert {r["answer"] for r in providers.answered_by(d, lambda ts: 1 / 0).collect()} == {""}
    s = spark.createDataFrame([("u", p, i, "train") for p, i in enumerate("aab")], "user_id string, pos int, item_id string, split string")
    assert {(r["item_id"], r["next_item"]): r["score"] for r in baselines.markov_scores(s).collect()} == {("a", "a"): 0.5, ("a", "b"): 0.5}


def test_running_totals(spark):
    from wakeline.operators.order import ordinals, running_total

    d = spark.createDataFrame([(i, i % 3) for i in range(50)], "i int, v int").repartition(7)
    got = {r["i"]: r["t"] for r in running_total(d, ["i"], F.col("v"), "t").collect()}
    assert got == {i: sum(k % 3 for k in range(i)) for i in range(50)}
    assert {r["i"]: r["ordinal"] for r in ordinals(d, ["i"]).collect()} == {i: i for i in range(50)}


def test_pipelines_end_to_end(spark, tmp_path):
    from wakeline.plans import pipelines, tables
    from wakeline.plans.config import PrepConfig, TreeConfig
    from wakeline.sources import writers

    sf = "/root/testdata/sf0.001"
    p = pipelines.prepare(tables.read(spark, sf, "ratings"), tables.read(spark, sf, "items"), PrepConfig(max_items=200))
    assert p["violations"].count() == 0 and p["candidates"].count() == p["sequences"].select("user_id").distinct().count()
    assert pipelines.extract(p["sequences"], p["items"]).filter("mechanism is null").count() == 0
    records = tables.read(spark, sf, "local_memory")
    vec = records.select(F.concat(F.lit("M"), "precompute_id").alias("memory_id"), F.array(*[((F.xxhash64("precompute_id", F.lit(k)) % 1000) / 1000).cast("float") for k in range(8)]).alias("embedding")).distinct()
    usable = memories.usable_memories(memories.one_record_per_id(records)).filter("invalid_reason is null").select("memory_id")
    t = pipelines.build_tree(records, vec.join(usable, "memory_id"), TreeConfig(clusters=20, rounds=2, restarts=1, min_similarity=0.2, min_margin=0.0, max_order=2))
    writers.tables(t, str(tmp_path / "tree"))
    assert contexts.orphans(writers.read_tables(spark, str(tmp_path / "tree"))["nodes"]).count() == 0
    with pytest.raises(ValueError, match="number"):
        pipelines.build_tree(records, vec.limit(3))
    r = p["candidates"].select("user_id", F.lit("native").alias("mode"), F.reverse("candidates").alias("predicted"))
    e = pipelines.evaluate(r, p["candidates"])
    assert e["metrics"].filter("metric = 'Hit@20'").first()["value"] == 1.0 and e["strict_metrics"].count() == e["metrics"].count()


@pytest.mark.parametrize("cut", [1, 2, 3, 4])
def test_fold_resumes_and_links(spark, cut):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.02]), (3, [1.0, 0.03]), (4, [0.0, 1.0]), (5, [0.9, 0.5]), (6, [1.0, 0.01])]  # 2 and 3 only update
    d = spark.createDataFrame(rows, "thought_id bigint, embedding array<float>")
    told = lambda f: {r["thought_id"]: (r["zone"], r["stored"], r["updated"]) for r in f.collect()}
    whole = pool.fold(d)
    assert told(whole)[2][1:] == told(whole)[3][1:] == (False, [1])
    part = pool.fold(d.filter(F.col("thought_id") <= cut))
    left = pool.pool_after(d, part)
    rest = pool.fold(d, resume=left, processed=pool.progress(part))
    assert told(rest) == {k: v for k, v in told(whole).items() if k > cut}
    after = lambda p: {r["thought_id"]: r["evolution_count"] for r in p.collect()}
    assert after(pool.pool_after(d, rest, resume=left)) == after(pool.pool_after(d, whole))
    assert pool.progress(rest, before=pool.progress(part)).first()["last_id"] == 6
    if cut == 1:
        with pytest.raises(ValueError, match="built under"):
            pool.fold(d, pool.PoolConfig(low=0.1), resume=left, processed=pool.progress(part))
        with pytest.raises(ValueError, match="progress"):
            pool.fold(d, resume=left)
        assert all(not r["links"] for r in pool.fold(d, linker=lambda i, ids: [99]).collect())
        assert all(not r["links"] for r in pool.fold(d, linker=lambda i, ids: 1 / 0).collect())


def test_fold_keeps_progress_by_shard(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.0]), ("a", 9, [1.0, 0.01]), ("b", 3, [1.0, 0.01])]
    d = spark.createDataFrame(rows, "s string, thought_id bigint, embedding array<float>")
    part = pool.fold(d.filter("s = 'a' or thought_id = 2"), shard="s")
    left = pool.pool_after(d, part, shard="s")
    got = pool.fold(d, shard="s", resume=left, processed=pool.progress(part)).collect()
    assert [(r["shard"], r["thought_id"], r["updated"]) for r in got] == [("b", 3, [2])]


def test_fold_evolves_texts_and_vectors(spark):
    d = spark.createDataFrame([(1, "old", [1.0, 0.0]), (2, "more", [1.0, 0.01]), (3, "again", [0.0, 1.0]), (4, "bad", [1.0, 0.02])], "thought_id bigint, t string, embedding array<float>")

    def evolver(i, text, linked):
        return {k: {2: "turned", 3: w, 4: "N/A"}[i] for k, w in linked} | {77: "made up"}

    f = pool.fold(d, evolver=evolver, encoder=lambda ts: [[0.0, 1.0] for _ in ts], text="t")
    got = {r["thought_id"]: r for r in f.collect()}
    assert [(x["thought_id"], x["text"], x["embedding"]) for x in got[2]["changed"]] == [(1, "turned", [0.0, 1.0])]
    assert got[3]["links"] == [1] and not got[3]["updated"]  # its vector moved, its text stayed
    assert got[4]["zone"] == "all_low:store"
    p = {r["thought_id"]: r for r in pool.pool_after(d, f, text="t").collect()}
    assert (p[1]["t"], p[1]["evolution_count"], p[1]["embedding"]) == ("turned", 1, [0.0, 1.0])
    assert [(r["by_id"], r["thought_id"], r["text"]) for r in pool.evolution_log(f).collect()] == [(2, 1, "turned")]
    assert pool.fold(d, evolver=lambda *a: 1 / 0, encoder=lambda ts: ts, text="t").filter(F.size("changed") > 0).count() == 0
    with pytest.raises(ValueError, match="again"):
        pool.checked_pool(d.unionByName(d), 2)
    assert pool.checked_pool(d, 2).count() == 4


def test_providers_and_ranked_rows(spark):
    d = spark.createDataFrame([("u", "native", "p1"), ("u", "tree", "p2")], "user_id string, mode string, prompt string")
    ok = providers.answered_by(d, lambda ts: ["C02, C01" for _ in ts])
    bad = providers.answered_by(d.coalesce(1), lambda ts: [*ts, "one more"])
    assert {r["error"] for r in ok.collect()} == {None} and all("answers" in r["error"] and r["answer"] == "" for r in bad.collect())
    log = providers.call_log(ok, "rank").collect()
    assert len({r["call_id"] for r in log}) == 2 and {(r["input_tokens"], r["output_tokens"], r["parse_ok"]) for r in log} == {(1, 2, True)}
    c = spark.createDataFrame([("u", "b", ["a", "b"])], "user_id string, target string, candidates array<string>")
    rows = reports.ranked_rows(d, ok, c).collect()
    assert {(r["mode"], tuple(r["ranking"]), r["rank"], r["complete"]) for r in rows} == {("native", ("b", "a"), 1, True), ("tree", ("b", "a"), 1, True)}
    said = reports.sample_text(reports.ranked_rows(d, ok, c).join(d, ["user_id", "mode"])).first()["text"]
    assert "target b at 1" in said and "1. b  <- target" in said
    e = providers.encoded_by(d, providers.hashed_encoder(8), "prompt").collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in e)
    h = spark.createDataFrame([("u", "x\ny")], "user_id string, history string")
    tree = spark.createDataFrame([("u", 1, "C001", 0.5, "m", "s", "d")], "user_id string, rank int, state_id string, probability double, mechanism string, scope string, direction string")
    last = spark.createDataFrame([("v", "m", "s", "d", "t")], "user_id string, mechanism string, scope string, direction string, trajectory_signature string")
    p = {r["mode"]: r["prompt"] for r in providers.ranking_conditions(c, h, tree, last).collect()}
    assert set(p) == set(providers.CONDITIONS) and "next state C001" in p["tree"] and "Evidence" not in p["native"] + p["latest_only"] and all("C02: b" in x for x in p.values())


def test_candidate_files_override_and_checks_raise(spark):
    c = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "c", ["c", "d"])], "user_id bigint, target string, candidates array<string>")
    f = lambda *rows: spark.createDataFrame(list(rows), "user_id string, candidates array<string>")
    assert {r["user_id"]: r["candidates"] for r in ranking.override_candidates(c, f(("1", ["x", "a"]))).collect()} == {1: ["x", "a"], 2: ["c", "d"]}
    for bad in (["x"], ["a", "a"], ["a", "x", "x"]):
        with pytest.raises(ValueError, match="candidate list of 1"):
            ranking.override_candidates(c, f(("1", bad)))
    with pytest.raises(ValueError, match="candidate list of 2"):
        ranking.override_candidates(c, f(("1", ["a"])), required=True)
    h = spark.createDataFrame([("u", ["a", "b"])], "user_id string, train array<string>")
    k = lambda x: spark.createDataFrame([("u", x)], "user_id string, cached array<string>")
    assert ranking.checked_history(k(["a", "b"]), h).count() == 1
    with pytest.raises(ValueError, match="differs at 2"):
        ranking.checked_history(k(["a", "x"]), h)
    seq = spark.createDataFrame([(1, 5, "test"), (2, 6, "test")], "user_id bigint, item_id bigint, split string")
    neg = spark.createDataFrame([(1, "test", 1, 9)], "user_id bigint, split string, slot int, item_id bigint")
    assert {r["user_id"]: len(r["candidates"]) for r in ranking.candidate_lists(seq, neg).collect()} == {1: 2, 2: 1}


def test_answers_in_lists_and_signatures(spark):
    d = spark.createDataFrame([('[{"a": "x"}, {"a": "y"}]',), ('[1, {"a": "z"}]',), ("```json\n[{\"a\": \"f\"}]\n```",), ('so {"a": "w"} it is',), ("[]",), ("no",), (None,)], "t string")
    assert [r["x"]["a"] if r["x"] else None for r in d.select(memories.parsed_response(F.col("t"), "a string").alias("x")).collect()] == ["x", "z", "f", "w", None, None, None]
    s = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b")], "s string, alias string")
    for rule, want in (("builder", ["a", "b", "b"]), ("inference", ["a", "", "b"])):
        assert [r[0] for r in s.select(text.trajectory(F.col("s"), F.col("alias"), rule)).collect()] == want


def test_kmeans_modes_and_search_rollup(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 2, (np.eye(4)[i % 4] + 0.05 * r.normal(size=4)).tolist()) for i in range(80)]
    d = spark.createDataFrame(rows, "id bigint, b int, v array<double>")
    labels, st = vectors.run_kmeans(d, 4, "id", "v")
    assert len({(x["cluster_id"], x["id"] % 4) for x in labels.collect()}) == 4 and st.columns == ["cluster_id", "centroid"]
    labels, _ = vectors.run_kmeans(d, 4, "id", "v", "b")
    assert len({(x["cluster_id"], x["id"] % 4, x["b"]) for x in labels.collect()}) == 4
    with pytest.raises(ValueError, match="81 clusters"):
        vectors.run_kmeans(d, 81, "id", "v")
    log = spark.createDataFrame([("search", 10, 0.5), ("search", 20, 1.5), ("add", None, 0.1)], "op string, comparisons bigint, seconds double")
    assert {x["op"]: (x["calls"], x["comparisons"], round(x["mean_ms"])) for x in reports.search_rollup(log).collect()} == {"search": (2, 30, 1000), "add": (1, 0, 100)}
    t = spark.createDataFrame([("Same-Artist_x",), (" ",), (None,)], "c string")
    assert [x[0] for x in t.select(text.test_label(F.col("c"))).collect()] == ["same artist x", "", ""]


def test_small_helpers(spark):
    assert reports.incompatible({"a": 1, "b": 2}, {"a": 1, "b": 3}, ("a", "b")) == ["b: 2 and 3"]
    p = spark.createDataFrame([("u", 5, 1), ("v", 1, 9), ("w", 3, 2)], "user_id string, rank int, base_rank int")
    got = {m: [r["user_id"] for r in reports.debug_rows(p, m, 2).collect()] for m in ("first", "degraded", "improved", "largest_drop")}
    assert got == {"first": ["u", "v"], "degraded": ["u", "w"], "improved": ["v"], "largest_drop": ["u", "w"]}
    assert reports.debug_rows(p, "random", 2).count() == 2
    c = spark.createDataFrame([("u", ["a"])], "user_id string, candidates array<string>")
    assert ranking.candidate_cache(c, spark.createDataFrame([("u", ["a"]), ("v", ["b"])], c.schema)).count() == 2
    with pytest.raises(ValueError, match="differ"):
        ranking.candidate_cache(c, spark.createDataFrame([("u", ["z"])], c.schema))
    e = contexts.evidence_sample(spark.createDataFrame([(["a"], "b", i) for i in range(9)], "ctx array<string>, target string, i int"), 4, "i")
    assert e.count() == 4
    with pytest.raises(ValueError, match="ROOT"):
        contexts.checked_nodes(spark.createDataFrame([(["a"],)], "ctx array<string>"))
    b = memories.bounded_behavior(spark.createDataFrame([(7.0, [" x ", ""]), (None, None), (float("nan"), ["a"])], "confidence double, semantic_focus array<string>"))
    assert [(r["confidence"], r["semantic_focus"]) for r in b.collect()] == [(1.0, ["x"]), (0.0, []), (0.0, ["a"])]
    x = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.0, 1.0]), (1, [0.1, 1.0])], "label int, embedding array<float>")
    assert vectors.silhouette(x) > 0.9
