"""Variable-order context statistics and the reverse suffix tree, as tables.

A context is an array of states; every occurrence of a context is one of its suffix parent (the context without its
earliest state), so contexts are closed under suffixes. Recursion over suffixes becomes one equi-join on suffixes that are
exploded, and walking the tree becomes looking for the longest suffix that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.storage import keep

#: ROOT's distribution is broadcast for up to this many states
STATE_LIMIT = 1_000_000


def suffix_parent(ctx: Column) -> Column:
    return F.slice(ctx, 2, F.greatest(F.size(ctx) - 1, F.lit(0)))


def node_id(ctx: Column) -> Column:
    """ROOT, or CTX_<length>_<first 12 hex digits of the SHA-1 of the states joined by |>."""
    return F.when(F.size(ctx) == 0, "ROOT").otherwise(F.concat(F.lit("CTX_"), F.size(ctx).cast("string"), F.lit("_"), F.substring(F.sha1(F.array_join(ctx, "|")), 1, 12)))


def observations(segs: DataFrame, max_order: int = 5) -> DataFrame:
    """(user_id, ctx, target): each entry of a segment but the first, once for every suffix of up to max_order states before it
    (none for ROOT). Windows of max_order rows; a long segment is never gathered."""
    v = Window.partitionBy("user_id", "seg").orderBy("pos")
    before = segs.withColumn("before", F.collect_list("state_id").over(v.rowsBetween(-max_order, -1))).filter(F.size("before") > 0)
    suffixes = F.transform(F.sequence(F.lit(0), F.size("before")), lambda n: F.slice("before", F.size("before") - n + 1, n))
    return before.select("user_id", F.explode(suffixes).alias("ctx"), F.col("state_id").alias("target"))


def context_counts(obs: DataFrame) -> DataFrame:
    """(ctx, user_id, target, n): the pre-aggregate all weights roll up from. ROOT, which sees every transition, leaves each map task as one row a user and target."""
    return obs.groupBy("ctx", "user_id", "target").agg(F.count("*").alias("n"))


def weights(counts: DataFrame, mode: str = "user_normalized") -> DataFrame:
    """(ctx, target, weight, occurrences, users). occurrence: counts; distinct_user: users; user_normalized: the sum of each user's share."""
    c = counts
    if mode == "user_normalized":
        own = counts.groupBy("ctx", "user_id").agg(F.sum("n").alias("own"))
        c = counts.join(own, ["ctx", "user_id"]).withColumn("w", F.col("n") / F.col("own"))
    elif mode == "occurrence":
        c = counts.withColumn("w", F.col("n").cast("double"))
    elif mode == "distinct_user":
        c = counts.withColumn("w", F.lit(1.0))
    else:
        raise ValueError(f"unknown count mode {mode}")
    return c.groupBy("ctx", "target").agg(F.sum("w").alias("weight"), F.sum("n").alias("occurrences"), F.count("*").alias("users"))


def support(counts: DataFrame) -> DataFrame:
    """(ctx, support_users, support_occurrences)."""
    per_user = counts.groupBy("ctx", "user_id").agg(F.sum("n").alias("n"))
    return per_user.groupBy("ctx").agg(F.count("*").alias("support_users"), F.sum("n").alias("support_occurrences"))


def contexts(counts: DataFrame, mode: str = "user_normalized", kappa: float = 5.0) -> DataFrame:
    """One row a context: raw and smoothed next-state distributions as maps, smoothing weight, supports.

    smooth = l * raw + (1 - l) * smooth(parent), l = users / (users + kappa), 1 at ROOT. Unrolled: the context's chain of suffixes but
    ROOT is exploded, joined once to (raw, l), and folded over ROOT's states from ROOT down. ROOT, a suffix of every context, is no
    join key: it is one row, of as many entries as there are states, broadcast after a check of that number.
    """
    w = weights(counts, mode)
    total = w.groupBy("ctx").agg(F.sum("weight").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "weight")))).alias("m"))
    raw = total.select("ctx", F.transform_values("m", lambda k, x: x / F.col("total")).alias("raw"))
    lam = F.when(F.size("ctx") == 0, 1.0).otherwise(F.when(F.lit(kappa) <= 0, 1.0).otherwise(F.col("support_users") / (F.col("support_users") + F.lit(kappa))))
    node = keep(raw.join(support(counts), "ctx").withColumn("lambda", lam), "contexts")
    root = node.filter(F.size("ctx") == 0).select(F.map_keys("raw").alias("states"), F.col("raw").alias("root"))
    if (root.agg(F.max(F.size("states")).alias("n")).first()["n"] or 0) > STATE_LIMIT:
        raise ValueError("over the number of states whose distribution is broadcast")
    chain = node.filter(F.size("ctx") > 0).select("ctx", F.explode(F.sequence(F.lit(1), F.size("ctx"))).alias("j")).select("ctx", "j", F.slice("ctx", F.size("ctx") - F.col("j") + 1, F.col("j")).alias("sfx"))
    parts = chain.join(node.select(F.col("ctx").alias("sfx"), F.col("raw").alias("r"), F.col("lambda").alias("l")), "sfx")
    by_length = lambda x, y: x["j"] - y["j"]
    folded = parts.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("j", "r", "l")), by_length).alias("chain"))
    given = F.coalesce("chain", F.array().cast(folded.schema["chain"].dataType))
    smooth = F.map_from_arrays("states", F.transform("states", lambda t: F.aggregate(given, F.element_at("root", t), lambda acc, x: x["l"] * F.coalesce(F.try_element_at(x["r"], t), F.lit(0.0)) + (1 - x["l"]) * acc)))
    return node.join(folded, "ctx", "left").crossJoin(F.broadcast(root)).select(*node.columns, smooth.alias("smoothed"))  # root: one row


def entropy_bits(dist: Column) -> Column:
    return F.aggregate(F.map_values(dist), F.lit(0.0), lambda a, p: a - F.when(p > 1e-12, p * F.log2(p)).otherwise(0.0))


def js_bits(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two distributions as maps; null if one is null."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    term = lambda x, m: F.when(x > 1e-12, x * F.log2(x / m)).otherwise(0.0)
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    each = F.aggregate(keys, F.lit(0.0), lambda a, k: a + 0.5 * term(at(p, k), (at(p, k) + at(q, k)) / 2) + 0.5 * term(at(q, k), (at(p, k) + at(q, k)) / 2))
    return F.when(p.isNotNull() & q.isNotNull(), F.greatest(F.lit(0.0), each))


def activate(nodes: DataFrame, min_users: int = 3, min_occurrences: int = 3, min_jsd: float = 0.05, promote_order1: bool = True) -> DataFrame:
    """nodes with parent, divergence from the parent's raw distribution, and whether the context predicts on its own."""
    parent = nodes.select(F.col("ctx").alias("parent"), F.col("raw").alias("parent_raw"))
    d = nodes.withColumn("parent", suffix_parent(F.col("ctx"))).join(parent, "parent", "left")
    d = d.withColumn("jsd", F.when(F.size("ctx") == 0, F.lit(0.0)).otherwise(F.coalesce(js_bits(F.col("raw"), F.col("parent_raw")), F.lit(0.0))))
    eligible = (F.col("support_users") >= min_users) & (F.col("support_occurrences") >= min_occurrences)
    reason = F.when(F.size("ctx") == 0, "root").when(~eligible, "insufficient_support")
    if promote_order1:
        reason = reason.when(F.size("ctx") == 1, "order1_base_context")
    reason = reason.when(F.col("jsd") >= min_jsd, "predictive_gain").otherwise("low_predictive_gain")
    d = d.withColumn("eligible", eligible).withColumn("reason", reason)
    d = d.withColumn("active", F.col("reason").isin("root", "order1_base_context", "predictive_gain"))
    return d.withColumn("entropy", entropy_bits(F.col("raw"))).drop("parent_raw")


def backoff(nodes: DataFrame) -> DataFrame:
    """(ctx, backoff): the longest strictly shorter suffix that is active; ROOT has none."""
    shorter = nodes.filter(F.size("ctx") > 1).select("ctx", F.explode(F.sequence(F.lit(1), F.size("ctx") - 1)).alias("n"))
    shorter = shorter.select("ctx", "n", F.slice("ctx", F.size("ctx") - F.col("n") + 1, F.col("n")).alias("sfx"))
    on = nodes.filter("active").select(F.col("ctx").alias("sfx"))
    found = shorter.join(on, "sfx", "left_semi").groupBy("ctx").agg(F.max_by("sfx", "n").alias("backoff"))
    # ROOT is always active, and no join key
    return nodes.filter(F.size("ctx") > 0).select("ctx").join(found, "ctx", "left").select("ctx", F.coalesce("backoff", F.array().cast("array<string>")).alias("backoff"))


def tree_edges(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, token): the edge from the suffix parent is the earliest state. Inactive nodes stay."""
    ctx = F.col("ctx")
    return nodes.filter(F.size(ctx) > 0).select(node_id(ctx).alias("node_id"), node_id(suffix_parent(ctx)).alias("parent_id"), ctx[0].alias("token"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Contexts whose suffix parent is missing: none in a valid tree."""
    return nodes.filter(F.size("ctx") > 0).select("ctx", suffix_parent(F.col("ctx")).alias("parent")).join(nodes.select(F.col("ctx").alias("parent")), "parent", "left_anti")


def next_states(nodes: DataFrame, top: int = 5, column: str = "smoothed") -> DataFrame:
    """(ctx, rank, state_id, probability): by probability, then state; top <= 0 takes all."""
    rows = nodes.select("ctx", F.explode(column).alias("state_id", "probability"))
    w = Window.partitionBy("ctx").orderBy(F.desc(F.round("probability", 12)), "state_id")
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows.filter(F.col("rank") <= top) if top > 0 else rows


def query_tree(nodes: DataFrame, recent: DataFrame, max_order: int = 5, top: int = 3) -> DataFrame:
    """For each (user_id, suffix): the deepest context and the deepest active one among the suffix's ends, why the walk stops, and the
    active one's first `top` next states. Users whose ends are unknown fall back to ROOT, which is one broadcast row and no join key.
    Without a ROOT there are no rows."""
    s = recent.withColumn("q", F.slice("suffix", F.greatest(F.size("suffix") - max_order + 1, F.lit(1)), max_order)).select("user_id", F.size("q").alias("n"), "q")
    ends = s.filter("n > 0").select("user_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("q")), lambda k: F.slice("q", F.size("q") - k + 1, k))).alias("ctx"))
    got = ends.join(nodes.select("ctx", "active"), "ctx").groupBy("user_id").agg(F.max_by("ctx", F.size("ctx")).alias("matched"), F.max_by("ctx", F.when(F.col("active"), F.size("ctx"))).alias("context"))
    best = next_states(nodes.filter("active"), top).groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("rank", "state_id", F.round("probability", 6).alias("probability")))).alias("next")).withColumnRenamed("ctx", "context")
    empty = F.array().cast("array<string>")
    root = nodes.filter(F.size("ctx") == 0).select("ctx").join(best.filter(F.size("context") == 0), F.expr("true"), "left").select(F.col("next").alias("root_next"))
    walked = s.join(got, "user_id", "left").select("user_id", "n", F.coalesce("matched", empty).alias("matched"), "context")
    found = walked.join(best.filter(F.size("context") > 0), "context", "left").crossJoin(F.broadcast(root))  # root: one row
    stop = F.when(F.size("matched") == F.col("n"), "history_exhausted").otherwise("missing_reverse_edge")
    return found.select("user_id", "matched", F.coalesce("context", empty).alias("context"), stop.alias("stop"), F.when(F.col("context").isNull(), F.col("root_next")).otherwise(F.col("next")).alias("next"))


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """nodes, after the invariants of a stored tree: ROOT is there and no context lacks its suffix parent; else raises."""
    if not nodes.filter(F.size("ctx") == 0).limit(1).count():
        raise ValueError("no ROOT")
    if orphans(nodes).limit(1).count():
        raise ValueError("contexts without their suffix parent")
    return nodes


def evidence_sample(obs: DataFrame, most: int, *id_columns: str) -> DataFrame:
    """(ctx, target, ...): up to `most` observations of each context and target, those of the smallest hash: a sample that doesn't depend on
    order or partitioning. A top-n window, so ROOT isn't gathered."""
    w = Window.partitionBy("ctx", "target").orderBy(F.xxhash64(*id_columns), *id_columns)
    return obs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def rank_evidence(queried: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, rank, state_id, probability, mechanism, scope, direction, support): what a ranker is told of each predicted state."""
    rows = queried.select("user_id", F.explode("next").alias("x")).select("user_id", "x.rank", "x.state_id", F.round("x.probability", 6).alias("probability"))
    p = profiles.select("state_id", "mechanism", "scope", "direction", F.col("users").alias("support"))
    return rows.join(p, "state_id", "left").select("user_id", "rank", "state_id", "probability", "mechanism", "scope", "direction", "support")


def distribution_rows(nodes: DataFrame, counts: DataFrame, texts: DataFrame, top: int = 5, column: str = "smoothed") -> DataFrame:
    """(ctx, rank, state_id, probability, state_text, mechanism, scope, direction, occurrences, users): the first next states of every context with what is known
    of the state (texts: state_id, state_text, mechanism, scope, direction) and how often, and for how many users, it followed."""
    n = counts.groupBy("ctx", F.col("target").alias("state_id")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("users"))
    d = next_states(nodes, top, column).join(n, ["ctx", "state_id"], "left").join(texts, "state_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("ctx", "rank", "state_id", "probability", F.coalesce("state_text", F.lit("")).alias("state_text"), "mechanism", "scope", "direction", zero("occurrences"), zero("users"))
