"""Named queries of the behaviour pipeline, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import text
from wakeline.operators import baselines, contexts, items, memories, order, pool, prep, providers, ranking, reports, segments, states, vectors, windows
from wakeline.plans import sql as S
from wakeline.plans import tables as T
from wakeline.sources import readers
from wakeline.storage import keep

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle is not None:
            _sql[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _big(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def _ctx() -> F.Column:
    return F.array_join("ctx", "|").alias("ctx")


# --- histories ---------------------------------------------------------------------------------------------------


@query(f"WITH {S.HISTORIES} SELECT user_id, item_id, rating, ts::BIGINT AS ts FROM latest")
def interactions_latest(spark, sf):
    return prep.latest_interactions(T.read(spark, sf, "ratings"))


@query(f"WITH {S.HISTORIES} SELECT DISTINCT user_id, n_items FROM hist")
def user_length_filter(spark, sf):
    return T.histories(spark, sf).select("user_id", "n_items").distinct()


@query(f"WITH {S.HISTORIES} SELECT item_id, count(*) AS users FROM hist GROUP BY 1")
def item_popularity(spark, sf):
    return prep.popularity(T.histories(spark, sf))


@query(f"WITH {S.HISTORIES} SELECT count(DISTINCT user_id) AS users, count(*) AS interactions, min(n_items) AS min_length, max(n_items) AS max_length, count(DISTINCT item_id) AS items FROM hist")
def corpus_stats(spark, sf):
    return prep.corpus_stats(T.histories(spark, sf))


@query(f"WITH {S.HISTORIES} SELECT user_id, pos::BIGINT AS pos, item_id, split FROM seqs")
def leave_two_out(spark, sf):
    return T.sequences(spark, sf).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""WITH {S.HISTORIES} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY pos) AS items FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM seqs WHERE split = 'train') WHERE r <= 10 GROUP BY 1""")
def last_n_history(spark, sf):
    return prep.last_n(T.sequences(spark, sf), 10).select("user_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(f"""WITH {S.HISTORIES}, u AS (SELECT item_id, 0 AS source, 0 AS first_user, 0 AS first_seen FROM items WHERE item_id IS NOT NULL UNION ALL SELECT item_id::VARCHAR, 1, user_id, pos FROM seqs WHERE split = 'train'),
first_of AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY source, first_user, first_seen) AS n FROM u)
SELECT item_id, source::BIGINT AS source, first_user::BIGINT AS first_user, first_seen::BIGINT AS first_seen FROM first_of WHERE n = 1""")
def train_vocabulary(spark, sf):
    return prep.train_vocabulary(T.read(spark, sf, "items").filter("item_id is not null"), T.sequences(spark, sf)).select("item_id", *_big("source", "first_user", "first_seen"))


_NEG = f"""WITH {S.HISTORIES},
cdf AS (SELECT item_id, sum(users) OVER (ORDER BY item_id) - users AS lo, sum(users) OVER () AS total FROM (SELECT item_id, count(*) AS users FROM hist GROUP BY 1)),
us AS (SELECT DISTINCT user_id, split, CASE WHEN n_items > 500 THEN 4097 ELSE 257 END AS draws FROM hist, (VALUES ('val'), ('test')) v(split)),
hit AS (SELECT user_id, split, draw, ('0x' || substr(md5('42:' || split || ':' || user_id || ':' || draw), 1, 12))::BIGINT % (SELECT max(total) FROM cdf) AS u FROM (SELECT user_id, split, unnest(range(1, draws)) AS draw FROM us)),
landed AS (SELECT h.user_id, h.split, h.draw, c.item_id FROM hit h ASOF JOIN cdf c ON h.u >= c.lo),
fresh AS (SELECT l.user_id, l.split, l.item_id, min(l.draw) AS draw FROM landed l LEFT JOIN hist t ON t.user_id = l.user_id AND t.item_id = l.item_id WHERE t.user_id IS NULL GROUP BY ALL),
slots AS (SELECT user_id, split, row_number() OVER (PARTITION BY user_id, split ORDER BY draw) AS slot, item_id FROM fresh)
SELECT user_id, split, slot::BIGINT AS slot, item_id FROM slots WHERE slot <= 19"""


@query(_NEG)
def popularity_negatives(spark, sf):
    return prep.popularity_negatives(T.histories(spark, sf)).withColumn("slot", F.col("slot").cast("bigint"))


# --- items, windows ----------------------------------------------------------------------------------------------


@query(f"WITH {S.ITEMS} SELECT * FROM info")
def item_info(spark, sf):
    return T.info(spark, sf)


@query(f"WITH {S.ITEMS} SELECT item_id, coalesce(title, 'Unknown Item ' || item_id) AS item_name, coalesce(main_cat, category, nullif(array_to_string(g[1:3], ' > '), ''), 'Unknown') AS item_category FROM one_item JOIN genre USING (item_id)")
def item_info_flat(spark, sf):
    return T.info(spark, sf, "flat")


_CHUNKS = f"""{S.HISTORIES}, {S.ITEMS},
recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS back FROM seqs WHERE split = 'train'),
known AS (SELECT r.user_id, r.pos, r.back, i.item_id, i.item_name, i.item_category FROM recent r JOIN info i ON i.item_id = r.item_id::VARCHAR WHERE r.back <= 30),
valid AS (SELECT *, row_number() OVER w AS v, string_agg(item_id, ',') OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS items FROM known WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
chunk AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS window_index, items FROM valid WHERE v % 3 = 0 OR back = 1)"""


@query(f"WITH {_CHUNKS} SELECT user_id, window_index::BIGINT AS window_index, items FROM chunk")
def chunk_windows(spark, sf):
    w = windows.chunk_windows(T.sequences(spark, sf), T.info(spark, sf))
    return w.select("user_id", *_big("window_index"), F.array_join("interaction_sequence.item_id", ",").alias("items"))


@query(f"""WITH {_CHUNKS}, us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_order FROM (SELECT DISTINCT user_id FROM seqs))
SELECT user_id, window_index::BIGINT AS window_index, user_order::BIGINT AS user_order, (row_number() OVER (ORDER BY user_order, window_index) - 1)::BIGINT AS precompute_id FROM chunk JOIN us USING (user_id)""")
def numbered_windows(spark, sf):
    seq = T.sequences(spark, sf)
    users = order.ordinals(seq.select("user_id").distinct(), ["user_id"], "user_order")
    w = windows.number_windows(windows.chunk_windows(seq, T.info(spark, sf)).select("user_id", "window_index"), users)
    return w.select("user_id", *_big("window_index", "user_order", "precompute_id"))


_IDS = f"list_filter(list_transform(coalesce(interaction_sequence, []), lambda x: {S.clean('x.item_id')}), lambda y: y <> '')"
_CATS = f"list_filter(list_transform(coalesce(interaction_sequence, []), lambda x: {S.clean('x.item_category')}), lambda y: y <> '' AND lower(y) <> 'unknown')"


def _local(x: str) -> str:
    return f"coalesce(nullif(trim(replace(lower({S.clean(x)}), '_', ' ')), ''), 'unknown')"


@query(f"""WITH rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL),
e AS (SELECT precompute_id, {_local("mechanism")} AS m, {_local("scope")} AS s, {_local("direction")} AS d, {_IDS} AS ids, {_CATS} AS cats FROM rec),
f AS (SELECT *, len(ids) AS n, len(list_distinct(ids)) AS u, len(ids) >= 2 AND len(list_distinct(ids)) < len(ids) AS rep, len(ids) >= 2 AND len(list_distinct(ids)) = 1 AS same FROM e)
SELECT precompute_id,
CASE WHEN NOT rep AND m = 'repetition' THEN 'unknown' WHEN same AND m IN ('unknown', 'persistence') THEN 'repetition' ELSE m END AS mechanism,
CASE WHEN NOT rep AND s = 'same item' THEN 'mixed' WHEN same THEN 'same item' ELSE s END AS scope,
CASE WHEN NOT rep AND d = 'repeat' THEN 'unknown' WHEN same AND d IN ('unknown', 'stable') THEN 'repeat' ELSE d END AS direction,
concat_ws(';', CASE WHEN NOT rep AND m = 'repetition' THEN 'mechanism:repetition->unknown:no_exact_item_repeat' END, CASE WHEN NOT rep AND s = 'same item' THEN 'scope:same item->mixed:no_exact_item_repeat' END,
CASE WHEN NOT rep AND d = 'repeat' THEN 'direction:repeat->unknown:no_exact_item_repeat' END, CASE WHEN same AND m IN ('unknown', 'persistence') THEN 'mechanism:' || m || '->repetition:all_same_item' END,
CASE WHEN same AND s <> 'same item' THEN 'scope:' || s || '->same item:all_same_item' END, CASE WHEN same AND d IN ('unknown', 'stable') THEN 'direction:' || d || '->repeat:all_same_item' END) AS adjustments,
n::BIGINT AS num_items, u::BIGINT AS num_unique_item_ids, len(cats) >= 2 AND len(list_distinct(cats)) = 1 AS same_known_category FROM f""")
def window_guardrails(spark, sf):
    g = windows.guard_labels(T.records(spark, sf))
    e = "structural_evidence"
    return g.select("precompute_id", "mechanism", "scope", "direction", F.array_join("consistency_adjustments", ";").alias("adjustments"), F.col(f"{e}.num_items").cast("bigint").alias("num_items"), F.col(f"{e}.num_unique_item_ids").cast("bigint").alias("num_unique_item_ids"), F.col(f"{e}.same_known_category"))


# --- records -----------------------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT mechanism AS raw_mechanism, {S.profile("mechanism", "mechanism")} AS builder_mechanism, {S.profile("mechanism", "mechanism", "inference")} AS inference_mechanism,
scope AS raw_scope, {S.profile("scope", "scope")} AS builder_scope, {S.profile("scope", "scope", "inference")} AS inference_scope FROM local_memory""")
def normalize_labels(spark, sf):
    d = T.read(spark, sf, "local_memory")
    out = [F.col(k).alias(f"raw_{k}") for k in ("mechanism", "scope")]
    out += [text.profile_label(F.col(k), k, r).alias(f"{r}_{k}") for k in ("mechanism", "scope") for r in ("builder", "inference")]
    return d.select(*out).distinct()


@query(f"WITH {S.RECORDS} SELECT memory_id, 'mechanism=' || mech || '; scope=' || scp || '; direction=' || dir || '; trajectory=' || sign AS cluster_text FROM usable")
def cluster_texts(spark, sf):
    return T.usable(spark, sf).select("memory_id", "cluster_text")


@query(f"""WITH {S.RECORDS} SELECT precompute_id, CASE WHEN parse_ok = false THEN 'parse_failed' WHEN {S.clean("user_id")} = '' THEN 'missing_user' WHEN {S.clean("recommendation_behavior")} = '' OR sign = '' THEN 'missing_dual' END AS invalid_reason FROM norm""")
def memory_validity(spark, sf):
    return memories.usable_memories(T.records(spark, sf)).select("precompute_id", "invalid_reason")


@query("""SELECT precompute_id, 'schema_version' AS violation FROM local_memory WHERE schema_version IS DISTINCT FROM 'amem_local_memory_dual_behavior_v4' GROUP BY 1
UNION ALL SELECT precompute_id, 'missing ' || f FROM (SELECT precompute_id, unnest(list_filter([CASE WHEN precompute_id IS NULL THEN 'precompute_id' END, CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN window_index IS NULL THEN 'window_index' END,
CASE WHEN behavior_explanation IS NULL THEN 'behavior_explanation' END, CASE WHEN pattern_description IS NULL THEN 'pattern_description' END, CASE WHEN keywords IS NULL THEN 'keywords' END], lambda x: x IS NOT NULL)) AS f FROM local_memory) GROUP BY ALL""")
def contract_violations(spark, sf):
    return memories.contract_violations(T.read(spark, sf, "local_memory"))


@query(f"WITH {S.RECORDS}, c AS (SELECT mech AS value, count(*) AS n, min(precompute_id) AS first_seen FROM usable GROUP BY 1) SELECT value, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, first_seen, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM c")
def label_counts(spark, sf):
    from pyspark.sql.window import Window

    c = memories.label_counts(T.usable(spark, sf), "mechanism", "precompute_id")
    return c.select("value", "n", F.round("share", 6).alias("share"), "first_seen", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("bigint").alias("rank"))


@query("""WITH rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL)
SELECT precompute_id AS thought_id, coalesce(behavior_explanation, '') AS behavior_explanation, coalesce(pattern_description, '') AS pattern_description, coalesce(array_to_string(coalesce(keywords, []), '|'), '') AS keywords, user_id AS source_user_id, window_index::BIGINT AS source_window_index,
array_to_string(list_transform(coalesce(interaction_sequence, []), lambda x: coalesce(x.item_name, 'Unknown')), '|') AS item_names FROM rec""")
def records_to_memories(spark, sf):
    m = memories.to_memory(T.records(spark, sf))
    return m.select("thought_id", "behavior_explanation", "pattern_description", F.array_join("keywords", "|").alias("keywords"), "source_user_id", *_big("source_window_index"), F.array_join("interaction_sequence.item_name", "|").alias("item_names"))


_TEXT = "concat_ws(' ', behavior_explanation, pattern_description, array_to_string(list_filter(keywords, lambda x: x IS NOT NULL), ' '))"


@query(f"WITH g AS (SELECT DISTINCT ON (thought_id) * FROM global_memory WHERE thought_id IS NOT NULL) SELECT thought_id, {S.strip(_TEXT)} AS memory_text FROM g")
def memory_texts(spark, sf):
    g = T.read(spark, sf, "global_memory").filter("thought_id is not null").select("thought_id", "behavior_explanation", "pattern_description", "keywords").dropDuplicates(["thought_id"])
    return g.select("thought_id", text.memory_text(F.col("behavior_explanation"), F.col("pattern_description"), F.col("keywords")).alias("memory_text"))


@query("""WITH rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL)
SELECT precompute_id, json_extract_string(raw_response, '$.mechanism') AS mechanism, json_extract_string(raw_response, '$.behavior_explanation') AS behavior_explanation FROM rec WHERE raw_response IS NOT NULL AND json_valid(raw_response)""")
def parsed_responses(spark, sf):
    d = T.records(spark, sf).filter("raw_response is not null").withColumn("x", memories.parsed_response(F.col("raw_response"), "mechanism string, behavior_explanation string"))
    return d.filter("try_parse_json(raw_response) is not null").select("precompute_id", "x.mechanism", "x.behavior_explanation")


@query("""WITH rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL),
c AS (SELECT *, list_filter(list_transform(coalesce(interaction_sequence, []), lambda x: trim(coalesce(x.item_category, ''))), lambda y: y <> '') AS cats FROM rec),
d AS (SELECT *, list_filter(cats, lambda x, i: list_position(cats, x) = i) AS u FROM c)
SELECT precompute_id, CASE WHEN parse_ok = false THEN 'Interacted with items in: ' || CASE WHEN len(u) > 0 THEN array_to_string(u, ', ') ELSE 'unknown' END ELSE behavior_explanation END AS behavior_explanation,
CASE WHEN parse_ok = false THEN 'unknown' ELSE mechanism END AS mechanism, CASE WHEN parse_ok = false THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(confidence, 0.0))) END AS confidence FROM d""")
def fallback_records(spark, sf):
    return memories.fallback_record(T.records(spark, sf)).select("precompute_id", "behavior_explanation", "mechanism", "confidence")


@query(f"""WITH {S.RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY window_index DESC, precompute_id DESC) AS r FROM usable)
SELECT user_id, window_index::BIGINT AS window_index, mech AS mechanism, scp AS scope, dir AS direction, sign AS trajectory_signature FROM l WHERE r = 1""")
def latest_behaviors(spark, sf):
    d = memories.latest_behavior(T.usable(spark, sf))
    return d.select("user_id", *_big("window_index"), "mechanism", "scope", "direction", "trajectory_signature")


@query(f"""WITH {S.RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY window_index DESC, precompute_id DESC) AS r,
 array_to_string(list_filter(list_transform(coalesce(semantic_focus, keywords, []), lambda x: {S.clean("x")}), lambda y: y <> '')[1:12], ',') AS focus FROM usable)
SELECT user_id, string_agg(concat_ws(':', window_index::VARCHAR, {S.clean("recommendation_behavior")}, coalesce(focus, ''), sign, sign, mech, scp, dir, confidence IS NULL), ';' ORDER BY window_index, precompute_id) AS evidence FROM l WHERE r <= 3 GROUP BY 1""")
def recent_evidence(spark, sf):
    d = memories.recent_evidence(T.usable(spark, sf))
    said = lambda x: F.concat_ws(":", x["window_index"].cast("string"), x["recommendation_behavior"], F.array_join(x["semantic_focus"], ","), x["trajectory_signature"], x["behavior_signature"], x["mechanism"], x["scope"], x["direction"], x["confidence"].isNull().cast("string"))
    return d.select("user_id", F.array_join(F.transform("evidence", said), ";").alias("evidence"))


@query("""WITH g AS (SELECT thought_id, max(coalesce(evolution_count, 0)) AS n FROM global_memory WHERE thought_id IS NOT NULL GROUP BY 1)
SELECT thought_id, floor(greatest(0.2, 1.0 - n / 10.0 * 0.8) * 100 + 0.5) / 100 AS weight FROM g""")
def update_weights(spark, sf):
    g = T.read(spark, sf, "global_memory").filter("thought_id is not null").groupBy("thought_id").agg(F.max(F.coalesce("evolution_count", F.lit(0))).alias("n"))
    return g.select("thought_id", text.update_weight(F.col("n"), 10).alias("weight"))


# --- segments, contexts, tree ------------------------------------------------------------------------------------


@query(f"WITH {S.SEGMENTS} SELECT user_id, seg::BIGINT AS seg, pos::BIGINT AS pos, state_id, memory_id FROM segs")
def state_segments(spark, sf):
    return T.segs(spark, sf).select("user_id", *_big("seg", "pos"), "state_id", F.col("memory_ids")[0].alias("memory_id"))


@query(f"""WITH {S.SEGMENTS}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, seg, state_id ORDER BY pos) AS island FROM segs),
g AS (SELECT user_id, seg, state_id, min(pos) AS first, string_agg(memory_id, ',' ORDER BY pos) AS memory_ids FROM i GROUP BY user_id, seg, state_id, island)
SELECT user_id, seg::BIGINT AS seg, (row_number() OVER (PARTITION BY user_id, seg ORDER BY first) - 1)::BIGINT AS pos, state_id, memory_ids FROM g""")
def collapsed_segments(spark, sf):
    return T.segs(spark, sf, collapse=True).select("user_id", *_big("seg", "pos"), "state_id", F.array_join("memory_ids", ",").alias("memory_ids"))


_SUFFIX = """tail AS (SELECT *, sum(CASE WHEN coalesce(assignment_accepted, false) THEN 0 ELSE 1 END) OVER w AS bad, row_number() OVER w AS r FROM asg WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY window_index DESC, memory_id DESC))"""


@query(f"WITH {S.SEGMENTS}, {_SUFFIX} SELECT user_id, string_agg(state_id, '|' ORDER BY r DESC) AS suffix FROM tail WHERE bad = 0 AND r <= 5 GROUP BY 1")
def latest_suffixes(spark, sf):
    return segments.latest_suffix(T.assignments(spark, sf)).select("user_id", F.array_join("suffix", "|").alias("suffix"))


@query(f"""WITH {S.SEGMENTS}, t AS (SELECT state_id, lead(state_id) OVER (PARTITION BY user_id, seg ORDER BY pos) AS n FROM segs)
SELECT count(*) AS transitions, count_if(state_id = n)::BIGINT AS self_transitions, round(count_if(state_id = n)::DOUBLE / count(*), 6) AS self_ratio FROM t WHERE n IS NOT NULL""")
def self_transitions(spark, sf):
    return segments.transition_stats(T.segs(spark, sf)).select("transitions", *_big("self_transitions"), F.round("self_ratio", 6).alias("self_ratio"))


@query(f"WITH {S.CONTEXTS} SELECT ctx, target, sum(n)::BIGINT AS n, count(*) AS users FROM cnt GROUP BY ALL")
def context_counts(spark, sf):
    return T.counts(spark, sf).groupBy("ctx", "target").agg(F.sum("n").alias("n"), F.count("*").alias("users")).select(_ctx(), "target", "n", "users")


@query(f"WITH {S.CONTEXTS} SELECT ctx, target, round(weight, 6) AS user_normalized, occurrences::DOUBLE AS occurrence, users::DOUBLE AS distinct_user FROM w")
def context_weights(spark, sf):
    c = T.counts(spark, sf)
    w = contexts.weights(c).select("ctx", "target", F.round("weight", 6).alias("user_normalized"))
    for mode in ("occurrence", "distinct_user"):
        w = w.join(contexts.weights(c, mode).select("ctx", "target", F.col("weight").alias(mode)), ["ctx", "target"])
    return w.select(_ctx(), "target", "user_normalized", "occurrence", "distinct_user")


@query(f"""WITH {S.SMOOTHED}, o AS (SELECT ctx, target AS state_id, p, row_number() OVER (PARTITION BY ctx ORDER BY round(p, 12) DESC, target) AS rank FROM smooth)
SELECT ctx, rank::BIGINT AS rank, state_id, round(p, 6) AS probability FROM o WHERE rank <= 3""")
def smoothed_next(spark, sf):
    n = contexts.contexts(T.counts(spark, sf))
    return contexts.next_states(n, 3).select(_ctx(), *_big("rank"), "state_id", F.round("probability", 6).alias("probability"))


@query(f"""WITH {S.ACTIVE}, e AS (SELECT ctx, sum(CASE WHEN p > 1e-12 THEN -p * log2(p) ELSE 0 END) AS entropy FROM raw GROUP BY 1)
SELECT ctx, support_users::BIGINT AS support_users, support_occurrences::BIGINT AS support_occurrences, round(lam, 6) AS lambda, round(jsd, 6) AS jsd, round(entropy, 6) AS entropy, reason, active FROM node_act JOIN e USING (ctx)""")
def context_activation(spark, sf):
    d = T.nodes(spark, sf)
    return d.select(_ctx(), *_big("support_users", "support_occurrences"), F.round("lambda", 6).alias("lambda"), F.round("jsd", 6).alias("jsd"), F.round("entropy", 6).alias("entropy"), "reason", "active")


@query(f"""WITH RECURSIVE {S.ACTIVE}, chain AS (SELECT ctx, parent AS s, ord - 1 AS n FROM node_act WHERE ord > 0 UNION ALL SELECT ctx, regexp_replace(s, '^[^|]*([|]|$)', ''), n - 1 FROM chain WHERE n > 0),
best AS (SELECT c.ctx, c.s, row_number() OVER (PARTITION BY c.ctx ORDER BY c.n DESC) AS r FROM chain c JOIN node_act a ON a.ctx = c.s WHERE a.active)
SELECT ctx, s AS backoff FROM best WHERE r = 1""")
def active_backoff(spark, sf):
    return contexts.backoff(T.nodes(spark, sf)).select(_ctx(), F.array_join("backoff", "|").alias("backoff"))


def _sql_node(x: str, ord_: str) -> str:
    return f"CASE WHEN {ord_} = 0 THEN 'ROOT' ELSE 'CTX_' || {ord_} || '_' || substr(sha1({x}), 1, 12) END"


@query(f"WITH {S.CONTEXTS} SELECT {_sql_node('ctx', 'ord')} AS node_id, {_sql_node('parent', '(ord - 1)')} AS parent_id, split_part(ctx, '|', 1) AS token FROM node WHERE ord > 0")
def tree_edges(spark, sf):
    return contexts.tree_edges(T.counts(spark, sf).select("ctx").distinct())


@query("""SELECT DISTINCT node_id AS stored, CASE WHEN len(context_states) = 0 THEN 'ROOT' ELSE 'CTX_' || len(context_states) || '_' || substr(sha1(array_to_string(context_states, '|')), 1, 12) END AS computed FROM context_stats""")
def node_ids(spark, sf):
    return T.read(spark, sf, "context_stats").select(F.col("node_id").alias("stored"), contexts.node_id(F.col("context_states")).alias("computed")).distinct()


@query(f"""WITH {S.ACTIVE}, {_SUFFIX}, s AS (SELECT user_id, list(state_id ORDER BY r DESC) AS q FROM tail WHERE bad = 0 AND r <= {S.ORDERS} GROUP BY 1),
ends AS (SELECT user_id, len(q) AS n, k, CASE WHEN k = 0 THEN '' ELSE array_to_string(q[len(q) - k + 1 : len(q)], '|') END AS ctx FROM s, range(0, {S.ORDERS + 1}) t(k) WHERE k <= len(q)),
m AS (SELECT e.user_id, e.n, e.k, e.ctx, a.active FROM ends e JOIN node_act a USING (ctx)),
b AS (SELECT user_id, max(n) AS n, max(k) AS deepest, arg_max(ctx, k) AS matched, arg_max(ctx, k) FILTER (WHERE active) AS context FROM m GROUP BY 1),
o AS (SELECT ctx, target, p, row_number() OVER (PARTITION BY ctx ORDER BY round(p, 12) DESC, target) AS rank FROM smooth)
SELECT b.user_id, b.matched, b.context, CASE WHEN deepest = n THEN 'history_exhausted' ELSE 'missing_reverse_edge' END AS stop, o.target AS next_state, round(o.p, 6) AS probability FROM b JOIN o ON o.ctx = b.context AND o.rank = 1""")
def tree_query(spark, sf):
    q = contexts.query_tree(T.nodes(spark, sf), segments.latest_suffix(T.assignments(spark, sf)))
    return q.select("user_id", F.array_join("matched", "|").alias("matched"), F.array_join("context", "|").alias("context"), "stop", F.col("next")[0]["state_id"].alias("next_state"), F.col("next")[0]["probability"].alias("probability"))


@query("""WITH c AS (SELECT DISTINCT run_id, node_id, context_order, occurrence_counts FROM context_stats), e AS (SELECT run_id, node_id, context_order, unnest(map_entries(occurrence_counts)) AS x FROM c),
u AS (SELECT DISTINCT run_id, node_id, context_order, x.key AS state, x.value AS n FROM e WHERE x.value IS NOT NULL)
SELECT run_id::BIGINT AS run_id, node_id, count(*) AS next_states, sum(n)::BIGINT AS occurrences, round(-sum(CASE WHEN n > 0 THEN (n::DOUBLE / t) * log2(n::DOUBLE / t) ELSE 0 END), 6) AS entropy
FROM (SELECT *, sum(n) OVER (PARTITION BY run_id, node_id) AS t FROM u) GROUP BY run_id, node_id""")
def stored_context_entropy(spark, sf):
    e = T.read(spark, sf, "context_stats").select("run_id", "node_id", F.explode("occurrence_counts").alias("state", "n")).filter("n is not null").distinct()
    d = e.groupBy("run_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("m"), F.count("*").alias("next_states"), F.sum("n").alias("occurrences"))
    p = F.transform_values("m", lambda k, v: v / F.col("occurrences"))
    return d.select(*_big("run_id"), "node_id", "next_states", "occurrences", F.round(contexts.entropy_bits(p), 6).alias("entropy"))


# --- states ------------------------------------------------------------------------------------------------------

_MEMBERS = f"""{S.RECORDS}, {S.SEGMENTS}, mem AS (SELECT u.memory_id, u.user_id, a.state_id, a.cluster_similarity AS similarity, coalesce(a.assignment_accepted, false) AS ok, u.mech, u.scp, u.dir, u.precompute_id AS i, u.semantic_focus, u.keywords, u.behavior_explanation, u.sign
  FROM usable u JOIN asg a USING (memory_id))"""


@query(f"""WITH {_MEMBERS}, base AS (SELECT state_id, count(*) AS members, count_if(ok)::BIGINT AS accepted, count(DISTINCT user_id) AS users, round(avg(similarity), 4) AS mean_similarity, min(similarity) AS min_similarity, max(similarity) AS max_similarity FROM mem GROUP BY 1),
med AS (SELECT state_id, memory_id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY similarity DESC, i) AS r FROM mem) WHERE r = 1),
v AS (SELECT m.*, b.accepted FROM mem m JOIN base b USING (state_id) WHERE m.ok OR b.accepted = 0),
p AS (SELECT state_id, mech, scp, dir, count(*) AS votes, min(i) AS first, sum(count(*)) OVER (PARTITION BY state_id) AS voters FROM v GROUP BY state_id, mech, scp, dir),
t AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY votes DESC, first) AS r FROM p)
SELECT state_id, members, accepted, users, mean_similarity, min_similarity, max_similarity, medoid, mech AS mechanism, scp AS scope, dir AS direction, round(votes::DOUBLE / voters, 6) AS majority_share FROM base JOIN med USING (state_id) JOIN t USING (state_id) WHERE r = 1""")
def state_profiles(spark, sf):
    d = states.state_profiles(T.state_members(spark, sf))
    return d.withColumns({"mean_similarity": F.round("mean_similarity", 4), "majority_share": F.round("majority_share", 6)})


@query(f"""WITH {_MEMBERS}, x AS (SELECT state_id, i, unnest(keywords) AS term FROM mem), c AS (SELECT state_id, term, count(*) AS n, min(i) AS first FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY n DESC, first, term) AS rank FROM c) SELECT state_id, rank, term, n FROM r WHERE rank <= 12""")
def state_top_keywords(spark, sf):
    return states.top_terms(T.state_members(spark, sf), "keywords", 12).select("state_id", *_big("rank"), "term", "n")


@query(f"""WITH {_MEMBERS}, c AS (SELECT state_id, sign, min(i) AS first FROM mem WHERE sign IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY first, sign) AS r FROM c)
SELECT state_id, string_agg(sign, ' / ' ORDER BY r) AS texts FROM r WHERE r <= 8 GROUP BY 1""")
def state_first_texts(spark, sf):
    return states.first_texts(T.state_members(spark, sf), "trajectory_signature", 8).select("state_id", F.array_join("texts", " / ").alias("texts"))


@query(f"""WITH {S.SEGMENTS} SELECT count(*) AS assignments, round(avg(CASE WHEN assignment_accepted THEN 1.0 ELSE 0 END), 6) AS accepted_share, count_if(rejection_reason = 'low_similarity')::BIGINT AS low_similarity, count_if(rejection_reason = 'low_margin')::BIGINT AS low_margin,
round(quantile_cont(similarity_margin, 0.1), 6) AS margin_p10, round(quantile_cont(similarity_margin, 0.5), 6) AS margin_p50 FROM asg""")
def assignment_rollup(spark, sf):
    d = reports.assignment_rollup(T.assignments(spark, sf))
    return d.withColumns({c: F.round(c, 6) for c in ("accepted_share", "margin_p10", "margin_p50")})


@query(f"""WITH {S.SEGMENTS}, n AS (SELECT state_id, count(*) AS n FROM asg GROUP BY 1)
SELECT count(*) AS states, count_if(n = 1)::BIGINT AS singletons, max(n) AS largest, quantile_cont(n::DOUBLE, 0.5) AS median, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90 FROM n""")
def size_distribution(spark, sf):
    return reports.size_distribution(T.assignments(spark, sf)).withColumn("p90", F.round("p90", 6))


@query(f"""WITH {S.ACTIVE} SELECT ord::BIGINT AS context_order, count(*) AS contexts, count_if(active)::BIGINT AS active FROM node_act GROUP BY 1""")
def contexts_by_order(spark, sf):
    return reports.contexts_by_order(T.nodes(spark, sf)).select(*_big("context_order", "contexts", "active"))


# --- reports -----------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT ON (call_id) * FROM call_stat WHERE call_id IS NOT NULL ORDER BY call_id, call_type, input_tokens, output_tokens)
SELECT call_type, count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, round(sum(elapsed_sec), 4) AS seconds, round(avg(elapsed_sec), 6) AS mean_seconds, count_if(parse_ok = false)::BIGINT AS failed FROM c GROUP BY 1""")
def call_rollup(spark, sf):
    return reports.call_rollup(T.read(spark, sf, "call_stat").filter("call_id is not null")).withColumns({"seconds": F.round("seconds", 4), "mean_seconds": F.round("mean_seconds", 6)})


@query("""WITH g AS (SELECT thought_id, max(coalesce(evolution_count, 0)) AS n FROM global_memory WHERE thought_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS memories, count_if(n = 0)::BIGINT AS never, count_if(n = 1)::BIGINT AS once, count_if(n > 1)::BIGINT AS more, round(avg(n), 6) AS mean, max(n)::BIGINT AS most FROM g""")
def evolution_stats(spark, sf):
    return reports.evolution_stats(T.read(spark, sf, "global_memory").filter("thought_id is not null")).withColumns({"mean": F.round("mean", 6), "most": F.col("most").cast("bigint")})


@query(f"""WITH {S.RECORDS}, x AS (SELECT 'mechanism' AS field, mech AS value FROM usable UNION ALL SELECT 'scope', scp FROM usable UNION ALL SELECT 'direction', dir FROM usable
UNION ALL SELECT 'parse_ok', coalesce(parse_ok::VARCHAR, 'null') FROM usable
 UNION ALL SELECT 'focus', unnest(list_filter(list_transform(coalesce(semantic_focus, keywords, []), lambda x: {S.clean("x")}), lambda y: y <> '')[1:12]) FROM usable) SELECT field, value, count(*) AS n FROM x GROUP BY ALL""")
def behavior_summary(spark, sf):
    return reports.behavior_summary(T.usable(spark, sf))


# --- vectors -----------------------------------------------------------------------------------------------------

_DOT = "list_inner_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))"
_UNIT = "(SELECT list_transform(v, lambda x: x / n) FROM (SELECT list_transform({a}, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) AS n))"


def _vectors(spark, sf):
    d = T.read(spark, sf, "embeddings").filter("embedding is not null and label is not null")
    return d.withColumn("cluster_id", (F.col("label") * 2 + F.pmod("vec_id", F.lit(2))).cast("bigint"))


_CENTRES = f"""e AS (SELECT *, label * 2 + vec_id % 2 AS cluster_id FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
d AS (SELECT cluster_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM e), m AS (SELECT cluster_id, label, i, avg(x) AS x FROM d GROUP BY ALL),
cm AS (SELECT cluster_id, label, list(x ORDER BY i) AS v FROM m GROUP BY ALL), cen AS (SELECT cluster_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM cm)"""


def _states(spark, sf):
    d = _vectors(spark, sf)
    return vectors.centroids(d, "cluster_id", "embedding").withColumn("label", F.floor(F.col("cluster_id") / 2).cast("int"))


@query(f"WITH {_CENTRES} SELECT cluster_id::BIGINT AS cluster_id, i::BIGINT AS dim, round(x, 6) AS x FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM cen)")
def centroids(spark, sf):
    return _states(spark, sf).select("cluster_id", F.posexplode("centroid").alias("p", "x")).select("cluster_id", (F.col("p") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


@query(f"""WITH q AS (SELECT vec_id, {_UNIT.format(a="embedding")} AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id, {_UNIT.format(a="embedding")} AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, b.vec_id AS id, round(list_inner_product(q.v, b.v), 9) AS cosine FROM q JOIN b ON q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s) SELECT query, id, rank::BIGINT AS rank, round(cosine, 6) AS cosine FROM r WHERE rank <= 5""")
def cosine_top_k(spark, sf):
    d = T.read(spark, sf, "embeddings")
    return vectors.exact_top_k(d.filter("vec_id % 50 = 0"), d, 5).select("query", "id", *_big("rank"), F.round("cosine", 6).alias("cosine"))


_DIAG = f"""{_CENTRES}, u AS (SELECT vec_id, label, cluster_id, {_UNIT.format(a="embedding")} AS v FROM e),
s AS (SELECT u.vec_id, u.label, u.cluster_id AS own, c.cluster_id, c.label AS cl, list_inner_product(u.v, c.v) AS sim FROM u CROSS JOIN cen c),
a AS (SELECT vec_id, own AS cluster_id, max(CASE WHEN cluster_id = own THEN sim END) AS similarity, max(CASE WHEN cluster_id <> own AND cl = label THEN sim END) AS best_other, max(sim) AS global_top1 FROM s GROUP BY vec_id, own),
g AS (SELECT *, similarity - best_other AS margin FROM a)"""


@query(f"""WITH {_DIAG} SELECT vec_id, cluster_id::BIGINT AS cluster_id, round(similarity, 6) AS similarity, round(best_other, 6) AS best_other, round(margin, 6) AS margin, round(global_top1, 6) AS global_top1,
NOT similarity < 0.15 AND NOT coalesce(margin < 0.02, false) AS accepted, CASE WHEN similarity < 0.15 THEN 'low_similarity' WHEN margin < 0.02 THEN 'low_margin' END AS reason FROM g""")
def assignment_margin(spark, sf):
    d = vectors.assignment_diagnostics(_vectors(spark, sf), _states(spark, sf), "vec_id", "label", "embedding", min_similarity=0.15)
    return d.select("vec_id", "cluster_id", *[F.round(c, 6).alias(c) for c in ("similarity", "best_other", "margin", "global_top1")], "accepted", "reason")


@query(f"""WITH {_CENTRES}, st AS (SELECT * FROM cen WHERE label < 8), u AS (SELECT vec_id, label, {_UNIT.format(a="embedding")} AS v FROM e),
f AS (SELECT u.*, NOT EXISTS (SELECT 1 FROM st WHERE st.label = u.label) AS fallback FROM u),
s AS (SELECT f.vec_id, f.fallback, st.cluster_id, round(list_inner_product(f.v, st.v), 12) AS sim FROM f JOIN st ON f.fallback OR st.label = f.label),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster_id) AS r FROM s),
b AS (SELECT vec_id, fallback, max(CASE WHEN r = 1 THEN cluster_id END) AS cluster_id, max(CASE WHEN r = 1 THEN sim END) AS similarity, max(CASE WHEN r = 1 THEN sim END) - max(CASE WHEN r = 2 THEN sim END) AS margin FROM o GROUP BY ALL),
w AS (SELECT *, concat_ws('+', CASE WHEN fallback THEN 'missing_compatible_mechanism_bucket' END, CASE WHEN similarity < 0.15 THEN 'low_similarity' END, CASE WHEN margin < 0.02 THEN 'low_margin' END) AS reason FROM b)
SELECT vec_id, cluster_id::BIGINT AS cluster_id, round(similarity, 6) AS similarity, round(margin, 6) AS margin, fallback, reason, reason = '' AS accepted FROM w""")
def mapped_behaviors(spark, sf):
    d = vectors.map_to_states(_vectors(spark, sf), _states(spark, sf).filter("label < 8"), "vec_id", "label", "embedding", min_similarity=0.15)
    return d.select("vec_id", "cluster_id", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"), "fallback", "reason", "accepted")


@query("""WITH s AS (SELECT label AS bucket, count(*) AS n FROM embeddings GROUP BY 1), j AS (SELECT bucket, n, unnest(range(1, n)) AS j FROM s),
t AS (SELECT bucket FROM j ORDER BY n::DOUBLE / j DESC, n DESC, bucket DESC LIMIT 40) SELECT s.bucket::BIGINT AS bucket, s.n, 1 + count(t.bucket) AS clusters FROM s LEFT JOIN t USING (bucket) GROUP BY ALL""")
def cluster_allocation(spark, sf):
    sizes = T.read(spark, sf, "embeddings").groupBy(F.col("label").alias("bucket")).agg(F.count("*").alias("n"))
    return vectors.allocate(sizes, 50).select(*_big("bucket", "n", "clusters"))


@query()
def bucketed_kmeans(spark, sf):
    labels, st = vectors.bucketed_kmeans(_vectors(spark, sf), 50, "vec_id", "label", "embedding")
    return labels.join(st.select("cluster_id", F.col("label").alias("owner")), "cluster_id").select("vec_id", "label", "cluster_id", (F.col("label") == F.col("owner")).alias("in_own_bucket"))


@query("""WITH e AS (SELECT label AS c, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT c, i, avg(x) AS m, count(*) AS n FROM d GROUP BY ALL), g AS (SELECT i, sum(m * n) / sum(n) AS g FROM m GROUP BY i), btw AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM m JOIN g USING (i)),
cm AS (SELECT c, list(m ORDER BY i) AS m FROM m GROUP BY c), d2 AS (SELECT e.c, list_sum(list_transform(list_zip(e.v, cm.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e JOIN cm USING (c)),
s AS (SELECT c, sum(d2) AS ss, avg(sqrt(d2)) AS s, count(*) AS n FROM d2 GROUP BY c), p AS (SELECT a.c, max((a.s + b.s) / sqrt(list_sum(list_transform(list_zip(ma.m, mb.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS r
FROM s a JOIN s b ON a.c <> b.c JOIN cm ma ON ma.c = a.c JOIN cm mb ON mb.c = b.c GROUP BY a.c)
SELECT (SELECT count(*) FROM s) AS clusters, round((SELECT sum(ss) FROM s), 6) AS inertia, round(((SELECT b FROM btw) / ((SELECT count(*) FROM s) - 1)) / ((SELECT sum(ss) FROM s) / ((SELECT sum(n) FROM s) - (SELECT count(*) FROM s))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM p), 6) AS davies_bouldin""")
def cluster_quality(spark, sf):
    return vectors.cluster_quality(_vectors(spark, sf)).select("clusters", *[F.round(c, 6).alias(c) for c in ("inertia", "calinski_harabasz", "davies_bouldin")])


#: English function words the term weights leave out: fixed values
STOP_WORDS = ["the", "and", "of", "to", "in", "for", "is", "on", "that", "by", "this", "with", "it", "be", "as", "an", "are", "or", "at", "from"]


@query(f"""WITH rec AS (SELECT DISTINCT ON (precompute_id) precompute_id, pattern_description AS t FROM local_memory WHERE precompute_id IS NOT NULL),
w AS (SELECT precompute_id, list_filter(regexp_extract_all(lower(coalesce(t, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS w FROM rec),
t AS (SELECT precompute_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT precompute_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 8000),
x AS (SELECT tf.*, v.df, tf * (ln((1 + (SELECT count(*) FROM rec)) / (1 + v.df)) + 1) AS raw FROM tf JOIN v USING (term)), n AS (SELECT precompute_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY 1)
SELECT precompute_id, term, tf, df, round(raw / norm, 6) AS weight FROM x JOIN n USING (precompute_id)""")
def tfidf(spark, sf):
    d = vectors.tfidf(T.records(spark, sf), "precompute_id", "pattern_description", STOP_WORDS)
    return d.withColumn("weight", F.round("weight", 6))


# --- flat memory -------------------------------------------------------------------------------------------------


@query(f"""WITH q AS (SELECT vec_id, {_UNIT.format(a="embedding")} AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id, {_UNIT.format(a="embedding")} AS v FROM embeddings), n AS (SELECT count(*) AS n FROM b),
s AS (SELECT q.vec_id AS query, b.vec_id AS id, round(list_inner_product(q.v, b.v), 9) AS c FROM q JOIN b ON q.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS r FROM s),
k AS (SELECT query, max(c) AS top, avg(CASE WHEN c >= 0.6 - 0.05 * least(n / 1000.0, 1) THEN 1.0 ELSE 0 END) AS hi, avg(CASE WHEN c < 0.3 + 0.05 * least(n / 1000.0, 1) THEN 1.0 ELSE 0 END) AS lo, count_if(c >= 0.3 + 0.05 * least(n / 1000.0, 1)) AS e, any_value(n) AS n FROM r, n WHERE r <= 5 GROUP BY 1)
SELECT query, CASE WHEN top < 0.3 + 0.05 * least(n / 1000.0, 1) THEN 'all_low:store' WHEN top < 0.6 - 0.05 * least(n / 1000.0, 1) THEN 'medium:update+store' WHEN hi >= 0.6 THEN 'high_majority:update' WHEN lo >= 0.5 THEN 'low_majority:store'
WHEN hi >= 0.4 THEN 'high_share:update+store' ELSE 'mixed:update+store' END AS zone, e::BIGINT AS eligible FROM k""")
def strategy_zones(spark, sf):
    d = T.read(spark, sf, "embeddings")
    near = vectors.exact_top_k(d.filter("vec_id % 50 = 0"), d, 5)
    z = pool.strategy_zones(near, d.count(), pool.PoolConfig(low=0.3, high=0.6))
    return z.select("query", "zone", F.size("eligible").cast("bigint").alias("eligible"))


@query(f"""WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id AS id, {_UNIT.format(a="embedding")} AS v FROM embeddings WHERE embedding IS NOT NULL),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS id, '' AS kind, false AS stored, []::BIGINT[] AS links, []::BIGINT[] AS updated, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs, []::BIGINT[] AS ev
UNION ALL SELECT i, id, kind, stored, list_transform(links, lambda k: ids[k]), list_transform(updated, lambda k: ids[k]), CASE WHEN stored THEN list_append(ids, id) ELSE ids END, CASE WHEN stored THEN list_append(vs, v) ELSE vs END,
  CASE WHEN stored THEN list_append(list_transform(ev, lambda e, k: e + list_contains(updated, k)::BIGINT), 0) ELSE list_transform(ev, lambda e, k: e + list_contains(updated, k)::BIGINT) END
FROM (SELECT *, contains(kind, 'store') OR (len(links) > 0 AND len(updated) = 0) AS stored FROM (SELECT *, list_filter(links, lambda k: ev[k] < 10) AS updated FROM
 (SELECT *, CASE WHEN contains(kind, 'update') THEN list_filter(near, lambda k: sims[k] >= low) ELSE [] END AS links FROM
 (SELECT *, CASE WHEN len(top) = 0 THEN 'no_memories:store' WHEN list_max(top) < low THEN 'all_low:store' WHEN list_max(top) < high THEN 'medium:update+store' WHEN len(list_filter(top, lambda s: s >= high)) >= 0.6 * len(top) THEN 'high_majority:update'
  WHEN len(list_filter(top, lambda s: s < low)) >= 0.5 * len(top) THEN 'low_majority:store' WHEN len(list_filter(top, lambda s: s >= high)) >= 0.4 * len(top) THEN 'high_share:update+store' ELSE 'mixed:update+store' END AS kind FROM
 (SELECT *, list_transform(near, lambda k: sims[k]) AS top FROM
 (SELECT *, list_transform(list_sort(list_transform(range(1, len(sims) + 1), lambda k: {{'s': -round(sims[k], 9), 'k': k}}))[1:5], lambda z: z.k) AS near FROM
 (SELECT m.i, m.id, m.v, f.ids, f.vs, f.ev, list_transform(f.vs, lambda x: list_inner_product(x, m.v)) AS sims, 0.3 + 0.05 * least(len(f.ids) / 1000.0, 1) AS low, 0.6 - 0.05 * least(len(f.ids) / 1000.0, 1) AS high FROM f JOIN m ON m.i = f.i + 1))))))))
SELECT id AS thought_id, kind AS zone, stored, coalesce(array_to_string(links, ','), '') AS links, coalesce(array_to_string(updated, ','), '') AS updated FROM f WHERE i > 0""")
def memory_fold(spark, sf):
    f = pool.fold(T.read(spark, sf, "embeddings"), pool.PoolConfig(low=0.3, high=0.6), "vec_id")
    return f.select("thought_id", "zone", "stored", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("links", "updated")])


def _usable(spark, sf):
    """Each memory once, with 64 finite numbers, not all zero."""
    d = T.read(spark, sf, "global_memory").filter("thought_id is not null and size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    one = d.groupBy("thought_id").agg(F.min(F.struct("embedding", "source_user_id")).alias("m"))
    return one.select("thought_id", "m.embedding", F.coalesce("m.source_user_id", F.lit("")).alias("user_id"))


@query()
def memory_fold_by_user(spark, sf):
    """A pool for every user: as many tasks as there are users."""
    f = pool.fold(_usable(spark, sf), shard="user_id")
    return f.select("shard", "thought_id", "zone", "stored", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("links", "updated")])


@query()
def pool_after_fold(spark, sf):
    d = _usable(spark, sf)
    f = keep(pool.fold(d, shard="user_id"), "folded")
    return pool.pool_after(d, f, shard="user_id").select("thought_id", "user_id", "evolution_count", F.size("links").alias("links"))


# --- candidates, rankings ----------------------------------------------------------------------------------------


def _candidates(spark, sf):
    h = keep(T.histories(spark, sf), "histories")
    return prep.leave_two_out(h), ranking.candidate_lists(prep.leave_two_out(h), prep.popularity_negatives(h, splits=("test",)))


@query()
def candidate_lists(spark, sf):
    return _candidates(spark, sf)[1].select("user_id", "target", F.array_join("candidates", ",").alias("candidates"))


@query(f"""{_NEG.replace("SELECT user_id, split, slot::BIGINT AS slot, item_id FROM slots WHERE slot <= 19", "")}, tgt AS (SELECT user_id, item_id FROM seqs WHERE split = 'test'), every AS (SELECT user_id, item_id::VARCHAR AS i FROM tgt UNION ALL SELECT user_id, item_id::VARCHAR FROM slots WHERE slot <= 19 AND split = 'test')
SELECT user_id, any_value(tgt.item_id)::VARCHAR AS target, count(*) AS size, string_agg(i, ',' ORDER BY i) AS members FROM every JOIN tgt USING (user_id) GROUP BY user_id""")
def candidate_members(spark, sf):
    """The candidate lists as sets: their order comes from Python's generator."""
    c = _candidates(spark, sf)[1]
    return c.select("user_id", "target", F.size("candidates").cast("bigint").alias("size"), F.array_join(F.array_sort("candidates"), ",").alias("members"))


@query(f"""WITH {S.HISTORIES}, u AS (SELECT DISTINCT user_id, user_id % 5 AS k FROM hist) SELECT user_id, CASE k WHEN 0 THEN 19 ELSE 21 END::BIGINT AS size, CASE k WHEN 0 THEN 19 WHEN 1 THEN 20 ELSE 21 END::BIGINT AS unique_size, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS targets FROM u WHERE k < 3""")
def candidate_violations(spark, sf):
    """Three users in five get a broken list: without the target, with it twice, with one item too many."""
    c, k = _candidates(spark, sf)[1], F.col("user_id") % 5
    target = F.array("target")
    broken = F.when(k == 0, F.array_except("candidates", target)).when(k == 1, F.concat("candidates", target)).when(k == 2, F.concat("candidates", F.array(F.lit("one more")))).otherwise(F.col("candidates"))
    return ranking.candidate_violations(c.withColumn("candidates", broken)).select("user_id", *_big("size", "unique_size", "targets"))


@query(f"WITH {S.HISTORIES} SELECT DISTINCT user_id, 20::BIGINT AS size FROM hist")
def candidate_cache_filled(spark, sf):
    c = keep(_candidates(spark, sf)[1], "candidates").select("user_id", "candidates")
    return ranking.candidate_cache(c.filter("user_id % 2 = 0"), c).select("user_id", F.size("candidates").cast("bigint").alias("size"))


_LAST = f"""WITH {S.HISTORIES}, t AS (SELECT user_id, list(item_id::VARCHAR ORDER BY pos) AS train FROM seqs WHERE split = 'train' GROUP BY 1), c AS (SELECT user_id, train, train[greatest(len(train) - 4, 1) : len(train)] AS last5 FROM t)"""


@query(f"{_LAST} SELECT user_id, sha256('[\"' || array_to_string(last5, '\",\"') || '\"]') AS hash FROM c")
def history_hashes(spark, sf):
    return prep.last_n(T.sequences(spark, sf), 5).select("user_id", ranking.history_hash(F.col("items").cast("array<string>")).alias("hash"))


@query(f"""{_LAST}, x AS (SELECT user_id, last5, CASE WHEN user_id % 2 = 0 THEN last5 ELSE list_concat(last5[1:3], ['x'], last5[5:5]) END AS cached FROM c)
SELECT user_id, cached = last5 AS same, CASE WHEN cached <> last5 THEN 4 END::BIGINT AS first_difference FROM x""")
def history_identity(spark, sf):
    train = prep.last_n(T.sequences(spark, sf), 5).select("user_id", F.col("items").cast("array<string>").alias("train"))
    changed = F.concat(F.slice("train", 1, 3), F.array(F.lit("x")), F.slice("train", 5, 1))
    cache = train.select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("train")).otherwise(changed).alias("cached"))
    return ranking.history_identity(cache, train).select("user_id", "same", *_big("first_difference"))


_PRED = f"""{_LAST}, p AS (SELECT user_id, last5 AS cand, list_concat([last5[5], last5[2], last5[5], 'zz'], []) AS pred FROM c)"""


@query(f"""{_PRED} SELECT user_id, array_to_string(list_concat(list_filter(pred, lambda x, i: list_contains(cand, x) AND list_position(pred, x) = i), list_filter(cand, lambda x: NOT list_contains(pred, x))), ',') AS ranking,
len(list_filter(cand, lambda x: NOT list_contains(pred, x))) = 0 AS complete FROM p""")
def sanitized_rankings(spark, sf):
    c = prep.last_n(T.sequences(spark, sf), 5).select("user_id", F.col("items").cast("array<string>").alias("cand"))
    pred = F.array(F.col("cand")[4], F.col("cand")[1], F.col("cand")[4], F.lit("zz"))
    return c.select("user_id", F.array_join(ranking.sanitize(pred, F.col("cand")), ",").alias("ranking"), ranking.complete(pred, F.col("cand")).alias("complete"))


_ANSWERS = [(1, "C02, c 1, C03"), (2, "\n [C03, C3, C99, c01] because"), (3, None), (4, "none"), (5, "C01,C02,C03\nC04")]


@query("""SELECT * FROM (VALUES (1, '2,1,3', true, 'complete'), (2, '3,1,2', false, 'repaired_out_of_range_and_duplicate_and_missing'), (3, '1,2,3', false, 'repaired_missing'), (4, '1,2,3', false, 'repaired_missing'), (5, '1,2,3', true, 'complete')) t(answer, positions, complete, reason)""")
def parsed_labels(spark, sf):
    d = spark.createDataFrame(_ANSWERS, "answer int, text string").withColumn("p", ranking.parse_labels(F.col("text"), F.lit(3)))
    return d.select("answer", F.array_join(F.col("p.positions").cast("array<string>"), ",").alias("positions"), "p.complete", "p.reason")


_RANKS = f"""WITH {S.HISTORIES}, pop AS (SELECT item_id, count(*) AS pop FROM seqs WHERE split = 'train' GROUP BY 1), tgt AS (SELECT user_id, item_id FROM seqs WHERE split = 'test'),
cand AS (SELECT s.user_id, s.item_id, s.pos, s.split = 'test' AS is_target FROM seqs s JOIN lengths l USING (user_id) WHERE s.pos >= l.n_items - 10),
sc AS (SELECT c.*, coalesce(p.pop, 0) AS score FROM cand c LEFT JOIN pop p USING (item_id)),
rk AS (SELECT user_id, is_target, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS popular, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS recent FROM sc),
ranks AS (SELECT 'popularity' AS mode, user_id, popular AS rank FROM rk WHERE is_target UNION ALL SELECT 'oldest', user_id, 11 - recent FROM rk WHERE is_target)"""


def _ranks(spark, sf):
    """The last ten items of a user as candidates, ranked by training popularity and by age."""
    from pyspark.sql.window import Window

    h = T.histories(spark, sf)
    seq = prep.leave_two_out(h).join(h.select("user_id", "n_items").distinct(), "user_id").filter("pos >= n_items - 10")
    pop = prep.popularity(T.sequences(spark, sf).filter("split = 'train'")).withColumnRenamed("users", "score")
    s = seq.join(pop, "item_id", "left").select("user_id", "item_id", F.col("pos").alias("cand_pos"), F.col("score").cast("double").alias("score"), (F.col("split") == "test").alias("is_target"))
    best = ranking.order_by_score(s).join(s.filter("is_target").select("user_id", "item_id"), ["user_id", "item_id"])
    old = s.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("cand_pos"))).filter("is_target")
    return best.select(F.lit("popularity").alias("mode"), "user_id", "rank").unionByName(old.select(F.lit("oldest").alias("mode"), "user_id", "rank"))


@query(f"{_RANKS} SELECT mode, user_id, rank::BIGINT AS rank FROM ranks")
def target_ranks(spark, sf):
    return _ranks(spark, sf).select("mode", "user_id", *_big("rank"))


def _metric_sql(mode: str) -> str:
    one = [f"SELECT '{mode}' AS mode, '{m}@{k}' AS metric, {x} AS value FROM ranks WHERE mode = '{mode}'" for k in (1, 3, 5, 10, 15, 20) for m, x in (("Hit", f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)"), ("NDCG", f"avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END)"))]
    one += [f"SELECT '{mode}', '{m}', {x} FROM ranks WHERE mode = '{mode}'" for m, x in (("MRR", "avg(1.0 / rank)"), ("MeanRank", "avg(rank)"), ("MedianRank", "quantile_cont(rank::DOUBLE, 0.5)"), ("NumUsers", "count(*)::DOUBLE"))]
    return " UNION ALL ".join(one)


@query(f"{_RANKS}, m AS ({_metric_sql('popularity')} UNION ALL {_metric_sql('oldest')}) SELECT mode, metric, round(value, 6) AS value FROM m")
def ranking_metrics(spark, sf):
    return ranking.rank_metrics(_ranks(spark, sf)).select("mode", "metric", F.round("value", 6).alias("value"))


@query(f"{_RANKS}, a AS ({_metric_sql('popularity')}), b AS ({_metric_sql('oldest')}) SELECT a.metric, round(CASE WHEN a.metric IN ('MeanRank', 'MedianRank') THEN -1 ELSE 1 END * (a.value - b.value), 6) AS gain FROM a JOIN b USING (metric)")
def metric_gains(spark, sf):
    m = keep(ranking.rank_metrics(_ranks(spark, sf)), "metrics")
    return ranking.metric_gains(m, "popularity", "oldest").select("metric", F.round("gain", 6).alias("gain"))


@query(f"""WITH {S.HISTORIES}, truth AS (SELECT user_id, list(item_id) AS truth FROM seqs WHERE split <> 'train' GROUP BY 1), pred AS (SELECT user_id, list(item_id ORDER BY pos DESC) AS pred FROM (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM seqs s WHERE pos % 2 = 0) WHERE r <= 10 GROUP BY 1),
h AS (SELECT user_id, len(truth) AS n, list_transform(pred, lambda x: list_contains(truth, x)::INT) AS hit FROM truth JOIN pred USING (user_id)),
k AS (SELECT user_id, n, k, hit[1:k] AS top, list_reverse_sort(hit)[1:k] AS ideal FROM h, (VALUES (1), (3), (5), (10)) t(k)),
g AS (SELECT k, n, list_sum(top) AS hits, list_sum(list_transform(top, lambda x, i: x / log2(i + 1))) AS dcg, list_sum(list_transform(ideal, lambda x, i: x / log2(i + 1))) AS idcg FROM k)
SELECT k::BIGINT AS k, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, round(avg(hits / n), 6) AS recall, count(*) AS users FROM g GROUP BY k""")
def list_metrics(spark, sf):
    from pyspark.sql.window import Window

    s = T.sequences(spark, sf)
    truth = s.filter("split <> 'train'").groupBy("user_id").agg(F.collect_list("item_id").alias("truth"))
    w = Window.partitionBy("user_id").orderBy(F.desc("pos"))
    top = s.filter("pos % 2 = 0").withColumn("r", F.row_number().over(w)).filter("r <= 10")
    pred = top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item_id"))), lambda x: x["item_id"]).alias("predicted"))
    m = ranking.list_metrics(truth.join(pred, "user_id"))
    return m.select(*_big("k"), F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"), "users")


# --- baselines ---------------------------------------------------------------------------------------------------

_ADJ = f"""WITH {S.HISTORIES}, e AS (SELECT user_id, item_id FROM seqs WHERE split = 'train'), du AS (SELECT user_id, count(*) AS du FROM e GROUP BY 1), di AS (SELECT item_id, count(*) AS di FROM e GROUP BY 1),
adj AS (SELECT user_id, item_id, 1 / sqrt(du * di) AS weight FROM e JOIN du USING (user_id) JOIN di USING (item_id))"""


@query(f"{_ADJ} SELECT user_id, item_id, round(weight, 6) AS weight FROM adj")
def adjacency(spark, sf):
    return baselines.adjacency(T.sequences(spark, sf).filter("split = 'train'")).withColumn("weight", F.round("weight", 6))


def _layer_sql(k: int) -> str:
    return f"""u{k} AS (SELECT user_id, d, sum(weight * x) AS x FROM adj JOIN i{k - 1} USING (item_id) GROUP BY ALL), i{k} AS (SELECT item_id, d, sum(weight * x) AS x FROM adj JOIN u{k - 1} USING (user_id) GROUP BY ALL)"""


@query(f"""{_ADJ}, u0 AS (SELECT *, ((user_id % 97) * (d + 3) % 101) / 101.0 AS x FROM (SELECT DISTINCT user_id FROM e), range(64) t(d)), i0 AS (SELECT *, ((item_id % 89) * (d + 5) % 103) / 103.0 AS x FROM (SELECT DISTINCT item_id FROM e), range(64) t(d)),
{", ".join(_layer_sql(k) for k in (1, 2, 3))}
SELECT user_id, d::BIGINT AS dim, round((u0.x + u1.x + u2.x + u3.x) / 4, 6) AS x FROM u0 JOIN u1 USING (user_id, d) JOIN u2 USING (user_id, d) JOIN u3 USING (user_id, d)""")
def graph_propagation(spark, sf):
    e = T.sequences(spark, sf).filter("split = 'train'").select("user_id", "item_id")
    start = lambda c, a, b: F.expr(f"transform(sequence(0, 63), d -> (({c} % {a}) * (d + {3 if a == 97 else 5}) % {b}) / {b}.0D)")
    u = e.select("user_id").distinct().withColumn("v", start("user_id", 97, 101))
    i = e.select("item_id").distinct().withColumn("v", start("item_id", 89, 103))
    out = baselines.propagate(baselines.adjacency(e), u, i, 3)[0]
    return out.select("user_id", F.posexplode("v").alias("dim", "x")).select("user_id", *_big("dim"), F.round("x", 6).alias("x"))


@query(f"""WITH {S.HISTORIES}, t AS (SELECT item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY pos) AS next_item FROM seqs WHERE split = 'train'), c AS (SELECT item_id, next_item, count(*) AS n FROM t WHERE next_item IS NOT NULL GROUP BY ALL)
SELECT item_id, next_item, round(n::DOUBLE / sum(n) OVER (PARTITION BY item_id), 6) AS score FROM c""")
def markov_scores(spark, sf):
    return baselines.markov_scores(T.sequences(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {S.HISTORIES}, seen AS (SELECT DISTINCT item_id FROM seqs WHERE split = 'train'), c AS (SELECT s.user_id, s.item_id, s.split = 'test' AS t FROM seqs s WHERE split <> 'train')
SELECT count(*) AS candidates, count_if(seen.item_id IS NULL)::BIGINT AS unseen_candidates, count_if(t)::BIGINT AS targets, count_if(t AND seen.item_id IS NULL)::BIGINT AS unseen_targets FROM c LEFT JOIN seen USING (item_id)""")
def cold_start(spark, sf):
    s = T.sequences(spark, sf)
    seen = s.filter("split = 'train'").select("item_id").distinct().withColumn("seen_in_train", F.lit(True))
    held = s.filter("split <> 'train'").groupBy("user_id").agg(F.max(F.when(F.col("split") == "test", F.col("item_id"))).cast("string").alias("target"), F.collect_list(F.col("item_id").cast("string")).alias("candidates"))
    return baselines.cold_start(held, seen)


@query()
def cloze_rows(spark, sf):
    return baselines.cloze_rows(T.sequences(spark, sf))


@query()
def als_factors(spark, sf):
    u, _ = baselines.als_factors(T.sequences(spark, sf).filter("split = 'train'"))
    return u.select(F.col("id").alias("user_id"), F.size("features").alias("dims"))


@query(f"""WITH {_CHUNKS}, x AS (SELECT user_id, window_index, string_split(items, ',') AS ids FROM chunk), y AS (SELECT x.user_id, x.window_index, list(i.item_category ORDER BY k) AS cats, list(i.item_id ORDER BY k) AS ids FROM (SELECT *, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM x) x JOIN info i ON i.item_id = x.id GROUP BY ALL)
SELECT user_id, window_index::BIGINT AS window_index, CASE WHEN len(ids) >= 2 AND len(list_distinct(ids)) = 1 THEN 'repetition' WHEN len(list_filter(cats, lambda z: lower(z) <> 'unknown')) >= 2 AND len(list_distinct(list_filter(cats, lambda z: lower(z) <> 'unknown'))) = 1 THEN 'persistence'
WHEN len(cats) > 2 AND cats[1] = cats[-1] AND len(list_distinct(cats)) > 1 THEN 'returning' WHEN len(cats) > 1 THEN 'shifting' ELSE 'unknown' END AS mechanism FROM y""")
def rule_behaviors(spark, sf):
    w = windows.chunk_windows(T.sequences(spark, sf), T.info(spark, sf))
    return providers.rule_behavior(w).select("user_id", *_big("window_index"), "mechanism")


@query(f"""WITH {_CHUNKS}, x AS (SELECT c.user_id, c.window_index, unnest(string_split(c.items, ',')) AS id, generate_subscripts(string_split(c.items, ','), 1) AS k FROM chunk c)
SELECT user_id, window_index::BIGINT AS window_index, 'Items of one user in order:' || chr(10) || string_agg(k || '. ' || item_name || ' [' || item_category || '] purchase', chr(10) ORDER BY k) || chr(10) || 'Describe how the preference moves, as JSON with mechanism, scope, direction and a short text.' AS prompt
FROM x JOIN info ON info.item_id = x.id GROUP BY ALL""")
def extraction_prompts(spark, sf):
    w = windows.chunk_windows(T.sequences(spark, sf), T.info(spark, sf))
    return w.select("user_id", *_big("window_index"), providers.extraction_prompt(F.col("interaction_sequence")).alias("prompt"))


@query(f"""WITH {S.HISTORIES}, h AS (SELECT user_id, count(*) AS n FROM seqs WHERE split = 'train' GROUP BY 1) SELECT count(*) AS users, min(n)::BIGINT AS min_history, max(n)::BIGINT AS max_history, (SELECT count(*) FROM seqs a JOIN seqs b USING (user_id) WHERE user_id % 3 = 0 AND a.split = 'test' AND b.split = 'train' AND b.pos = a.pos - 2)::BIGINT AS targets_in_history FROM h""")
def protocol_summary(spark, sf):
    s = T.sequences(spark, sf).withColumn("item_id", F.col("item_id").cast("string"))
    h = s.filter("split = 'train'").groupBy("user_id").agg(F.collect_list("item_id").alias("train"))
    # a third of the users are given their last training item as target, which must be noticed
    late = s.groupBy("user_id").agg(F.max("pos").alias("last"))
    target = s.join(late, "user_id").filter(F.col("pos") == F.col("last") - F.when(F.col("user_id") % 3 == 0, 2).otherwise(0)).select("user_id", F.col("item_id").alias("target"))
    return reports.protocol_summary(h, target).select(*_big("users", "min_history", "max_history", "targets_in_history"))


@query(f"""{_RANKS}, p AS (SELECT a.user_id, a.rank, 11 - b.rank AS base_rank FROM ranks a JOIN ranks b USING (user_id) WHERE a.mode = 'popularity' AND b.mode = 'oldest')
SELECT user_id, rank::BIGINT AS rank, base_rank::BIGINT AS base_rank, (rank - base_rank)::BIGINT AS drop FROM p WHERE rank > base_rank ORDER BY rank - base_rank DESC, user_id LIMIT 20""")
def largest_drops(spark, sf):
    r = keep(_ranks(spark, sf), "ranks")
    p = r.filter("mode = 'popularity'").select("user_id", "rank").join(r.filter("mode = 'oldest'").select("user_id", (11 - F.col("rank")).alias("base_rank")), "user_id")
    return reports.debug_rows(p, "largest_drop", 20).select("user_id", *_big("rank", "base_rank", "drop"))


@query(f"""WITH rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL), f AS (SELECT *, list_filter(list_transform(coalesce(semantic_focus, []), lambda x: {S.clean("x")}), lambda y: y <> '')[1:8] AS focus FROM rec)
SELECT precompute_id, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE greatest(0.0, least(1.0, confidence)) END AS confidence, coalesce(array_to_string(focus, '|'), '') AS focus FROM f""")
def bounded_behaviors(spark, sf):
    return memories.bounded_behavior(T.records(spark, sf)).select("precompute_id", "confidence", F.array_join("semantic_focus", "|").alias("focus"))


@query()
def mapping_diagnostics(spark, sf):
    mapped = vectors.map_to_states(_vectors(spark, sf), _states(spark, sf).filter("label < 8"), "vec_id", "label", "embedding", min_similarity=0.15)
    q = contexts.query_tree(T.nodes(spark, sf), segments.latest_suffix(T.assignments(spark, sf)))
    return reports.mapping_diagnostics(mapped, q)


@query()
def tree_rank_evidence(spark, sf):
    q = contexts.query_tree(T.nodes(spark, sf), segments.latest_suffix(T.assignments(spark, sf)))
    return contexts.rank_evidence(q, states.state_profiles(T.state_members(spark, sf)))


# --- operators that stand beside the pipeline ------------------------------------------------------------------------


@query(f"WITH {S.SEGMENTS} SELECT user_id, count(DISTINCT state_id) AS states FROM asg WHERE coalesce(assignment_accepted, false) AND user_id IS NOT NULL GROUP BY 1")
def user_state_counts(spark, sf):
    return reports.user_state_counts(T.assignments(spark, sf))


@query(f"""WITH {_MEMBERS}, c AS (SELECT state_id, sign, count(*) AS n, min(i) AS first FROM mem WHERE sign IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY n DESC, first, sign) AS r FROM c)
SELECT state_id, sign AS signature, n FROM r WHERE r = 1""")
def state_signatures(spark, sf):
    m = T.state_members(spark, sf).withColumn("signs", F.array("trajectory_signature"))
    return states.top_terms(m, "signs", 1).select("state_id", F.col("term").alias("signature"), "n")


@query(f"""WITH {_MEMBERS}, x AS (SELECT state_id, 'mechanism=' || mech || '; scope=' || scp || '; direction=' || dir || '; trajectory=' || sign AS t, i FROM mem), c AS (SELECT state_id, t, min(i) AS first FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY first, t) AS r FROM c)
SELECT state_id, string_agg(t, ' / ' ORDER BY r) AS texts FROM r WHERE r <= 12 GROUP BY 1""")
def state_cluster_texts(spark, sf):
    return states.first_texts(T.state_members(spark, sf), "cluster_text", 12).select("state_id", F.array_join("texts", " / ").alias("texts"))


@query(f"""WITH {S.RECORDS}, {S.SMOOTHED}, mem AS (SELECT a.state_id, coalesce(a.assignment_accepted, false) AS ok, u.mech, u.scp, u.dir, u.precompute_id AS i FROM usable u JOIN asg a USING (memory_id)),
okay AS (SELECT state_id, bool_or(ok) AS any_ok FROM mem GROUP BY 1), v AS (SELECT m.* FROM mem m JOIN okay USING (state_id) WHERE m.ok OR NOT any_ok), pr AS (SELECT state_id, mech, scp, dir, count(*) AS votes, min(i) AS first FROM v GROUP BY ALL),
tx AS (SELECT state_id, mech, scp, dir FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY votes DESC, first) AS r FROM pr) WHERE r = 1),
o AS (SELECT ctx, target, p, row_number() OVER (PARTITION BY ctx ORDER BY round(p, 12) DESC, target) AS rank FROM smooth)
SELECT o.ctx, o.rank::BIGINT AS rank, o.target AS state_id, round(o.p, 6) AS probability, coalesce('mechanism=' || mech || '; scope=' || scp || '; direction=' || dir, '') AS state_text, coalesce(w.occurrences, 0)::BIGINT AS occurrences, coalesce(w.users, 0)::BIGINT AS users
FROM o LEFT JOIN w ON w.ctx = o.ctx AND w.target = o.target LEFT JOIN tx ON tx.state_id = o.target WHERE o.rank <= 5""")
def state_distributions(spark, sf):
    p = states.state_profiles(T.state_members(spark, sf)).select("state_id", text.profile_text(F.col("mechanism"), F.col("scope"), F.col("direction")).alias("state_text"), "mechanism", "scope", "direction")
    c = T.counts(spark, sf)
    d = contexts.distribution_rows(contexts.contexts(c), c, p)
    return d.select(_ctx(), *_big("rank"), "state_id", F.round("probability", 6).alias("probability"), "state_text", *_big("occurrences", "users"))


@query(f"""WITH {S.CONTEXTS} SELECT count_if(ord = 0)::BIGINT AS roots, count(*) AS contexts, count_if(ord > 0 AND NOT EXISTS (SELECT 1 FROM node p WHERE p.ctx = node.parent AND p.ord = node.ord - 1))::BIGINT AS orphans FROM node""")
def tree_checks(spark, sf):
    n = contexts.checked_nodes(T.nodes(spark, sf))
    return n.agg(F.count_if(F.size("ctx") == 0).alias("roots"), F.count("*").alias("contexts")).crossJoin(contexts.orphans(n).agg(F.count("*").alias("orphans")))  # one row each


@query(f"WITH {S.CONTEXTS} SELECT ctx, target, least(sum(n), 4)::BIGINT AS kept FROM cnt GROUP BY ALL")
def evidence_samples(spark, sf):
    obs = contexts.observations(T.segs(spark, sf)).withColumn("i", F.monotonically_increasing_id())
    return contexts.evidence_sample(obs, 4, "user_id", "i").groupBy("ctx", "target").agg(F.count("*").alias("kept")).select(_ctx(), "target", "kept")


@query(f"""WITH {S.HISTORIES}, us AS (SELECT DISTINCT user_id FROM hist WHERE user_id % 2 = 1), ord AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS ordinal FROM us) SELECT user_id, ordinal::BIGINT AS ordinal FROM ord WHERE ordinal >= 5 AND ordinal < 105""")
def selected_users(spark, sf):
    h = T.histories(spark, sf).select("user_id", F.col("user_id").alias("ordinal"))
    return readers.selected_users(h, available=h.filter("user_id % 2 = 1").select("user_id").distinct(), start=5, limit=100).select("user_id", *_big("ordinal"))


@query(f"WITH {_CHUNKS} SELECT user_id, window_index::BIGINT AS window_index FROM chunk WHERE window_index % 2 = 1")
def pending_windows(spark, sf):
    w = windows.chunk_windows(T.sequences(spark, sf), T.info(spark, sf)).select("user_id", "window_index")
    return memories.pending(w, w.filter("window_index % 2 = 0"), ["user_id", "window_index"]).select("user_id", *_big("window_index"))


@query(f"""WITH {S.RECORDS}, {S.SEGMENTS}, inc AS (SELECT DISTINCT user_id FROM asg WHERE assignment_accepted), exc AS (SELECT user_id FROM asg WHERE NOT coalesce(assignment_accepted, false) GROUP BY 1 HAVING count(*) > 1)
SELECT memory_id FROM usable WHERE user_id IN (SELECT user_id FROM inc WHERE user_id IS NOT NULL) AND user_id NOT IN (SELECT user_id FROM exc WHERE user_id IS NOT NULL)""")
def memories_of_users(spark, sf):
    a = T.assignments(spark, sf)
    bad = a.filter(~F.coalesce("assignment_accepted", F.lit(False))).groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1")
    return memories.usable_memories(T.records(spark, sf), a.filter("assignment_accepted"), bad).filter("invalid_reason is null").select("memory_id")


_CACHE = """WITH rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL)"""


def _cache_rows(spark, sf):
    d = T.records(spark, sf)
    return d.select("user_id", F.col("parse_ok").alias("precompute_ok"), F.when(F.col("mechanism").isNotNull(), F.array(F.struct("window_index", "mechanism"))).otherwise(F.array().cast("array<struct<window_index:int,mechanism:string>>")).alias("generated_behaviors"), F.col("precompute_id").alias("file_pos"))


@query(f"{_CACHE} SELECT user_id, max(precompute_id) AS file_pos FROM rec WHERE parse_ok AND mechanism IS NOT NULL GROUP BY 1")
def behavior_cache(spark, sf):
    return memories.behavior_cache(_cache_rows(spark, sf)).select("user_id", "file_pos")


@query(f"{_CACHE} SELECT DISTINCT user_id FROM rec WHERE parse_ok IS DISTINCT FROM false AND mechanism IS NOT NULL")
def successful_users(spark, sf):
    return memories.successful_users(_cache_rows(spark, sf))


@query("SELECT DISTINCT coalesce(nullif(trim(item_id), ''), nullif(trim(title), '')) AS id FROM items")
def catalogue_ids(spark, sf):
    return T.read(spark, sf, "items").select(items.catalogue_id(F.col("item_id"), F.col("title")).alias("id")).distinct()


@query("SELECT DISTINCT thought_id FROM global_memory WHERE embedding IS NOT NULL AND len(embedding) <> 64")
def dimension_violations(spark, sf):
    return pool.dimension_violations(T.read(spark, sf, "global_memory"), 64).distinct()


@query(f"""WITH {S.HISTORIES} SELECT user_id, mode, 20::BIGINT AS listed FROM (SELECT DISTINCT user_id FROM hist), (VALUES ('tree'), ('latest_only'), ('native')) m(mode)""")
def ranking_prompts(spark, sf):
    """Prompts of the three ranking conditions, with what the tree and the latest records say of users known to both."""
    c = _candidates(spark, sf)[1].withColumn("user_id", F.col("user_id").cast("string"))
    h = prep.last_n(T.sequences(spark, sf), 10).select(F.col("user_id").cast("string").alias("user_id"), F.array_join(F.col("items").cast("array<string>"), "\n").alias("history"))
    q = contexts.query_tree(T.nodes(spark, sf), segments.latest_suffix(T.assignments(spark, sf)))
    tree = contexts.rank_evidence(q, states.state_profiles(T.state_members(spark, sf)))
    p = providers.ranking_conditions(c, h, tree, memories.latest_behavior(T.usable(spark, sf)))
    return p.select(F.col("user_id").cast("bigint").alias("user_id"), "mode", F.regexp_count("prompt", F.lit(r"(?m)^C\d\d: ")).cast("bigint").alias("listed"))
