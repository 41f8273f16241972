"""Pieces of the SQL that says the same as the queries, for an independent engine."""

from __future__ import annotations

from wakeline.functions.text import ALIASES

#: white space in RE2 notation
_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def builder(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(translate(lower({clean(x)}), '_-', '  '), ' +', ' ', 'g')), ''), 'unknown')"


def inference(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({clean(x)}), '[^a-z0-9]+', ' ', 'g')), ''), 'unknown')"


def profile(x: str, kind: str, rule: str = "builder") -> str:
    base = (builder if rule == "builder" else inference)(x)
    return f"(SELECT CASE v {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES[kind].items())} ELSE v END FROM (SELECT {base} AS v))"


HISTORIES = """
r AS (SELECT user_id, item_id, rating, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS ts FROM ratings),
latest AS (SELECT user_id, item_id, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, rating DESC) rn
  FROM r WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND ts IS NOT NULL AND rating >= 0.5) WHERE rn = 1),
lengths AS (SELECT user_id, count(*) AS n_items FROM latest GROUP BY 1),
hist AS (SELECT l.*, n.n_items FROM latest l JOIN lengths n USING (user_id) WHERE n.n_items BETWEEN 10 AND 5000),
seqs AS (SELECT user_id, pos, item_id, CASE n_items - pos WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS pos FROM hist))
"""

ITEMS = f"""
one_item AS (SELECT item_id, min(nullif({clean("title")}, '')) AS title, min(nullif({clean("main_cat")}, '')) AS main_cat, min(nullif({clean("category")}, '')) AS category FROM items WHERE item_id IS NOT NULL GROUP BY 1),
genre AS (SELECT item_id, g FROM (SELECT item_id, g, row_number() OVER (PARTITION BY item_id ORDER BY len(g) DESC, g) AS rn FROM
  (SELECT item_id, list_filter(list_transform(coalesce(genres, []), lambda x: {clean("x")}), lambda y: y <> '') AS g FROM items WHERE item_id IS NOT NULL)) WHERE rn = 1),
info AS (SELECT item_id, coalesce(title, 'Item ' || item_id) AS item_name, coalesce(main_cat, category, nullif(array_to_string(g, ' > '), ''), 'Unknown') AS item_category FROM one_item JOIN genre USING (item_id))
"""

RECORDS = f"""
rec AS (SELECT DISTINCT ON (precompute_id) * FROM local_memory WHERE precompute_id IS NOT NULL),
norm AS (SELECT *, 'M' || precompute_id AS memory_id, {clean("coalesce(nullif(trajectory_signature, ''), behavior_signature)")} AS sign,
  {profile("mechanism", "mechanism")} AS mech, {profile("scope", "scope")} AS scp, {profile("direction", "direction")} AS dir FROM rec),
usable AS (SELECT * FROM norm WHERE parse_ok IS DISTINCT FROM false AND {clean("user_id")} <> '' AND {clean("recommendation_behavior")} <> '' AND sign <> '')
"""

SEGMENTS = """
asg AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY assigned_at DESC, state_id DESC) AS rn FROM assignments WHERE memory_id IS NOT NULL) WHERE rn = 1),
cuts AS (SELECT *, sum(CASE WHEN coalesce(assignment_accepted, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY window_index, memory_id) AS cut FROM asg WHERE user_id IS NOT NULL),
segs AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY cut) - 1 AS seg, row_number() OVER (PARTITION BY user_id, cut ORDER BY window_index, memory_id) - 1 AS pos, state_id, memory_id, window_index
  FROM cuts WHERE coalesce(assignment_accepted, false))
"""

#: as many states as the default trees' contexts have
ORDERS = 5


def _ordered() -> str:
    lags = ", ".join(f"lag(state_id, {k}) OVER w AS l{k}" for k in range(1, ORDERS + 1))
    obs = ["SELECT user_id, 0 AS ord, '' AS ctx, target FROM lags WHERE l1 IS NOT NULL"]
    obs += [f"SELECT user_id, {k}, {" || '|' || ".join(f'l{i}' for i in range(k, 0, -1))}, target FROM lags WHERE l{k} IS NOT NULL" for k in range(1, ORDERS + 1)]
    return f"""lags AS (SELECT user_id, state_id AS target, {lags} FROM segs WINDOW w AS (PARTITION BY user_id, seg ORDER BY pos)),
obs AS ({" UNION ALL ".join(obs)})"""


CONTEXTS = f"""{SEGMENTS},
{_ordered()},
cnt AS (SELECT ord, ctx, user_id, target, count(*) AS n FROM obs GROUP BY ALL),
own AS (SELECT ctx, user_id, sum(n) AS own FROM cnt GROUP BY ALL),
w AS (SELECT ord, ctx, target, sum(n::DOUBLE / own) AS weight, sum(n) AS occurrences, count(*) AS users FROM cnt JOIN own USING (ctx, user_id) GROUP BY ALL),
tot AS (SELECT ctx, sum(weight) AS total FROM w GROUP BY ALL),
raw AS (SELECT ord, ctx, target, weight / total AS p FROM w JOIN tot USING (ctx)),
node AS (SELECT c.ord, c.ctx, count(DISTINCT c.user_id) AS support_users, sum(c.n) AS support_occurrences, CASE WHEN c.ord = 0 THEN 1.0 ELSE count(DISTINCT c.user_id) / (count(DISTINCT c.user_id) + 5.0) END AS lam,
  CASE WHEN c.ord <= 1 THEN '' ELSE regexp_replace(c.ctx, '^[^|]*[|]', '') END AS parent FROM cnt c GROUP BY c.ord, c.ctx)
"""


def _smooth(k: int) -> str:
    above = "s0 q ON" if k == 1 else f"s{k - 1} q ON q.ctx = n.parent AND"
    return f"s{k} AS (SELECT n.ctx, t.target, n.lam * coalesce(r.p, 0) + (1 - n.lam) * q.p AS p FROM node n CROSS JOIN states t LEFT JOIN raw r ON r.ctx = n.ctx AND r.target = t.target JOIN {above} q.target = t.target WHERE n.ord = {k})"


SMOOTHED = f"""{CONTEXTS},
states AS (SELECT DISTINCT target FROM raw WHERE ord = 0),
s0 AS (SELECT ctx, target, p FROM raw WHERE ord = 0),
{", ".join(_smooth(k) for k in range(1, ORDERS + 1))},
smooth AS ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(ORDERS + 1))})
"""

ACTIVE = (
    SMOOTHED
    + """,
pq AS (SELECT ctx, target, max(p) AS p, max(q) AS q FROM (
  SELECT n.ctx, r.target, r.p, 0.0 AS q FROM node n JOIN raw r ON r.ctx = n.ctx AND r.ord = n.ord WHERE n.ord > 0
  UNION ALL SELECT n.ctx, r.target, 0.0, r.p FROM node n JOIN raw r ON r.ctx = n.parent AND r.ord = n.ord - 1 WHERE n.ord > 0) GROUP BY ALL),
div AS (SELECT ctx, greatest(0, sum(0.5 * CASE WHEN p > 1e-12 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 1e-12 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) AS jsd FROM pq GROUP BY ctx),
act AS (SELECT n.*, coalesce(d.jsd, 0.0) AS jsd, CASE WHEN n.ord = 0 THEN 'root' WHEN n.support_users < 3 OR n.support_occurrences < 3 THEN 'insufficient_support' WHEN n.ord = 1 THEN 'order1_base_context'
  WHEN coalesce(d.jsd, 0.0) >= 0.05 THEN 'predictive_gain' ELSE 'low_predictive_gain' END AS reason FROM node n LEFT JOIN div d USING (ctx)),
node_act AS (SELECT *, reason IN ('root', 'order1_base_context', 'predictive_gain') AS active FROM act)
"""
)
