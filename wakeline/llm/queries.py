"""The queries of this subpackage over the driver's tables, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import clusters as similar_clusters
from wakeline.llm import encoding, leakage, mixing, near_duplicates, neighbours, pairs, sequences, term_counts
from wakeline.llm.text import table
from wakeline.storage import keep

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_clusters.clusters(table(spark, sf, "global_memory"), "thought_id", "embedding")


def _described(members: DataFrame, d: DataFrame) -> DataFrame:
    got = similar_clusters.describe(members, d, "thought_id", "pattern_description")
    return got.select("cluster_key", "size", *[F.try_element_at("typical", F.lit(i)).alias(f"typical_{i}") for i in (1, 2, 3)])


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "global_memory")
    return _described(keep(similar_clusters.member_cosines(keep(p1_found(spark, sf), "members"), d, "thought_id", "embedding"), "member-cosines"), d)


def p1_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by the words of pattern_description, as hashed weighted features, with their most typical descriptions."""
    d = table(spark, sf, "global_memory")
    return _described(keep(similar_clusters.text_clusters(d, "thought_id", "pattern_description"), "topics"), d)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_terms(spark, sf).filter("band <> 'useful'").select("term", "band")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf, "global_memory"), "thought_id", "keywords")


def _similar(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.similar_classes(table(spark, sf, "global_memory"), "thought_id", ["behavior_explanation", "pattern_description"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.similar_pairs(*_similar(spark, sf)).select(F.col("a").alias("thought_id_a"), F.col("b").alias("thought_id_b"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.duplicate_groups(*_similar(spark, sf)).withColumnRenamed("key", "thought_id")


def p4_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, sf, "global_memory"), "thought_id", "embedding").withColumn("cosine", F.round("cosine", 6))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.mutual_pairs(p4_neighbors(spark, sf), "thought_id", "thought_id_a", "thought_id_b")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "call_stat").filter("call_type = 'behavior_extraction'").groupBy("thought_id").agg(F.min("prompt").alias("prompt"))
    memories = table(spark, sf, "global_memory").groupBy("thought_id").agg(F.min("behavior_explanation").alias("answer"))
    return pairs.broken_pairs(memories.join(calls, "thought_id", "left"), "thought_id", "prompt", "answer", table(spark, sf, "documents"))


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "assignments").filter("assignment_accepted")


def p6_patterns(spark: SparkSession, sf: str) -> DataFrame:
    got = sequences.frequent_sequences(_accepted(spark, sf), "user_id", "window_index", "state_id")
    return got.select(F.array_join("pattern", ">").alias("pattern"), F.size("pattern").cast("bigint").alias("states"), F.col("entities").alias("users"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_patterns(spark, sf).select("pattern")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_passages"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).filter("distance = 0").select("doc_id", "eval_id")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture of nine tenths of all that the caps allow: small sources are clamped at their repeats, the others take over their weight."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), share_of_caps=0.9)[1]


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).select("doc_id")


def queries() -> dict[str, Query]:
    found = [p1_found, p1_clusters, p1_topics, p2_found, p2_terms, p3_found, p3_groups, p4_found, p4_neighbors, p5_found, p6_found, p6_patterns, p7_found, p7_leaks, p8_mixture, p8_clamped, p8_documents, p9_found, p9_restored]
    return {f.__name__: f for f in found}


_USABLE = """g AS (SELECT DISTINCT ON (thought_id) thought_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM global_memory WHERE thought_id IS NOT NULL
  AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM g),
s AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) / (a.n * b.n) AS c FROM u a JOIN u b ON a.id <> b.id WHERE list_inner_product(a.v, b.v) >= 0.85 * a.n * b.n)"""

_TERMS = r"""g AS (SELECT thought_id, row_number() OVER () AS r, unnest(keywords) AS k FROM global_memory WHERE thought_id IS NOT NULL),
n AS (SELECT thought_id, r, trim(regexp_replace(translate(lower(k), '_-', '  '), '[\s\pZ\x{85}\x{1C}-\x{1F}\x{0B}]+', ' ', 'g')) AS term FROM g),
o AS (SELECT term, sum(n)::BIGINT AS occurrences FROM (SELECT thought_id, term, max(n) AS n FROM (SELECT thought_id, r, term, count(*) AS n FROM n WHERE term <> '' GROUP BY ALL) GROUP BY ALL) GROUP BY 1),
t AS (SELECT DISTINCT thought_id, term FROM n WHERE term <> ''), c AS (SELECT term, count(*) AS records FROM t GROUP BY 1),
b AS (SELECT term, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(DISTINCT thought_id) FROM t) THEN 'common' ELSE 'useful' END AS band FROM c)"""

_SEQUENCES = """q AS (SELECT user_id, window_index, max(state_id) AS s FROM assignments WHERE assignment_accepted AND user_id IS NOT NULL AND window_index IS NOT NULL AND state_id IS NOT NULL GROUP BY ALL),
p AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY window_index) AS i FROM q),
p2 AS (SELECT DISTINCT a.user_id, a.s || '>' || b.s AS pattern, b.i FROM p a JOIN p b ON b.user_id = a.user_id AND b.i - a.i BETWEEN 1 AND 3),
p3 AS (SELECT DISTINCT a.user_id, a.pattern || '>' || b.s AS pattern, b.i FROM p2 a JOIN p b ON b.user_id = a.user_id AND b.i - a.i BETWEEN 1 AND 3),
p4 AS (SELECT DISTINCT a.user_id, a.pattern || '>' || b.s AS pattern, b.i FROM p3 a JOIN p b ON b.user_id = a.user_id AND b.i - a.i BETWEEN 1 AND 3),
f AS (SELECT pattern, count(DISTINCT user_id) AS users FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) GROUP BY 1),
k AS (SELECT * FROM f WHERE users >= 3 AND users >= 0.02 * (SELECT count(DISTINCT user_id) FROM p))"""


def _grams(rows: str) -> str:
    return f"SELECT id, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({rows})) WHERE len(w) >= 13)"


def oracle_sql() -> dict[str, str]:
    """What SQL can tell over whole tables. p1 holds where linked memories are all alike, as they are in these tables; the rest is
    tested against plain versions on fixtures."""
    return {
        "p1_found": f"WITH {_USABLE} SELECT least(a, min(b)) AS cluster_key, a AS thought_id FROM s GROUP BY a",
        "p1_clusters": f"""WITH {_USABLE}, c AS (SELECT least(a, min(b)) AS k, a AS id FROM s GROUP BY a), d AS (SELECT k, id, unnest(list_transform(v, lambda x: x / n)) AS x, generate_subscripts(v, 1) AS i FROM c JOIN u USING (id)),
m AS (SELECT k, list(x ORDER BY i) AS m FROM (SELECT k, i, sum(x) AS x FROM d GROUP BY ALL) GROUP BY k), o AS (SELECT c.k, c.id, row_number() OVER (PARTITION BY c.k ORDER BY round(list_inner_product(u.v, m.m) / (u.n * sqrt(list_inner_product(m.m, m.m))), 9) DESC, c.id) AS r FROM c JOIN u USING (id) JOIN m USING (k)),
t AS (SELECT thought_id AS id, min(pattern_description) AS t FROM global_memory GROUP BY 1)
SELECT k AS cluster_key, count(*) AS size, max(CASE WHEN r = 1 THEN t END) AS typical_1, max(CASE WHEN r = 2 THEN t END) AS typical_2, max(CASE WHEN r = 3 THEN t END) AS typical_3 FROM o JOIN t USING (id) GROUP BY k""",
        "p2_found": f"WITH {_TERMS} SELECT term, band FROM b WHERE band <> 'useful'",
        "p2_terms": f"WITH {_TERMS} SELECT b.term, b.records, o.occurrences, b.band FROM b JOIN o USING (term)",
        "p3_found": r"""WITH g AS (SELECT DISTINCT ON (thought_id) thought_id AS id, concat_ws(' ', behavior_explanation, pattern_description) AS t FROM global_memory WHERE thought_id IS NOT NULL),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM g), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT a AS thought_id_a, b AS thought_id_b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.6 * (x.n + y.n - k)""",
        "p4_found": f"WITH {_USABLE}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM s) SELECT DISTINCT least(a, b) AS thought_id_a, greatest(a, b) AS thought_id_b FROM r WHERE r <= 5",
        "p4_neighbors": f"WITH {_USABLE}, r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM s) SELECT a AS thought_id, b AS neighbor, round(round(c, 9), 6) AS cosine FROM r WHERE r <= 5",
        "p6_found": f"WITH {_SEQUENCES} SELECT pattern FROM k",
        "p6_patterns": f"WITH {_SEQUENCES} SELECT pattern, len(string_split(pattern, '>'))::BIGINT AS states, users FROM k",
        "p7_found": f"WITH d AS ({_grams('SELECT doc_id AS id, text AS t FROM documents')}), e AS ({_grams('SELECT eval_id AS id, passage AS t FROM eval_passages')}) SELECT DISTINCT d.id AS doc_id, e.id AS eval_id FROM d JOIN e USING (gram)",
    }
