"""The flat behaviour memory: thresholds that move with the pool, zones of action, and the ordered fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PoolConfig:
    low: float = 0.65
    high: float = 0.80
    link_size: int = 5
    max_evolutions: int = 10
    linking: bool = False  # without a model, every eligible memory is linked
    evolving: bool = True  # without, everything is stored

    def __post_init__(self):
        if not self.low < self.high:
            raise ValueError("low must be under high")


def thresholds(n: Column, low: float = 0.65, high: float = 0.80) -> tuple[Column, Column]:
    """low rises and high falls by up to 0.05 as the pool nears 1,000; back to the given ones should they cross."""
    share = F.least(n / F.lit(1000.0), F.lit(1.0)) * 0.05
    a, b = F.lit(low) + share, F.lit(high) - share
    return F.when(a < b, a).otherwise(low), F.when(a < b, b).otherwise(high)


def zone(sims: Column, n: Column, low: Column, high: Column) -> Column:
    """What a new memory leads to, first match: store without a pool or with nothing near; update and store under the high mark; update
    only where 60 % are very near; store where half are far; else both."""
    size = F.size(sims)
    share = lambda f: F.size(F.filter(sims, f)) / F.greatest(size, F.lit(1))
    top = F.array_max(sims)
    return (
        F.when((n == 0) | (size == 0), "no_memories:store")
        .when(top < low, "all_low:store")
        .when(top < high, "medium:update+store")
        .when(share(lambda s: s >= high) >= 0.6, "high_majority:update")
        .when(share(lambda s: s < low) >= 0.5, "low_majority:store")
        .when(share(lambda s: s >= high) >= 0.4, "high_share:update+store")
        .otherwise("mixed:update+store")
    )


def strategy_zones(similar: DataFrame, pool_size: int, config: PoolConfig | None = None) -> DataFrame:
    """(query, zone, eligible) over a fixed pool, from (query, id, cosine): a relational query."""
    c = config or PoolConfig()
    low, high = thresholds(F.lit(pool_size), c.low, c.high)
    lists = similar.groupBy("query").agg(F.collect_list("cosine").alias("sims"), F.array_sort(F.collect_list(F.when(F.col("cosine") >= low, F.col("id")))).alias("eligible"))
    return lists.select("query", zone(F.col("sims"), F.lit(pool_size), low, high).alias("zone"), "eligible")


#: answers of an evolution model that change nothing: fixed values
NO_CHANGE = {"", "n/a", "na", "none", "null", "same", "unchanged", "no change", "no changes", "placeholder", "updated text", "..."}
_CHANGED = pa.list_(pa.struct([("thought_id", pa.int64()), ("text", pa.string()), ("embedding", pa.list_(pa.float64()))]))
_FOLD = "shard string, thought_id bigint, zone string, stored boolean, links array<bigint>, updated array<bigint>, changed array<struct<thought_id:bigint,text:string,embedding:array<double>>>"

#: (new id, its text, [(id, text)] it is linked to) to the new texts by id
Evolver = Callable[[int, str, list[tuple[int, str]]], dict[int, str]]


def _zone(s: np.ndarray, n: int, low: float, high: float) -> str:
    """`zone` of one memory's highest similarities, by the same rules."""
    if not n or not len(s):
        return "no_memories:store"
    if s.max() < low:
        return "all_low:store"
    if s.max() < high:
        return "medium:update+store"
    if (s >= high).mean() >= 0.6:
        return "high_majority:update"
    if (s < low).mean() >= 0.5:
        return "low_majority:store"
    return "high_share:update+store" if (s >= high).mean() >= 0.4 else "mixed:update+store"


def fold(
    memories: DataFrame,
    config: PoolConfig | None = None,
    id_: str = "thought_id",
    vector: str = "embedding",
    shard: str | None = None,
    resume: DataFrame | None = None,
    processed: DataFrame | None = None,
    linker: Callable[[int, list[int]], list[int]] | None = None,
    evolver: Evolver | None = None,
    encoder: Callable[[list[str]], list[list[float]]] | None = None,
    text: str | None = None,
) -> DataFrame:
    """One row a memory, in order of ids within its shard: the zone it met, whether it was stored, the links it got, the memories it updated, and
    what their texts and vectors became.

    The pool grows as it is replayed, so a shard is one task by nature, of work quadratic in its memories (a 64-dimensional pool of 100,000 is 50 MB and some minutes): without
    `shard` the fold is exact and single; with more shards (a column) each keeps its own pool, which is another result, named as such. Vectors that
    are null or of another length than the first are left out.

    resume: a pool to start from (id, vector, evolution_count, the text and the shard column, if there are some); processed: the `progress` up to which it was
    built (shard, last_id, config); memories up to their shard's last id are done, whether they were stored or only updated others. Both go together, and other settings than
    the stored ones raise.

    linker chooses among the eligible ids (a model's place); without, all are linked; ids it makes up are dropped, and if it fails nothing is
    linked and a store stands. evolver rewrites the texts of linked memories below max_evolutions: what it leaves out, answers with no more than a placeholder or leaves as it was
    isn't changed; if it fails nothing is. What changed is encoded again and has its new vector from then on. Without an evolver an update counts and changes no
    text. A memory all of whose links are used up is stored after all.
    """
    c = config or PoolConfig()
    if (resume is None) != (processed is None):
        raise ValueError("a fold resumes from a pool and the progress it was built up to")
    if evolver is not None and (encoder is None or text is None):
        raise ValueError("an evolver needs an encoder and a text column")
    named = F.coalesce(F.col(shard).cast("string"), F.lit("")) if shard else F.lit("all")

    def view(d: DataFrame, old: Column) -> DataFrame:
        t = F.coalesce(F.col(text), F.lit("")) if text else F.lit("")
        return d.select(named.alias("shard"), F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), t.alias("t"), old.cast("int").alias("old")).dropna()

    rows = view(memories, F.lit(-1))
    if resume is not None:
        wrong = [r["config"] for r in processed.select("config").distinct().limit(2).collect() if r["config"] != repr(c)]
        if wrong:
            raise ValueError(f"the pool was built under {wrong[0]}, not {c!r}")
        rows = rows.join(processed.select("shard", "last_id"), "shard", "left").filter(F.col("last_id").isNull() | (F.col("id") > F.col("last_id"))).drop("last_id")
        rows = rows.unionByName(view(resume, F.coalesce("evolution_count", F.lit(0))))

    def replay(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, vs, texts_, olds = (t[k].to_pylist() for k in ("id", "v", "t", "old"))
        dims = len(vs[0])
        pool = np.zeros((len(ids), dims))
        own, words, evolutions, out, n = [], [], [], [], 0

        def unit(v) -> np.ndarray:
            x = np.asarray(v, np.float64)
            return x / max(np.linalg.norm(x), 1e-12)

        for i in sorted(range(len(ids)), key=lambda i: olds[i] < 0):  # the pool resumed from, then the memories
            me, v, said, old = ids[i], vs[i], texts_[i], olds[i]
            if len(v) != dims:
                continue
            x = unit(v)
            if old >= 0:
                pool[n] = x
                own.append(me)
                words.append(said)
                evolutions.append(old)
                n += 1
                continue
            share = 0.05 * min(n / 1000, 1)
            low, high = (c.low + share, c.high - share) if c.low + share < c.high - share else (c.low, c.high)
            sims = pool[:n] @ x
            near = np.lexsort((np.arange(n), -np.round(sims, 9)))[: c.link_size]
            kind = _zone(sims[near], n, low, high)
            store = not c.evolving or "store" in kind
            links, updated, changed = [], [], []
            if c.evolving and "update" in kind:
                links = [int(k) for k in near if sims[k] >= low]
                if linker is not None:
                    try:
                        chosen = set(linker(me, [own[k] for k in links]))
                    except Exception:  # noqa: BLE001
                        chosen = set()
                    links = [k for k in links if own[k] in chosen]
                free = [k for k in links if evolutions[k] < c.max_evolutions]
                store = store or bool(links and not free)
                updated = free
                if evolver is not None and free:
                    try:
                        told = evolver(me, said, [(own[k], words[k]) for k in free])
                    except Exception:  # noqa: BLE001
                        told = {}
                    new = {k: " ".join(str(told[own[k]]).split()) for k in free if told and told.get(own[k]) is not None}
                    updated = [k for k, w in new.items() if w.lower() not in NO_CHANGE and w != words[k]]
                    for k, e in zip(updated, encoder([new[k] for k in updated]) if updated else [], strict=True):
                        words[k], pool[k] = new[k], unit(e)
                        changed.append({"thought_id": own[k], "text": new[k], "embedding": [float(z) for z in e]})
                for k in updated:
                    evolutions[k] += 1
            out.append((t["shard"][0].as_py(), me, kind, store, [own[k] for k in links], [own[k] for k in updated], changed))
            if store:
                pool[n] = x
                own.append(me)
                words.append(said)
                evolutions.append(0)
                n += 1
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), _CHANGED]
        names = ["shard", "thought_id", "zone", "stored", "links", "updated", "changed"]
        return pa.table([pa.array(col, k) for col, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    return rows.groupBy("shard").applyInArrow(replay, _FOLD)


def progress(folded: DataFrame, config: PoolConfig | None = None, before: DataFrame | None = None) -> DataFrame:
    """(shard, last_id, config): how far each shard's memories are done, stored or not; before: the progress this fold resumed from."""
    d = folded.groupBy("shard").agg(F.max("thought_id").alias("last_id"))
    if before is not None:
        d = d.unionByName(before.select("shard", "last_id")).groupBy("shard").agg(F.max("last_id").alias("last_id"))
    return d.withColumn("config", F.lit(repr(config or PoolConfig())))


def evolution_log(folded: DataFrame) -> DataFrame:
    """(shard, by_id, thought_id, text): each update of a memory, by which one, and its new text where there is one."""
    new = F.filter("changed", lambda x: x["thought_id"] == F.col("u"))
    d = folded.select("shard", F.col("thought_id").alias("by_id"), "changed", F.explode("updated").alias("u"))
    return d.select("shard", "by_id", F.col("u").alias("thought_id"), F.try_element_at(new, F.lit(1))["text"].alias("text"))


def pool_after(memories: DataFrame, folded: DataFrame, id_: str = "thought_id", vector: str = "embedding", shard: str | None = None, resume: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """The pool a fold leaves (id, vector, evolution_count, links, and the text and shard columns, if there are some): what was stored and what was there, with the updates
    counted and the last changed text and vector of each."""
    extra = [c for c in (text, shard) if c]
    stored = folded.filter("stored").select(F.col("thought_id").alias(id_), "links")
    new = memories.select(id_, F.col(vector).cast("array<double>").alias(vector), *extra).dropDuplicates([id_]).join(stored, id_).withColumn("evolution_count", F.lit(0))
    if resume is not None:
        cols = [F.coalesce("links", F.array().cast("array<bigint>")).alias("links") if "links" in resume.columns else F.array().cast("array<bigint>").alias("links")]
        new = new.unionByName(resume.select(id_, F.col(vector).cast("array<double>").alias(vector), *extra, *cols, F.coalesce("evolution_count", F.lit(0)).alias("evolution_count")))
    more = folded.select(F.explode("updated").alias(id_)).groupBy(id_).agg(F.count("*").cast("int").alias("more"))
    last = folded.select("thought_id", F.explode("changed").alias("x")).groupBy(F.col("x.thought_id").alias(id_)).agg(F.max_by("x", "thought_id").alias("x"))
    d = new.join(more, id_, "left").join(last, id_, "left").withColumn("evolution_count", F.col("evolution_count") + F.coalesce("more", F.lit(0)))
    d = d.withColumn(vector, F.coalesce("x.embedding", vector))
    return (d.withColumn(text, F.coalesce("x.text", text)) if text else d).drop("more", "x")


def checked_pool(pool: DataFrame, dims: int, vector: str = "embedding", id_: str = "thought_id") -> DataFrame:
    """A stored pool, after its checks: no id twice, no null id or vector, all vectors of one length; else raises."""
    bad = pool.agg(F.count_if(F.col(id_).isNull() | F.col(vector).isNull() | (F.size(vector) != dims)).alias("bad"), (F.count("*") - F.countDistinct(id_)).alias("twice")).first()
    if bad["bad"] or bad["twice"]:
        raise ValueError(f"{bad['bad']} memories without an id or a vector of {dims}, {bad['twice']} ids again")
    return pool


def replace_vectors(pool: DataFrame, changed: DataFrame, id_: str = "thought_id") -> DataFrame:
    """The pool with changed rows in place of the old ones: an anti join and a union."""
    return pool.join(changed.select(id_), id_, "left_anti").unionByName(changed, allowMissingColumns=True)


def dimension_violations(pool: DataFrame, dims: int, vector: str = "embedding", id_: str = "thought_id") -> DataFrame:
    return pool.filter(F.col(vector).isNotNull() & (F.size(vector) != dims)).select(id_)
