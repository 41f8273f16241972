"""Frequency of every distinct term: recursive radix spilling, each partition aggregated out-of-core with DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.storage import new_path, spill_folder

_PART = "term string, h bigint, records bigint, occurrences bigint"


def normal_term(c: Column) -> Column:
    """Lower case, `_` and `-` as blanks, every run of white space (no-break spaces too) one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def _connect(spill: str | None, memory: str):
    """DuckDB on one thread, spilling past its memory limit to the shared folder; where that is no mounted path, it doesn't spill (never to a machine's own disk)."""
    import duckdb

    conf = {"threads": 1, "preserve_insertion_order": False, "temp_directory": f"{spill}/duckdb" if spill else ""}
    return duckdb.connect(config=conf | ({"memory_limit": memory} if spill else {}))


def _duck(spill: str | None, sql: str, schema: pa.Schema, memory: str):
    """A mapInArrow function: loads its partition into DuckDB and yields sql's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect(spill, memory)
        made = False
        for b in batches:
            con.register("b", pa.Table.from_batches([b]))
            con.execute("insert into t select * from b" if made else "create table t as select * from b")
            con.unregister("b")
            made = True
        if made:
            yield from _batches(con, sql, schema)
        con.close()

    return run


def _batches(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().cast(schema).to_batches(max_chunksize=50_000)


def _leaves(spill: str, groups: list[list[str]], sql: str, schema: pa.Schema, memory: str):
    """A mapInArrow function over group numbers: DuckDB reads each leaf's files from the shared folder and aggregates it by itself, out of core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0).to_pylist():
                for leaf in groups[g]:
                    con = _connect(spill, memory)
                    con.execute(f"create view t as select * from read_parquet('{leaf.replace("'", "''")}/*.parquet')")
                    yield from _batches(con, sql, schema)
                    con.close()

    return run


_PARTIAL = pa.schema([("term", pa.string()), ("h", pa.int64()), ("records", pa.int64()), ("occurrences", pa.int64())])
_FINAL = pa.schema([("term", pa.string()), ("records", pa.int64()), ("occurrences", pa.int64())])


def term_frequencies(
    df: DataFrame,
    key: str,
    terms: str,
    rare_below: int = 3,
    common_above: float = 0.05,
    bits: int = 5,
    partition_rows: int = 4_000_000,
    memory: str = "300MB",
) -> DataFrame:
    """(term, records, occurrences, band) for every distinct normalised term of the array column `terms`.

    records: distinct keys that hold the term; occurrences: its spellings in them, re-sent rows of a key counted once
    (the row with most). band: `rare` under rare_below records, `common` over common_above of the records that hold
    any term, else `useful`. Null keys, null arrays, null and blank terms are no terms; an empty table gives no rows;
    other columns are not read.

    One shuffle makes (key, term) unique; each task then holds disjoint keys, so its DuckDB counts add up and a term
    held by a third of all rows leaves a task as one row. Those partial counts are spilled to the shared folder by
    the first `bits` hash bits of the term; a partition over partition_rows is spilled again by its next bits, until
    none is; then a task takes one leaf, or several small ones, reads its files from the shared folder and has DuckDB aggregate it within
    `memory`, spilling to that folder. (Where the folder is no mounted path, Spark reads the leaves and hands them out by term.)
    """
    spark = df.sparkSession
    spill = spill_folder(spark)
    held = (
        df.select(F.col(key).alias("k"), F.filter(F.transform(F.col(terms), normal_term), lambda t: F.length(t) > 0).alias("ts"))
        .filter(F.col("k").isNotNull() & (F.size("ts") > 0))
        .select("k", F.explode(F.transform(F.array_distinct("ts"), lambda t: F.struct(t.alias("term"), F.size(F.filter("ts", lambda u: u == t)).cast("long").alias("n")))).alias("x"))
        .groupBy("k", "x.term")
        .agg(F.max("x.n").alias("n"))
        .select("k", "term", "n", F.xxhash64("term").alias("h"))
    )
    n_keys = df.filter(F.col(key).isNotNull() & F.exists(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda t: F.length(normal_term(t)) > 0)).agg(F.countDistinct(key)).first()[0]
    partial = held.mapInArrow(_duck(spill, "select term, any_value(h) h, count(*) records, sum(n)::bigint occurrences from t group by term", _PARTIAL, memory), _PART)

    def radix(level: int) -> Column:
        return F.shiftrightunsigned("h", 64 - bits * (level + 1)).bitwiseAND((1 << bits) - 1).cast("int")

    def spilled(rows: DataFrame, level: int) -> list[tuple[str, int, int]]:
        """(path, radix, rows) of each partition of rows, written by the level's hash bits."""
        path = new_path(spark, f"radix{level}")
        rows.withColumn("radix", radix(level)).write.partitionBy("radix").option("compression", "zstd").parquet(path)
        sizes = spark.read.schema(_PART + ", radix int").parquet(path).groupBy("radix").count().collect()
        return [(f"{path}/radix={r['radix']}", r["radix"], r["count"]) for r in sizes]

    leaves: list[tuple[str, int]] = []
    work = [(p, n, 1) for p, _, n in spilled(partial, 0)]
    while work:
        path, n, level = work.pop()
        if n > partition_rows and bits * (level + 1) <= 64:
            work += [(p, m, level + 1) for p, _, m in spilled(spark.read.schema(_PART).parquet(path), level)]
        else:
            leaves.append((path, n))
    if not leaves:
        return spark.createDataFrame([], "term string, records bigint, occurrences bigint, band string")
    leaves.sort()
    groups: list[list[str]] = [[]]
    room = partition_rows // 8
    for path, n in leaves:  # small leaves share a task; a leaf is never divided
        if groups[-1] and n > room:
            groups.append([])
            room = partition_rows // 8
        groups[-1].append(path)
        room -= n
    sql, out = "select term, sum(records)::bigint records, sum(occurrences)::bigint occurrences from t group by term", "term string, records bigint, occurrences bigint"
    if spill:
        own = [[f"{spill}/{p.rsplit(spill.rstrip('/') + '/', 1)[-1]}" for p in g] for g in groups]
        counts = spark.range(0, len(own), 1, len(own)).mapInArrow(_leaves(spill, own, sql, _FINAL, memory), out)
    else:
        counts = spark.read.schema(_PART).parquet(*[p for g in groups for p in g]).repartition(len(groups), "term").mapInArrow(_duck(None, sql, _FINAL, memory), out)
    band = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n_keys, "common").otherwise("useful")
    return counts.withColumn("band", band)
