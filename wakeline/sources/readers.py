"""Readers of the pipeline's files. Schemas are given, never inferred."""

from __future__ import annotations

import json
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.order import ordinals
from wakeline.storage import new_path

RATINGS = "userId BIGINT, movieId BIGINT, rating DOUBLE, timestamp BIGINT"
MOVIES = "movieId BIGINT, title STRING, genres STRING"
ITEM = "struct<title:string,main_cat:string,category:string,genres:array<string>>"


def _unzipped(spark: SparkSession, archive: str, member: str) -> str:
    """A member of a ZIP (the one of the shallowest path), streamed into the shared folder: a ZIP cannot be split, so it is unpacked once."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if posixpath.basename(n) == member]
        if not names:
            raise FileNotFoundError(f"{member} in {archive}")
        name = min(names, key=lambda n: (n.count("/"), n))
        path = new_path(spark, "unzipped")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        target = fs.Path(f"{path}/{member}")
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        with z.open(name) as f:
            while chunk := f.read(1 << 20):
                out.write(bytearray(chunk))
        out.close()
    return f"{path}/{member}"


def csv(spark: SparkSession, source: str, member: str, schema: str) -> DataFrame:
    """A CSV with a header of a folder or a ZIP; a header that lacks a column of the schema raises."""
    path = _unzipped(spark, source, member) if source.endswith(".zip") else f"{source.rstrip('/')}/{member}"
    need = [c.split()[0] for c in schema.split(", ")]
    absent = [c for c in need if c not in spark.read.option("header", True).csv(path).columns]
    if absent:
        raise ValueError(f"{member} lacks {absent}")
    return spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path).select(*need)


def ratings(spark: SparkSession, source: str) -> DataFrame:
    d = csv(spark, source, "ratings.csv", RATINGS)
    return d.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating", F.col("timestamp").alias("ts"))


def movies(spark: SparkSession, source: str) -> DataFrame:
    return csv(spark, source, "movies.csv", MOVIES)


def json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """One JSON object as rows (key, fields of `value`). A single document is one row by nature; large tables belong in JSONL or Parquet."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "v"))
    return d.select(key, "v.*") if value.startswith("struct") else d.withColumnRenamed("v", "value")


def items(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, ITEM, "item_id")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; a bad line, or one whose values have other types, is skipped whatever columns are read later, or raises where strict. Blank lines are none."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    x = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.select(x.alias("x")).filter("x is not null and x._bad is null").select("x.*").drop("_bad")


def user_ids(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, ordinal) of a JSON list, an object with `users`, an object's keys, or plain lines. A list of users to run, read by the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        x = json.loads(text)
        if isinstance(x, dict):
            x = x["users"] if isinstance(x.get("users"), list) else list(x)
        ids = [str(u) for u in x] if isinstance(x, list) else [str(x)]
    except ValueError:
        ids = [s.strip() for s in text.splitlines()]
    ids = list(dict.fromkeys(u for u in ids if u))
    return spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "user_id string, ordinal int")


_CANDIDATE = "struct<user_id:string,uid:string,user:string,candidates:array<string>,target:string>"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, candidates, target array<string>) of an object by user, the same under `users`, a list, or JSON lines; a target may be an id or a list of them."""
    whole = spark.read.text(path, wholetext=True).withColumn("t", F.trim("value"))
    under = F.get_json_object("t", "$.users")
    whole = whole.withColumn("t", F.when(F.substring("t", 1, 1).eqNullSafe("{") & under.isNotNull() & F.get_json_object("t", "$.candidates").isNull(), under).otherwise(F.col("t")))
    head = whole.select(F.substring("t", 1, 1).alias("c"), F.expr("try_parse_json(t) is not null").alias("ok")).first()
    uid = lambda s: F.coalesce(s["user_id"], s["uid"], s["user"])
    if head["c"] == "[":
        d = whole.select(F.explode(F.from_json("t", f"array<{_CANDIDATE}>")).alias("x")).select(uid(F.col("x")).alias("user_id"), "x.candidates", "x.target")
    elif head["ok"] and not whole.select(F.from_json("t", _CANDIDATE).alias("x")).filter("x.candidates is not null").limit(1).count():
        d = whole.select(F.explode(F.from_json("t", f"map<string,{_CANDIDATE}>")).alias("k", "x")).select(F.coalesce("k", uid(F.col("x"))).alias("user_id"), "x.candidates", "x.target")
    else:
        d = spark.read.text(path).select(F.from_json("value", _CANDIDATE).alias("x")).filter("x is not null").select(uid(F.col("x")).alias("user_id"), "x.candidates", "x.target")
    target = F.when(F.substring("target", 1, 1) == "[", F.from_json("target", "array<string>")).when(F.col("target").isNotNull(), F.array("target"))
    return d.filter("user_id is not null and candidates is not null").withColumn("target", target)


def vectors(spark: SparkSession, path: str, expected: int | None = None, ids: DataFrame | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """Vectors from Parquet, or (row, embedding) from a .npy matrix on a path all executors have mounted: the driver reads its header, tasks their ranges of rows. ids
    (row, id) names the rows, as `row`. A wrong number of rows raises."""
    if path.endswith(".npy"):
        import numpy as np

        at = path.removeprefix("file://")
        n = len(np.load(at, mmap_mode="r"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.load(at, mmap_mode="r")
            for b in batches:
                rows = b.column(0).to_numpy()
                yield pa.record_batch([b.column(0), pa.array(list(np.asarray(m[rows], np.float32)), pa.list_(pa.float32()))], names=["row", "embedding"])

        d = spark.range(0, n, 1, max(1, -(-n // rows_per_task))).mapInArrow(run, "row bigint, embedding array<float>")
        if ids is not None:
            d = d.join(ids.select("row", "id"), "row").select(F.col("id").alias("row"), "embedding")
    else:
        d = spark.read.parquet(path)
    if expected is not None and (n := d.count()) != expected:
        raise ValueError(f"{n} vectors, {expected} expected")
    return d


def selected_users(sequences: DataFrame, listed: DataFrame | None = None, available: DataFrame | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
    """(user_id, ordinal): the listed users in their order, else all by first appearance (column ordinal of sequences), of those available; then a stretch."""
    every = sequences.groupBy("user_id").agg(F.min("ordinal").alias("ordinal"))
    d = every if listed is None else listed.join(every.select("user_id"), "user_id", "left_semi")
    d = d if available is None else d.join(available.select("user_id"), "user_id", "left_semi")
    d = ordinals(d, ["ordinal", "user_id"], "r")
    d = d.filter(F.col("r") >= start)
    return (d.filter(F.col("r") < start + limit) if limit is not None else d).select("user_id", F.col("r").alias("ordinal"))
