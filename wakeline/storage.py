"""Tables that cut lineage: written once to the folder all executors share, then read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="wakeline-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return _local["dir"]


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def discard(spark: SparkSession) -> int:
    """Removes the tables this process has written to the shared folder, by Hadoop's file system; how many. For when a run's results are stored: DataFrames that
    read them can't be evaluated afterwards."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _written:
        path = fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a written table (optionally partitioned by columns); survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are removed when it ends, not when the driver happens to collect its garbage: for writes whose plans aren't used again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def spill_folder(spark: SparkSession) -> str | None:
    """shared_dir as a mounted path for engines that spill by themselves; None where it is not a mounted file system."""
    at = shared_dir(spark)
    if at.startswith("file:"):
        return "/" + at[5:].lstrip("/")
    return at if at.startswith("/") else None


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers of the session's application, once, by Spark's own file distribution."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="wakeline-ship-")) / "wakeline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = str(path)
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
