"""Running totals and ordinals over a whole table without passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.storage import keep


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over all rows before this one in the order (which should be total).

    Rows are range-partitioned and written; each range is cumulated by itself and shifted by the ranges before it, of which
    there is one row a partition.
    """
    d = df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    d = keep(d, "ranges")
    totals = d.groupBy("_part").agg(F.sum("_v").alias("_t"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_v", "_part", "_base")


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """df with its place in the order, from 0."""
    return running_total(df, order, F.lit(1), name)
