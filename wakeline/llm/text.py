"""Words and tables shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: a word: in lower-cased text, a maximal run of letters and digits
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
