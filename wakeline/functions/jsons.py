"""JSON held in model answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def json_body(c: Column) -> Column:
    """The text of the outermost braces, within the first fence if there is one; the text itself where there are none."""
    fenced = F.coalesce(
        F.nullif(F.regexp_extract(c, r"(?s)```json(.*?)(?:```|\z)", 1), F.lit("")),
        F.nullif(F.regexp_extract(c, r"(?s)```(.*?)(?:```|\z)", 1), F.lit("")),
        c,
    )
    braces = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    return F.trim(F.when(braces == "", fenced).otherwise(braces))


def first_value(text: str | None) -> str | None:
    """The first balanced JSON object or array of a text, minding strings; None where none parses."""
    if not text:
        return None
    for start, c in enumerate(text):
        if c not in "{[":
            continue
        depth, quoted, escaped = [], False, False
        for end in range(start, len(text)):
            x = text[end]
            if quoted:
                escaped, quoted = (not escaped and x == "\\"), not (x == '"' and not escaped)
            elif x == '"':
                quoted = True
            elif x in "{[":
                depth.append("}" if x == "{" else "]")
            elif x in "}]":
                if not depth or depth.pop() != x:
                    break
                if not depth:
                    try:
                        json.loads(text[start : end + 1])
                        return text[start : end + 1]
                    except ValueError:
                        break
    return None


@F.pandas_udf(StringType())
def extract_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Balanced matching is no regular language, so this one runs in Python, a batch at a time."""
    for s in texts:
        yield s.map(first_value, na_action="ignore")
