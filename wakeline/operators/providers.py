"""Stand-ins for language models behind one interface: deterministic rules over a window's facts, and prompt texts (own wording).

They reproduce no model's output. A model is plugged in as a function over Arrow batches with `answered_by`.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from wakeline.operators.windows import evidence


def rule_behavior(windows: DataFrame) -> DataFrame:
    """windows with mechanism, scope, direction and the texts of a behaviour record: equal ids are repetition, one category persistence, the
    first category again at the end returning, else shifting."""
    cats = F.transform("interaction_sequence", lambda x: x["item_category"])
    e = evidence(F.col("interaction_sequence"))
    back = (F.size(cats) > 2) & (cats[0] == F.element_at(cats, -1)) & (F.size(F.array_distinct(cats)) > 1)
    pick = lambda a, b, c, d, z: F.when(e["all_same_item"], a).when(e["same_known_category"], b).when(back, c).when(F.size(cats) > 1, d).otherwise(z)
    d = windows.withColumns(
        {
            "mechanism": pick("repetition", "persistence", "returning", "shifting", "unknown"),
            "scope": pick("same item", "same broad category", "cross-category", "cross-category", "unknown"),
            "direction": pick("repeat", "stable", "return", "shift", "unknown"),
            "structural_evidence": e,
            "semantic_focus": F.slice(F.array_distinct(cats), 1, 8),
        }
    )
    sign = F.concat_ws(" ", F.lit("rule:"), "mechanism", F.lit("within"), "scope")
    text = F.concat(F.lit("Steps through "), F.array_join(cats, ", then "), F.lit("."))
    return d.withColumns({"trajectory_signature": sign, "behavior_explanation": text, "recommendation_behavior": sign, "parse_ok": F.lit(True)})


def history_text(sequence: Column) -> Column:
    return F.array_join(F.transform(sequence, lambda x, i: F.format_string("%d. %s [%s] %s", i + 1, x["item_name"], x["item_category"], x["action_type"])), "\n")


def extraction_prompt(sequence: Column) -> Column:
    return F.concat(F.lit("Items of one user in order:\n"), history_text(sequence), F.lit("\nDescribe how the preference moves, as JSON with mechanism, scope, direction and a short text."))


def ranking_prompt(history: Column, candidates: Column, evidence_: Column | None = None, labels: bool = False, domain: str = "items") -> Column:
    """The template of all ranking conditions: history, candidates (by id or by C01.. label), the tree's or the latest behaviour's evidence."""
    listed = F.array_join(F.transform(candidates, lambda c, i: F.format_string("C%02d: %s", i + 1, c) if labels else F.concat(F.lit("- "), c)), "\n")
    extra = F.coalesce(F.concat(F.lit("\nEvidence:\n"), evidence_), F.lit("")) if evidence_ is not None else F.lit("")
    return F.concat(F.lit(f"History of {domain}:\n"), history, extra, F.lit("\nCandidates:\n"), listed, F.lit("\nReturn all candidates, best first."))


def linking_prompt(new: Column, nearest: Column) -> Column:
    return F.concat(F.lit("New behavior:\n"), new, F.lit("\nNearest memories:\n"), nearest, F.lit("\nReturn the ids worth linking as a JSON list."))


def heuristic_ranking(scored: DataFrame, mode: str) -> DataFrame:
    """(user_id, mode, ranking): a deterministic ranker, candidates by score then position. At most a candidate list a user."""
    order = F.array_sort(F.collect_list(F.struct(F.negative(F.coalesce("score", F.lit(0.0))).alias("s"), "cand_pos", "item_id")))
    return scored.groupBy("user_id").agg(F.transform(order, lambda x: x["item_id"]).alias("ranking")).select("user_id", F.lit(mode).alias("mode"), "ranking")


def answered_by(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", batch: int = 8) -> DataFrame:
    """prompts with answer, error and elapsed_sec (of its batch): the model is called with batches of texts inside the workers. A batch that fails has
    empty answers and names its error; one that answers another number of texts has failed."""
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType()), StructField("elapsed_sec", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(b.schema.get_field_index(prompt)).to_pylist(), []
            for i in range(0, len(texts), batch):
                part, began = texts[i : i + batch], time.perf_counter()
                try:
                    said, error = list(model(part)), None
                    if len(said) != len(part):
                        raise ValueError(f"{len(said)} answers to {len(part)} prompts")
                except Exception as e:  # noqa: BLE001
                    said, error = [""] * len(part), f"{type(e).__name__}: {e}"
                out += [(x, error, time.perf_counter() - began) for x in said]
            cols = zip(*out, strict=True) if out else [[]] * 3
            yield pa.record_batch([*b.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True))], names=[*b.schema.names, "answer", "error", "elapsed_sec"])

    return prompts.mapInArrow(run, schema)


def call_log(answered: DataFrame, call_type: str, prompt: str = "prompt") -> DataFrame:
    """A tracking row a call, as the roll-ups read them: (call_id, call_type, input_tokens, output_tokens, elapsed_sec, parse_ok), sizes in words."""
    size = lambda c: F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))
    return answered.select(F.xxhash64(prompt, "answer").alias("call_id"), F.lit(call_type).alias("call_type"), size(F.col(prompt)).alias("input_tokens"), size(F.col("answer")).alias("output_tokens"), "elapsed_sec", F.col("error").isNull().alias("parse_ok"))


def encoded_by(df: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str, batch: int = 64) -> DataFrame:
    """df with `embedding array<double>` of unit length from an encoder (a model's place), called with batches of texts inside the workers; an encoder that fails
    fails the job, as a tree lacks no vector."""
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()], []
            for i in range(0, len(texts), batch):
                m = np.asarray(encoder(texts[i : i + batch]), np.float64)
                out += list(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def hashed_encoder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in encoder: words and pairs of words as signed hashed features. It reproduces no model."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for row, t in zip(out, texts, strict=True):
            ws = t.lower().split()
            for w in [*ws, *map(" ".join, zip(ws, ws[1:], strict=False))]:
                h = zlib.crc32(w.encode())
                row[h % dims] += 1 if h >> 31 else -1
        return out.tolist()

    return encode


#: what a ranker is told besides history and candidates, by condition: fixed values
CONDITIONS = ("tree", "latest_only", "native")


def ranking_conditions(candidates: DataFrame, histories: DataFrame, tree: DataFrame, latest: DataFrame, labels: bool = True, domain: str = "items") -> DataFrame:
    """(user_id, mode, prompt): of each user with candidates (user_id, candidates) one prompt a condition, alike but for the evidence: the tree's predicted
    states (user_id, rank, state_id, probability, mechanism, scope, direction), the latest behaviour (user_id, mechanism, scope, direction, trajectory_signature), or none.
    A user the tree or the latest behaviour knows nothing of has no evidence under that condition."""
    say = F.concat_ws("; ", F.concat(F.lit("next state "), F.col("state_id"), F.lit(" p="), F.format_number("probability", 4)), F.concat_ws(", ", "mechanism", "scope", "direction"))
    told = tree.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", say.alias("t")))), lambda x: x["t"]), "\n").alias("tree"))
    last = latest.select("user_id", F.concat_ws("; ", "mechanism", "scope", "direction", "trajectory_signature").alias("latest_only"))
    d = candidates.select("user_id", "candidates").join(histories.select("user_id", "history"), "user_id", "left").join(told, "user_id", "left").join(last, "user_id", "left")
    shown = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), (F.lit(None).cast("string") if m == "native" else F.col(m)).alias("evidence")) for m in CONDITIONS]))
    d = d.select("user_id", "candidates", F.coalesce("history", F.lit("")).alias("history"), shown.alias("x"))
    return d.select("user_id", "x.mode", ranking_prompt(F.col("history"), F.col("candidates"), F.col("x.evidence"), labels, domain).alias("prompt"))
