"""Beyond the batch pipeline: state transitions counted on a stream, and streamed appends that resume.

The stream carries assignments in about the order of time; rows up to a stated delay late are held back and put in their place. Kept for a user are
the rows that still wait and the last accepted state (or none after a rejection), so it doesn't grow with the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stepper():
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, window, ids, windows, states, oks, times = state.get if state.exists else (None, -1, [], [], [], [], [])
        waiting = {m: (int(w), m, s, bool(o), int(t)) for m, w, s, o, t in zip(ids, windows, states, oks, times, strict=True)}
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for d in batches:
                for r in d.itertuples():
                    if r.window_index > window:  # else its place has been given out: sent again, or later than the delay
                        waiting.setdefault(r.memory_id, (int(r.window_index), r.memory_id, r.state_id, bool(r.assignment_accepted), int(r.at.timestamp() * 1000)))
        out, rest = [], []
        for w, m, s, ok, t in sorted(waiting.values()):
            if rest or t > mark:  # a row waits for the watermark, and with it all rows behind it
                rest.append((m, w, s, ok, t))
                continue
            if ok and last is not None:
                out.append((key[0], w, last, s))
            last, window = s if ok else None, w
        cols = [list(c) for c in zip(*rest, strict=True)] if rest else [[], [], [], [], []]
        state.update((last, window, *cols))
        if rest:
            state.setTimeoutTimestamp(max(mark + 1, min(r[4] for r in rest)))
        yield pd.DataFrame(out, columns=["user_id", "window_index", "state_id", "next_state"])

    return step


_STATE = "last string, window int, ids array<string>, windows array<int>, states array<string>, oks array<boolean>, times array<bigint>"


def stream_transitions(assignments: DataFrame, late: str = "0 seconds", at: str = "assigned_at") -> DataFrame:
    """(user_id, window_index, state_id, next_state) of a streaming DataFrame of assignments: rejected memories break a segment.

    A row waits until the watermark, `late` behind the newest `at`, has passed it, and is then taken in order of its window; a memory sent again counts once.
    Rows that come after their place has been given out are dropped: how late they may be is `late`. What waits comes out as the stream goes on."""
    rows = assignments.select("user_id", "memory_id", "window_index", "state_id", F.coalesce("assignment_accepted", F.lit(False)).alias("assignment_accepted"), F.col(at).cast("timestamp").alias("at")).dropna()
    return rows.withWatermark("at", late).groupBy("user_id").applyInPandasWithState(_stepper(), "user_id string, window_index int, state_id string, next_state string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_calls(calls: DataFrame, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Calls and tokens a time window and type; rows later than `late` behind the newest are dropped by the watermark."""
    t = calls.withColumn("called_at", F.col("called_at").cast("timestamp")).withWatermark("called_at", late)
    return t.groupBy(F.window("called_at", size).alias("w"), "call_type").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens")).select(F.col("w.start").alias("start"), "call_type", "calls", "input_tokens")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A streaming append of JSON lines that resumes after its last batch; available rows, then stops."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
