"""Structured Streaming forms of the stateful operators (ST1-ST3).

The same functions take a batch or a stream. State is kept per key by Spark and
survives lost executors through the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURNS = "session string, pos long, used long, resets int"


def dialogue_state(turns: DataFrame, limit: int, idle: str | None = "1 hour") -> DataFrame:
    """Dialogue history of each session (ST1), turn by turn as they arrive.

    ``turns``: ``session``, ``pos``, ``value``. A history that would grow beyond
    ``limit`` characters is dropped first. A session's state is two numbers; it is
    forgotten after ``idle`` without a turn (never, if None: for runs over what is
    available, which a processing-time timeout would keep going). Turns of one trigger are taken in order
    of ``pos``; a null value has length 0.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, resets = state.get if state.exists else (0, 0)
        rows = []
        for pdf in sorted_batches(batches):
            for pos, value in zip(pdf["pos"], pdf["value"], strict=True):
                n = len(value) if isinstance(value, str) else 0
                if used + n > limit:
                    resets += used > 0
                    used = 0
                used += n
                rows.append((key[0], int(pos), int(used), int(resets)))
        state.update((int(used), int(resets)))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(rows, columns=["session", "pos", "used", "resets"])

    def sorted_batches(batches: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
        parts = list(batches)
        return [pd.concat(parts).sort_values("pos", kind="stable")] if parts else []

    keyed = turns.select(F.col("session").cast("string").alias("session"), F.col("pos").cast("long").alias("pos"), "value")
    return keyed.groupBy("session").applyInPandasWithState(run, TURNS, "used long, resets int", "append", GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout)


def running_accuracy(predictions: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """Accuracy so far per group (ST2); as a stream in update mode each trigger sends the groups that changed."""
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(correct, F.lit(False)).cast("int")).alias("n_correct")).withColumn("accuracy", F.try_divide(F.col("n_correct").cast("double"), F.col("n")))


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and group (ST3): tumbling, or sliding with ``slide``; later than ``late`` is dropped by a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return timed.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, at: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Events per session, a session ending after ``gap`` without one (ST3)."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
