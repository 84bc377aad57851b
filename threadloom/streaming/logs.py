"""Structured Streaming forms: counts, round metrics, sessions and conversations as they arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def counts(messages: DataFrame) -> DataFrame:
    """Running messages per user, for update mode."""
    return messages.groupBy("user_id").agg(F.count("*").alias("n"))


def _timed(messages: DataFrame, late: str | None) -> DataFrame:
    """With ``ts`` as a timestamp; ``late`` bounds how late a message may be, None for no bound."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late else timed


def round_metrics(messages: DataFrame, width: str = "1 day", late: str | None = "2 hours") -> DataFrame:
    """Messages, people and conflict share of each window of event time: once it is closed, or so far where ``late`` is None."""
    conflict = F.col("action").isin("disagree", "revert", "counter_argue", "report", "block").cast("double")
    timed = _timed(messages, late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("people"), F.avg(conflict).alias("conflict_ratio"))


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of a user: closed after a gap without messages, or as far as they go where ``late`` is None."""
    timed = _timed(messages, late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def without_repeats(messages: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each message id once within the watermark."""
    return messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["msg_id"])


def conversations(messages: DataFrame) -> DataFrame:
    """Per conversation, its messages and people so far; the state is the people, not the texts."""

    def fold(key, batches, state):
        n, people = state.get if state.exists else (0, [])
        seen = set(people)
        for batch in batches:
            n += len(batch)
            seen.update(int(u) for u in batch["user_id"])
        state.update((n, sorted(seen)))
        yield pd.DataFrame({"thread_id": [key[0]], "n": [n], "people": [len(seen)]})

    return messages.groupBy("thread_id").applyInPandasWithState(fold, "thread_id long, n long, people long", "n long, people array<long>", "update", "NoTimeout")
