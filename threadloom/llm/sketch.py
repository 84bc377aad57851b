"""Misra-Gries heavy hitters over a 64-bit key, mergeable across tasks.

Each task keeps ``k`` counters.  A counter is low by at most n/(k+1) after n values; a
task drops counters below n/(k+1) before it reports them, which loses as much again.  The
sums of the reports therefore miss no key with more than 3N/(k+1) of all N values, and at
most k+1 keys can reach N/(k+1): that bounds what the driver gets, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.held import held
from threadloom.workspace import materialize


class MisraGries:
    def __init__(self, k: int):
        self.k, self.n = k, 0
        self.waiting: list[np.ndarray] = []
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        """Count a block of int64 values at once; same bound as one at a time."""
        self.n += len(values)
        self.waiting.append(values)
        if sum(map(len, self.waiting)) >= 4 * self.k:
            self.settle()

    def settle(self) -> None:
        values, self.waiting = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.int64), []
        if not len(values):
            return
        keys, counts = np.unique(values, return_counts=True)
        if len(self.keys):
            both, where = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((self.counts, counts)), len(both)).astype(np.int64)
            keys = both
        if len(keys) > self.k:
            cut = np.partition(counts, len(counts) - self.k - 1)[len(counts) - self.k - 1]
            keep = counts > cut
            keys, counts = keys[keep], counts[keep] - cut
        self.keys, self.counts = keys, counts

    def report(self, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        keep = (self.counts * (self.k + 1) >= self.n) & (self.counts >= floor)
        return self.keys[keep], self.counts[keep]


def heavy_keys(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], k: int, floor: int = 1) -> np.ndarray:
    """At most k+1 keys, among them every one with over 3/(k+1) of all values.

    ``values`` turns an Arrow batch of ``df`` into blocks of int64 keys.  With a ``floor``, tasks
    report no counter below it: for callers to whom the keys are a hint, and tiny tasks many.
    """

    def count(batches):
        held(None)
        seen = MisraGries(k)
        for batch in batches:
            for block in values(batch):
                seen.add(block)
        keys, counts = seen.report(floor)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([seen.n], pa.int64())], names=["key", "n"])

    # a key of null carries the number of values; one grouped sum merges everything
    merged = materialize(df.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counters")
    total = merged.where("key is null").agg(F.sum("n")).first()[0] or 0
    rows = merged.where(F.col("key").isNotNull() & (F.col("n") * (k + 1) >= max(total, 1))).select("key").toPandas()
    return np.sort(rows["key"].to_numpy(np.int64))
