"""Query batches of a checked size, and the best rows per query that a task has seen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

QUERY_BLOCK = 2048
CELLS_PER_STEP = 4_000_000  # scores held at a time by one task


def by_blocks(batch: DataFrame, limit: int, run: Callable[[list], DataFrame],
              name: str) -> DataFrame:
    """``run`` on the rows of a query batch, about half of ``limit`` at a time.

    A batch of any size takes the same way: blocks by hash of the query_id, so that uneven hashing
    stays under the limit and rows of one id stay together. One block at a time is in the driver, and
    its result is written before the next one is fetched.
    """
    batch = cut(batch, f"{name}-queries")
    count = max(1, -(-2 * batch.count() // limit))
    numbered = batch.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(count)))
    parts = []
    for number in range(count):
        rows = numbered.filter(F.col("__block") == number).drop("__block").collect()
        parts.append(cut(run(rows), f"{name}-{number}"))
    return reduce(DataFrame.unionByName, parts)


class Best:
    """Best k (score, chunk id) per query seen by one task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0) for _ in range(queries)]
        self.ids = [np.empty(0, dtype=object) for _ in range(queries)]

    def offer(self, scores: np.ndarray, chunk_ids: np.ndarray) -> None:
        for q in range(scores.shape[1]):
            column = scores[:, q]
            full = len(self.scores[q]) == self.k
            floor = self.scores[q][-1] if full else -np.inf
            rows = np.flatnonzero((column >= floor) & (column > -np.inf))
            if len(rows) > self.k:
                kth = np.partition(column[rows], len(rows) - self.k)[len(rows) - self.k]
                rows = rows[column[rows] >= kth]
            if not len(rows):
                continue
            merged = np.concatenate((self.scores[q], column[rows]))
            ids = np.concatenate((self.ids[q], chunk_ids[rows]))
            order = np.lexsort((ids.astype(str), -merged))[:self.k]
            self.scores[q], self.ids[q] = merged[order], ids[order]

    def to_batch(self, query_ids: list[str]) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        names = np.repeat(np.array(query_ids, dtype=object), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(names), pa.string()),
             pa.array([i for ids in self.ids for i in ids], pa.string()),
             pa.array(np.concatenate(self.scores), pa.float64())],
            names=["query_id", "chunk_id", "score"])
