"""An IVF index stored by cell, with quantised codes beside the vectors.

``write_ivf`` writes the chunks partitioned by cell: an 8-bit code of each vector, a bound of the
code's error, a digest of the vector, the vector and the other columns. ``ivf_topk`` reads the codes
of the probed cells only, keeps each chunk that the bounds leave among the best k, and scores those on
their vectors. Codes never decide: inside the probed cells the result is that of the exact search, in
every case, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import dense
from quarry.operators.access import grants
from quarry.operators.blocks import CELLS_PER_STEP, QUERY_BLOCK, by_blocks
from quarry.operators.skew import topk
from quarry.session import bounded, cut

ROWS_PER_FILE = 250_000
SLACK = 1e-9  # above the rounding of scores
_CODES = "code binary, scale double, bound double, same binary"
_FOUND = "query_id string, cell int, chunk_id string, same binary, low double, high double"


def write_ivf(chunks: DataFrame, path: str, n_cells: int, seed: int = 7, iterations: int = 10,
              rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the chunks by cell below ``path``, and the centres of the cells.

    Chunks without a usable vector are left out, see ``dense.dense_rejects``; an index of none
    raises ValueError. Rows are dealt by ranges of (cell, hash of the chunk id), so a cell with a
    third of all rows is written by a third of the tasks, and small cells share one.
    """
    assigned, centres = dense.build_ivf(chunks, n_cells, seed, iterations)
    files = max(1, -(-chunks.count() // rows_per_file))
    dealt = assigned.repartitionByRange(files, "cell", F.xxhash64("chunk_id"))
    at = assigned.columns.index("embedding")
    schema = T.StructType([*assigned.schema.fields, *T.StructType.fromDDL(_CODES).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _encode(batch.column(at)) if batch.num_rows else [[], [], [], []]
            kinds = (pa.binary(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(codes, kinds))],
                names=[*batch.schema.names, "code", "scale", "bound", "same"])

    bounded(dealt).mapInArrow(encode, schema).write.partitionBy("cell").parquet(f"{path}/chunks")
    centres.write.parquet(f"{path}/centres")


def _encode(column) -> tuple:
    """Codes, their scales, bounds of a cosine's error, and digests of the vectors."""
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    same = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    bound = np.linalg.norm(unit - code * scale[:, None], axis=1)  # queries have norm 1
    return [c.tobytes() for c in code], scale, bound + SLACK, same


def read_ivf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks by cell, centres) of an index that ``write_ivf`` wrote."""
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/centres")


def ivf_topk(queries: DataFrame, stored: DataFrame, centres: DataFrame, k: int, nprobe: int,
             query_block: int = QUERY_BLOCK) -> DataFrame:
    """Cosine top-k inside the ``nprobe`` cells nearest to each query, as ``dense.ann_topk`` gives it.

    ``queries``: query_id, embedding and, for access rules, tokens. A query without a usable vector of
    the index's dimension has no hits. Queries run in blocks; a block reads the folders of its cells.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    dim = len(centres.first()["embedding"])
    cells = centres.select(F.col("cell").cast("string").alias("chunk_id"), "embedding")
    probes = dense.dense_topk(queries.select("query_id", "embedding"), cells, nprobe,
                              query_block=query_block)
    probed = (probes.groupBy("query_id")
              .agg(F.collect_list(F.col("chunk_id").cast("int")).alias("probes")))
    columns = [c for c in ("query_id", "embedding", "tokens", "probes")
               if c in (*queries.columns, "probes")]
    batch = queries.join(probed, "query_id").filter(F.size("embedding") == dim).select(*columns)
    return by_blocks(batch, query_block, lambda rows: _best(rows, columns, stored, k), "ivf")


def probes_for(queries: DataFrame, stored: DataFrame, centres: DataFrame, k: int,
               recall: float = 0.95) -> int:
    """Smallest ``nprobe`` that finds a share ``recall`` of the exact top-k of these queries.

    The sample of queries (with tokens, if searches have them) is searched exactly over all chunks; a hit
    counts from the place of its cell in the query's order of cells. All cells, if there is no hit.
    """
    if not 0 < recall <= 1:
        raise ValueError("recall must be above 0 and at most 1")
    n_cells = centres.count()
    exact = dense.dense_topk(queries, stored, k).select("query_id", "chunk_id")
    place = stored.select(F.col("chunk_id").cast("string").alias("chunk_id"), "cell")
    cells = centres.select(F.col("cell").cast("string").alias("chunk_id"), "embedding")
    order = dense.dense_topk(queries.select("query_id", "embedding"), cells, n_cells).select(
        "query_id", F.col("chunk_id").cast("int").alias("cell"), "rank")
    found = dict(exact.join(place, "chunk_id").join(order, ["query_id", "cell"])
                 .groupBy("rank").count().collect())  # a row per cell at most
    hits, wanted = 0, recall * sum(found.values())
    for nprobe in sorted(found):
        hits += found[nprobe]
        if hits >= wanted:
            return nprobe
    return n_cells


def _best(rows: list, columns: list[str], stored: DataFrame, k: int) -> DataFrame:
    if not rows:
        return dense.score_rows([], columns, stored, k)
    near = in_cells(stored, {cell for r in rows for cell in r["probes"]})
    # a written table: its measured size decides whether Spark broadcasts it
    kept = cut(_candidates(rows, columns, near, k), "ivf-candidates")
    return dense.score_rows(rows, columns, near.join(kept, ["cell", "chunk_id"], "left_semi"), k)


def in_cells(stored: DataFrame, cells: set[int]) -> DataFrame:
    """The chunks of some cells; the filter prunes folders."""
    return stored.filter(F.col("cell").isin(sorted(cells)))


def _candidates(rows: list, columns: list[str], near: DataFrame, k: int) -> DataFrame:
    """(cell, chunk_id) of each chunk that can be among the best ``k`` of a query.

    A chunk is out if k others are surely better. Chunks with one vector are tied, so k of them, by
    chunk id, stand for all: a group of copies does not pass whole.
    """
    found = bounded(near).select(*_code_columns(columns)).mapInArrow(_bounds(rows, columns, k), _FOUND)
    found = topk(found, ["query_id", "same"], [F.asc("chunk_id")], k, spread_on="chunk_id").drop("rank")
    found = cut(found, "ivf-bounds")
    sure = topk(found, ["query_id"], [F.desc("low"), F.asc("chunk_id")], k, spread_on="chunk_id")
    floors = sure.filter(F.col("rank") == k).select("query_id", F.col("low").alias("floor"))
    left = found.join(floors, "query_id", "left")
    return left.filter("floor IS NULL OR high >= floor").select("cell", "chunk_id").distinct()


def _code_columns(columns: list[str]) -> list:
    picked = [F.col("chunk_id").cast("string").alias("chunk_id"), "cell", "code", "scale", "bound", "same"]
    return [*picked, grants().alias("grants")] if "tokens" in columns else picked


def _bounds(rows: list, columns: list[str], k: int):
    """Per query the chunks whose upper bound reaches the k-th best lower bound that the task saw."""
    ids = np.array([str(r["query_id"]) for r in rows], dtype=object)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    matrix = (matrix / np.linalg.norm(matrix, axis=1)[:, None]).T.copy()
    tokens = [frozenset(r["tokens"] or ()) for r in rows] if "tokens" in columns else None
    probes = [frozenset(r["probes"]) for r in rows]
    step = max(1, CELLS_PER_STEP // len(ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((k, len(ids)), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                low, high = _between(part, matrix, tokens, probes)
                best = np.partition(np.concatenate((best, low)), -k, axis=0)[-k:]
                at, q = np.nonzero((high >= best[0]) & (high > -np.inf))
                yield _first_of_each(part, at, q, ids, low, high, k)

    return scan


def _between(part, matrix, tokens, probes):
    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.int8)
    vectors = codes.reshape(part.num_rows, -1) * part.column("scale").to_numpy()[:, None]
    cells = part.column("cell").to_numpy(zero_copy_only=False)
    scores = dense.probed_scores(vectors, matrix, cells, probes)
    if tokens is not None:
        scores[~dense.visible_rows(part.column("grants"), tokens)] = -np.inf
    bound = part.column("bound").to_numpy()[:, None]
    return scores - bound, scores + bound


def _first_of_each(part, at, q, ids, low, high, k) -> pa.RecordBatch:
    names = part.column("chunk_id").to_numpy(zero_copy_only=False)[at]
    same = part.column("same").to_numpy(zero_copy_only=False)[at]
    found = pd.DataFrame({"q": q, "at": at, "chunk_id": names, "same": same})
    found = found.sort_values("chunk_id").groupby(["q", "same"], sort=False).head(k)
    q, at = found["q"].to_numpy(), found["at"].to_numpy()
    cells = part.column("cell").to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[q], pa.string()), pa.array(cells[at], pa.int32()),
         pa.array(found["chunk_id"], pa.string()), pa.array(found["same"], pa.binary()),
         pa.array(low[at, q], pa.float64()), pa.array(high[at, q], pa.float64())],
        names=["query_id", "cell", "chunk_id", "same", "low", "high"])
