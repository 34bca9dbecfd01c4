"""Cosine top-k for a batch of query vectors.

The query batch is small next to the corpus, so the corpus stays where it is: every task multiplies
its Arrow batches with the query matrix, keeps k rows per query, and only those are shuffled. The
matrix is built from at most ``QUERY_BLOCK`` queries, a size that is checked; larger batches run as
further blocks, one corpus scan each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.access import apply_threshold, check_threshold, grants
from quarry.operators.blocks import CELLS_PER_STEP, QUERY_BLOCK, Best, by_blocks
from quarry.operators.skew import topk
from quarry.session import bounded, cut

_SCORES = "query_id string, chunk_id string, score double"


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, threshold: float = -1.0,
               include_below: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` chunks per query by cosine, then the threshold (so fewer than k can remain).

    ``queries``: query_id, embedding and, for access rules, tokens (see ``principal_tokens``).
    ``chunks``: chunk_id, embedding and, when queries carry tokens, the access columns. Scores are
    rounded to 12 digits; equal ones are ordered by chunk_id. Chunks without a usable vector are
    left out, see ``dense_rejects``.
    """
    check_threshold(threshold)
    ranked = _search(queries, chunks, k, query_block)
    return apply_threshold(ranked, threshold, include_below)


def dense_rejects(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks the search cannot score, with the reason."""
    squares = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x * x)
    reason = (F.when(F.col("embedding").isNull(), F.lit("NO_VECTOR"))
              .when(F.size("embedding") != dim, F.lit("DIMENSION"))
              .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), F.lit("NULL_VALUE"))
              .when(squares == 0, F.lit("ZERO_NORM")))
    return (chunks.select("chunk_id", reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


def build_ivf(chunks: DataFrame, n_cells: int, seed: int = 7,
              iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """(chunks with their ``cell``, cells with their centre) for ``ann_topk``.

    Centres are trained on all usable vectors and written to the work folder, so that a recomputed
    task sees the same ones; every chunk is then assigned to its nearest centre. Vectors of another
    than the usual dimension, with a null in them or of norm 0 are left out as in the exact search;
    ``dense_rejects`` has them with the reason.
    """
    sizes = chunks.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count()
    usual = sizes.orderBy(F.desc("count"), "dim").first()
    if usual is None:
        raise ValueError("no chunk has a vector")
    unit = _unit(chunks.filter(F.size("embedding") == usual["dim"]))
    model = KMeans(k=n_cells, seed=seed, maxIter=iterations, featuresCol="__unit",
                   predictionCol="cell").fit(unit)
    spark = chunks.sparkSession
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell int, embedding array<double>")
    assigned = model.transform(unit).drop("__unit")
    return assigned, cut(centres, "ivf-centres")


def _unit(df: DataFrame) -> DataFrame:
    squares = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x * x)  # null with a null in it
    length = F.sqrt(squares)
    scaled = F.transform("embedding", lambda x: x.cast("double") / length)
    return df.filter(squares > 0).withColumn("__unit", array_to_vector(scaled))


def ann_topk(queries: DataFrame, assigned: DataFrame, centres: DataFrame, k: int, nprobe: int,
             query_block: int = QUERY_BLOCK) -> DataFrame:
    """Cosine top-k inside the ``nprobe`` cells nearest to each query, scored exactly.

    With the chunks stored by cell the probe filter prunes files. A task scores each of its cells
    only with the queries that probe it, and a hot cell stays spread over its tasks.
    """
    cells = centres.select(F.col("cell").cast("string").alias("chunk_id"), "embedding")
    probes = _search(queries.select("query_id", "embedding"), cells, nprobe, query_block)
    probed = (probes.groupBy("query_id")
              .agg(F.collect_list(F.col("chunk_id").cast("int")).alias("probes")))
    wanted = probes.select(F.col("chunk_id").cast("int").alias("cell")).distinct()
    near = assigned.join(wanted, "cell", "left_semi")
    return _search(queries.join(probed, "query_id"), near, k, query_block)


def _search(queries: DataFrame, chunks: DataFrame, k: int, query_block: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    columns = [c for c in ("query_id", "embedding", "tokens", "probes") if c in queries.columns]
    batch = queries.select(*columns)
    return by_blocks(batch, query_block, lambda rows: score_rows(rows, columns, chunks, k), "dense")


def _usable(vector) -> bool:
    return bool(vector) and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def query_rejects(queries: DataFrame) -> DataFrame:
    """Queries that no search can score: without a vector, with a null in it or of norm 0."""
    fine = F.size("embedding") > 0
    fine &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return queries.filter(~F.coalesce(fine, F.lit(False))).select("query_id")


def score_rows(rows: list, columns: list[str], chunks: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks for a block of collected query rows."""
    by_dim: dict[int, list] = {}
    for row in rows:
        if _usable(row["embedding"]):
            by_dim.setdefault(len(row["embedding"]), []).append(row)
    if not by_dim:
        return chunks.sparkSession.createDataFrame([], _SCORES + ", rank int")
    return reduce(DataFrame.unionByName, [_best_in(x, columns, chunks, k) for x in by_dim.values()])


def _best_in(rows: list, columns: list[str], chunks: DataFrame, k: int) -> DataFrame:
    return topk(_score_block(rows, columns, chunks, k), ["query_id"],
                [F.desc("score"), F.asc("chunk_id")], k, spread_on="chunk_id")


def _score_block(rows: list, columns: list[str], chunks: DataFrame, k: int) -> DataFrame:
    ids = [str(r["query_id"]) for r in rows]
    dim = len(rows[0]["embedding"])
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1)
    matrix = (matrix / lengths[:, None]).T.copy()
    tokens = [frozenset(r["tokens"] or ()) for r in rows] if "tokens" in columns else None
    probes = [frozenset(r["probes"] or ()) for r in rows] if "probes" in columns else None

    scan = chunks.filter(F.size("embedding") == dim)
    picked = [F.col("chunk_id").cast("string").alias("chunk_id"),
              F.col("embedding").cast("array<double>").alias("embedding")]
    if tokens is not None:
        picked.append(grants().alias("grants"))
    if probes is not None:
        picked.append("cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            step = max(1, CELLS_PER_STEP // len(ids))
            for start in range(0, batch.num_rows, step):
                _score_rows(batch.slice(start, step), dim, matrix, tokens, probes, best)
        yield best.to_batch(ids)

    return bounded(scan.select(*picked)).mapInArrow(score, _SCORES)


def _score_rows(batch, dim, matrix, tokens, probes, best) -> None:
    chunk_ids = np.array(batch.column("chunk_id").to_pylist(), dtype=object)
    vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    vectors = vectors.reshape(-1, dim)
    whole = np.isfinite(vectors).all(axis=1)
    vectors = np.where(whole[:, None], vectors, 0.0)
    lengths = np.linalg.norm(vectors, axis=1)
    usable = whole & (lengths > 0)
    vectors = vectors / np.where(usable, lengths, 1.0)[:, None]
    scores = np.round(vectors @ matrix, 12) if probes is None else probed_scores(
        vectors, matrix, batch.column("cell").to_numpy(zero_copy_only=False), probes)
    scores[~usable] = -np.inf
    if tokens is not None:
        scores[~visible_rows(batch.column("grants"), tokens)] = -np.inf
    best.offer(scores, chunk_ids)


def probed_scores(vectors, matrix, cells, probes):
    """rows x queries: cosines where the query probes the row's cell, else minus infinity."""
    scores = np.full((len(vectors), matrix.shape[1]), -np.inf)
    for cell in np.unique(cells):
        rows = np.flatnonzero(cells == cell)
        wanted = [q for q, p in enumerate(probes) if int(cell) in p]
        if wanted:
            scores[np.ix_(rows, wanted)] = np.round(vectors[rows] @ matrix[:, wanted], 12)
    return scores


def visible_rows(grant_lists, tokens) -> np.ndarray:
    """rows x queries: does the chunk share a token with the query's principal?"""
    flat = grant_lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    sizes = np.array([0 if g is None else len(g) for g in grant_lists.to_pylist()])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    by_set: dict[frozenset, np.ndarray] = {}
    for held in set(tokens):
        hit = np.fromiter((n in held for n in names), dtype=bool, count=len(names))
        seen = np.concatenate(([0], np.cumsum(hit[codes]))) if len(codes) else np.zeros(1, int)
        by_set[held] = seen[ends] > seen[starts]
    return np.stack([by_set[held] for held in tokens], axis=1)


def centroids(vectors: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Mean vector per key, each coordinate rounded: (key, embedding).

    Coordinates are averaged with map-side partial sums, so a hot key costs no more than another.
    """
    parts = vectors.select(key, F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy(key, "at").agg(F.round(F.avg(F.col("x").cast("double")), digits)
                                         .alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))
