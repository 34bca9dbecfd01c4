"""Rank fusion, reranking and the search modes over batches of queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators.access import (current_versions, filter_live, keep_current,
                                     permission_signature, principal_tokens)
from quarry.operators.dense import dense_topk
from quarry.operators.lexical import InvertedIndex, bm25_topk
from quarry.operators.models import Scorer, score_pairs
from quarry.operators.skew import topk

VECTOR, HYBRID, HYBRID_RERANK = "VECTOR", "HYBRID", "HYBRID_RERANK"


def rrf_fuse(lists: Sequence[DataFrame], k: int = C.RRF_K, limit: int = C.TOP_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; ties go to the earlier list, then its rank.

    Each list has query_id, chunk_id, rank. A union and one aggregation replace an outer join.
    """
    marked = [part.select("query_id", "chunk_id", "rank", F.lit(i).alias("list"))
              for i, part in enumerate(lists)]
    union = reduce(DataFrame.unionByName, marked)
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("list", "rank")).alias("__first"))
    order = [F.desc("score"), F.asc("__first"), F.asc("chunk_id")]
    return (topk(fused, ["query_id"], order, limit).drop("__first")
            .withColumn("included", F.lit(True))
            .withColumn("debug_info", F.format_string("rrf score=%.4f", "score")))


def rerank(candidates: DataFrame, scorer: Scorer | None, k: int, query: str = "query",
           content: str = "content", order_by: str = "score") -> DataFrame:
    """Reorder fused candidates by a scorer and keep ``k`` per query.

    Rows keep their fused score; ``rank`` is the new order. Without a scorer, or for a query whose
    scoring failed, the fused order stays in full; a scored query keeps the rows that got a score.
    ``order_by="score"`` re-sorts the kept rows by the fused
    score, which is how context is assembled; "rank" keeps the scorer's order.
    """
    if order_by not in ("score", "rank"):
        raise ValueError("order_by must be 'score' or 'rank'")
    fused = candidates.withColumnRenamed("rank", "fused_rank")
    if scorer is None:
        return topk(fused, ["query_id"], [F.asc("fused_rank")], k)
    scored = score_pairs(fused, scorer, query, content, group="query_id").withColumn(
        "relevance", F.when(~F.isnan("relevance"), F.col("relevance")))
    any_score = F.max("relevance").over(Window.partitionBy("query_id"))
    scored = (scored.withColumn("__any", any_score)
              .filter(F.col("relevance").isNotNull() | F.col("__any").isNull()).drop("__any"))
    order = [F.desc_nulls_last("relevance"), F.asc("fused_rank")]
    best = topk(scored, ["query_id"], order, k).withColumn(
        "debug_info", F.when(F.col("relevance").isNotNull(), F.lit("reranked"))
        .otherwise(F.col("debug_info")))
    if order_by == "rank":
        return best
    return topk(best.withColumnRenamed("rank", "rerank_rank"), ["query_id"],
                [F.desc("score"), F.asc("rerank_rank")], k)


def search(queries: DataFrame, chunks: DataFrame, mode: str = VECTOR, k: int = C.TOP_K,
           configured_k: int = C.TOP_K, recall_k: int = C.RECALL_TOP_K,
           threshold: float = C.SCORE_THRESHOLD, include_below: bool = False,
           scorer: Scorer | None = None, scope: str = "visible",
           index: InvertedIndex | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Permission-aware search for a batch of queries.

    ``queries``: query_id, text, embedding and the principal's columns (tenant_id, user_id,
    department_ids, role_ids). ``chunks``: chunks with access columns, content and embedding; rows
    that carry states must be live. With ``documents`` (document_id, status, current_version) they must
    also be of the current version. ``index``, a kept index of any earlier state of the chunks, saves
    reading the content of those that it holds; the result is that of the chunks as they are now (see
    ``InvertedIndex.current``). k is the smaller of the asked and the configured one. VECTOR applies the threshold;
    the hybrid modes ignore it, recall ``max(recall_k, k)`` per list, and fuse. Returns query_id,
    chunk_id, score, rank, included, debug_info.
    """
    if mode not in (VECTOR, HYBRID, HYBRID_RERANK):
        raise ValueError(f"unknown mode {mode}")
    k = min(k, configured_k)
    states = {c: None for c in ("status", "document_status") if c not in chunks.columns}
    chunks = filter_live(chunks, **states)
    if documents is not None:
        chunks = keep_current(chunks, current_versions(documents))
    vectors = queries.select("query_id", "embedding", principal_tokens().alias("tokens"))
    if mode == VECTOR:
        return dense_topk(vectors, chunks, k, threshold, include_below)
    recall = max(recall_k, k)
    reranking = mode == HYBRID_RERANK and scorer is not None
    dense = dense_topk(vectors, chunks, recall, threshold, include_below=True)
    asked = queries.select("query_id", "text", permission_signature().alias("signature"))
    corpus = chunks if index is None else index.current(chunks)
    lexical = bm25_topk(asked, corpus, recall, principals=queries, scope=scope)
    fused = rrf_fuse([dense, lexical], limit=recall if reranking else k)
    if not reranking:
        return fused
    # k-bounded candidates per query, so this side is the small one of the content join
    texts = chunks.select("chunk_id", "content")
    pairs = (fused.join(texts, "chunk_id")
             .join(queries.select("query_id", F.col("text").alias("query")), "query_id"))
    return rerank(pairs, scorer, k).select(
        "query_id", "chunk_id", "score", "rank", "included", "debug_info")
