"""From ranked results to a prompt context with citations. Groups are one query's top-k rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import limit_text, preview, token_estimate, utf16_length


def context_budget(question: Column | str, max_input_chars: int = C.MAX_INPUT_CHARS,
                   max_chars: int = C.MAX_CONTEXT_CHARS) -> Column:
    """min(max_chars, max(0, max_input_chars - question length - overhead))."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    used = F.coalesce(utf16_length(question), F.lit(0)) + C.PROMPT_OVERHEAD_CHARS
    return F.least(F.lit(max_chars), F.greatest(F.lit(0), F.lit(max_input_chars) - used))


def pack_context(results: DataFrame, parents: DataFrame | None = None,
                 max_chars: Column | int = C.MAX_CONTEXT_CHARS,
                 max_tokens: int = C.MAX_CONTEXT_TOKENS, order_by: str = "score") -> DataFrame:
    """Sections that fit the budgets, one row each: the sources of the answer, in context order.

    ``results``: query_id, chunk_id, document_id, filename, content, score, rank and, with
    ``parents`` (parent_id, content), parent_id: a hit then stands for its parent's body, the first
    hit per parent only. Sections are taken in order until one breaks a budget; lengths and tokens
    only add up, so that is a filter on running sums. ``section`` is the text, ``preview`` shows
    the child; other columns of the results (modality, image_ref) stay with their source. A missing
    filename or content is shown as such and keeps its place. ``truncated`` says whether a budget
    left sections of the query out.
    """
    order = [F.desc("score"), F.asc("rank")] if order_by == "score" else [F.asc("rank")]
    body = F.col("content")
    rows = results
    if parents is not None:
        rows = rows.join(parents.select("parent_id", F.col("content").alias("__parent")),
                         "parent_id", "left")
        once = F.coalesce(F.concat(F.lit("p"), "parent_id"), F.concat(F.lit("c"), "chunk_id"))
        first = Window.partitionBy("query_id", "__once").orderBy(*order)
        rows = (rows.withColumn("__once", once)
                .withColumn("__first", F.row_number().over(first)).filter("__first = 1")
                .drop("__once", "__first"))
        body = F.coalesce("__parent", "content")
    place = Window.partitionBy("query_id").orderBy(*order)
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]\n文件："),
                       F.coalesce("filename", F.lit(C.MISSING)), F.lit("\n内容："),
                       F.coalesce(body, F.lit(C.MISSING)), F.lit("\n\n"))
    budget = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    return (rows.withColumn("n", F.row_number().over(place))
            .withColumn("section", section)
            .withColumn("section_tokens", token_estimate("section"))
            .withColumn("used_chars", F.sum(utf16_length("section")).over(so_far))
            .withColumn("used_tokens", F.sum("section_tokens").over(so_far))
            .withColumn("__fits", (F.col("used_chars") <= budget) & (F.col("used_tokens") <= max_tokens))
            .withColumn("truncated", ~F.bool_and("__fits").over(Window.partitionBy("query_id")))
            .filter("__fits").withColumn("preview", preview("content")).drop("__parent", "__fits"))


def assemble_context(packed: DataFrame) -> DataFrame:
    """One row per query: context text, its size and the cited chunk ids in order."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "section", "chunk_id")))
    return packed.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["section"]), "").alias("context"),
        F.transform(ordered, lambda s: s["chunk_id"]).alias("source_chunk_ids"),
        F.sum("section_tokens").alias("context_tokens"),
        F.max("used_chars").alias("context_chars"))


def distinct_sources(results: DataFrame) -> DataFrame:
    """First row per (query, document, chunk) in rank order."""
    first = Window.partitionBy("query_id", "document_id", "chunk_id").orderBy("rank")
    kept = results.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return kept.withColumn("content", limit_text("content", C.CONTEXT_CHARS))


def source_summary(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: answerable, retrieved contexts, sources and distinct source documents."""
    contexts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"))
    sources = distinct_sources(results).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sources"), F.countDistinct("document_id").alias("documents"))
    zero = {"retrieved": 0, "sources": 0, "documents": 0}
    return (queries.select("query_id").join(contexts, "query_id", "left")
            .join(sources, "query_id", "left").fillna(zero)
            .withColumn("answerable", F.col("retrieved") > 0))


def answerability(queries: DataFrame, results: DataFrame, packed: DataFrame,
                  budget: Column) -> DataFrame:
    """Per query: may it be answered, and if not why (no hits, no budget, nothing packed)."""
    hits = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    used = packed.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
    counted = (queries.withColumn("budget", budget).join(hits, "query_id", "left")
               .join(used, "query_id", "left").fillna({"hits": 0, "used": 0}))
    reason = (F.when(F.col("hits") == 0, F.lit("NO_HITS"))
              .when(F.col("budget") <= 0, F.lit("NO_BUDGET"))
              .when(F.col("used") == 0, F.lit("NOTHING_PACKED")))
    return counted.select("query_id", "hits", "used", "budget", reason.isNull().alias("answerable"),
                          reason.alias("reason"))


def debug_chunks(results: DataFrame, packed: DataFrame) -> DataFrame:
    """All retrieved rows, marked when they made it into the context."""
    used = packed.select("query_id", "chunk_id", F.lit(True).alias("in_context")).distinct()
    return (results.join(used, ["query_id", "chunk_id"], "left")
            .withColumn("in_context", F.coalesce("in_context", F.lit(False)))
            .select("query_id", "rank", "chunk_id", "document_id", "score", "in_context",
                    preview("content").alias("preview")))
