"""Corpus tables: upserts, deletes, versions, listings and ingest tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import has_text
from quarry.functions.tools import classify_error
from quarry.functions.vectors import format_vector
from quarry.operators.skew import hour_of, running, topk


def upsert_latest(target: DataFrame, updates: DataFrame, key: str, order_by: str) -> DataFrame:
    """Newest row per key of both tables by ``order_by``; an update wins a tie, blank keys go.

    Each task keeps one row per key before the shuffle, so many updates of one key stay cheap.
    """
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    named = both.filter(has_text(F.col(key).cast("string")))
    return topk(named, [key], [F.desc(order_by), F.desc("__new")], 1, "__rank").drop(
        "__new", "__rank")


def delete_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key columns are not listed: by chunk, by document or by (document, version)."""
    return target.join(keys.select(*on).distinct(), list(on), "left_anti")


def embedding_snapshot(chunks: DataFrame) -> DataFrame:
    """chunk_id and its vector as text."""
    return chunks.filter(F.col("embedding").isNotNull()).select(
        "chunk_id", format_vector("embedding").alias("vector"))


def list_documents(documents: DataFrame) -> DataFrame:
    """Registry, newest first."""
    return documents.orderBy(F.desc("created_at"), F.asc("document_id"))


def list_chunks(chunks: DataFrame, document_id: str,
                documents: DataFrame | None = None) -> DataFrame:
    """Chunks of one document by version and index; an id that the registry lacks is an error."""
    if documents is not None and documents.filter(F.col("document_id") == document_id).isEmpty():
        raise KeyError(f"unknown document {document_id}")
    return chunks.filter(F.col("document_id") == document_id).orderBy("version", "chunk_index")


def corpus_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, active chunks, their characters and the vector dimension."""
    one = F.lit(1).alias("one")
    docs = documents.agg(F.count(F.lit(1)).alias("documents")).withColumn("one", one)
    live = chunks.filter(F.col("status") == C.ACTIVE).agg(
        F.count(F.lit(1)).alias("active_chunks"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("total_chars"),
        F.coalesce(F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))), F.lit(0))
        .alias("vector_dimension")).withColumn("one", one)
    return docs.join(live, "one").drop("one")


def kb_version(mutations: DataFrame) -> DataFrame:
    """Adds ``kb_version`` after each mutation: 1 plus the mutations so far, over all documents."""
    run = running(mutations.withColumn("__all", F.lit(1)), ["__all"], ["ts", "mutation_id"],
                  hour_of("ts"), __n=("row_number", None))
    return run.withColumn("kb_version", F.col("__n") + 1).drop("__all", "__n")


def document_history(mutations: DataFrame) -> DataFrame:
    """Versions of each document: version, validity, status and chunk counts per mutation.

    ``mutations``: document_id, mutation_id, ts, kind (UPLOAD, UPDATE, DELETE), chunks. An upload or
    update opens the next version; the one before it, and everything on delete, becomes DELETED.
    """
    opens = F.when(F.col("kind") != "DELETE", 1).otherwise(0)
    made = F.when(F.col("kind") == "DELETE", 0).otherwise(F.col("chunks"))
    run = running(mutations.withColumn("__made", made), ["document_id"], ["ts", "mutation_id"],
                  hour_of("ts"), version=("sum", opens), valid_to=("lead", "ts"),
                  __before=("lag", "__made"))
    current = F.col("valid_to").isNull() & (F.col("kind") != "DELETE")
    return (run.withColumnRenamed("ts", "valid_from")
            .withColumn("current", current)
            .withColumn("status", F.when(current, F.lit(C.ACTIVE)).otherwise(F.lit(C.DELETED)))
            .withColumn("deactivated_chunks", F.coalesce("__before", F.lit(0)))
            .withColumn("new_chunks", F.col("__made")).drop("__before", "__made", "chunks"))


def latest_task_per_document(tasks: DataFrame) -> DataFrame:
    """Newest task of each document."""
    row = F.struct(*[c for c in tasks.columns if c != "document_id"])
    best = tasks.filter(has_text("document_id")).groupBy("document_id").agg(
        F.max_by(row, F.struct("created_at", "task_id")).alias("__row"))
    return best.select("document_id", "__row.*")


def stale_tasks(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """Tasks of known documents; one made for another version than the current is CANCELED."""
    registry = documents.select("document_id", "current_version")
    joined = tasks.join(registry, "document_id")
    stale = F.col("document_version") != F.col("current_version")
    return (joined.withColumn("status", F.when(stale, F.lit("CANCELED")).otherwise(
        F.col("status")))
        .withColumn("error_code", F.when(stale, F.lit("DOCUMENT_VERSION_STALE")).otherwise(
            F.col("error_code"))))


def task_backlog(tasks: DataFrame, at) -> DataFrame:
    """Due tasks at a time, numbered first in first out, and stuck ones with their code.

    A task is due when PENDING or RETRYING with no retry time after ``at``; stuck when RUNNING and
    locked for longer than the lock timeout, which makes it due at once.
    """
    now = F.lit(at).cast("timestamp")
    timeout = F.make_dt_interval(secs=F.lit(C.LOCK_TIMEOUT_SECONDS))
    stuck = (F.col("status") == "RUNNING") & (F.col("locked_at") < now - timeout)
    waiting = (F.col("status").isin("PENDING", "RETRYING")
               & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    due = tasks.filter(F.coalesce(stuck | waiting, F.lit(False))).select(
        "task_id", "document_id", "status", "created_at",
        F.when(F.coalesce(stuck, F.lit(False)), F.lit("INGEST_LOCK_TIMEOUT")).alias("error_code"))
    return running(due.withColumn("__all", F.lit(1)), ["__all"], ["created_at", "task_id"],
                   hour_of("created_at"), position=("row_number", None)).drop("__all")


def backlog_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


def retry_schedule(attempts: DataFrame, max_retry: int = C.MAX_RETRY) -> DataFrame:
    """Per failed attempt: retry number, whether another follows, its delay and the new status.

    ``attempts``: task_id, attempt_id, ts, error_code; ``max_retry`` counts retryable failures. The
    wait doubles from the base up to a maximum; an error that cannot be retried fails at once.
    """
    marked = attempts.withColumn("retryable", classify_error("error_code"))
    run = running(marked, ["task_id"], ["ts", "attempt_id"], hour_of("ts"),
                  retry_no=("sum", F.when(F.col("retryable"), 1).otherwise(0)))
    again = F.col("retryable") & (F.col("retry_no") < max_retry)
    exponent = F.least(F.greatest(F.col("retry_no") - 1, F.lit(0)), F.lit(30))
    delay = F.least(F.lit(C.RETRY_MAX_SECONDS).cast("double"),
                    C.RETRY_BASE_SECONDS * F.pow(F.lit(2.0), exponent)).cast("int")
    return (run.withColumn("delay_seconds", F.when(again, delay))
            .withColumn("next_status", F.when(again, F.lit("RETRYING")).otherwise(
                F.lit("FAILED"))))
