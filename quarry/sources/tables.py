"""Table writers: the usage ledger, evaluation samples and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import EVAL_SAMPLE


def append_usage(usage: DataFrame, path: str) -> None:
    """Append ledger rows, partitioned by day."""
    (usage.withColumn("usage_date", F.to_date("created_at"))
     .write.mode("append").partitionBy("usage_date").parquet(path))


def export_samples(rows: DataFrame, path: str) -> None:
    """Write one JSON line per (mode, case) for an outside judge.

    ``rows``: mode, case_id, question, rank, content, key, answer, reference and expected_keys; a
    case's rows are its top-k results. Empty contexts are dropped. ``doc_hit`` says whether any
    expected key was retrieved.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content", "key")))
    filled = F.filter(ordered, lambda r: F.coalesce(r["content"], F.lit("")) != "")
    samples = rows.groupBy("mode", "case_id", "question", "answer", "reference").agg(
        F.transform(filled, lambda r: r["content"]).alias("contexts"),
        F.first("expected_keys").alias("expected_keys"),
        F.transform(ordered, lambda r: r["key"]).alias("retrieved_keys"))
    hit = F.arrays_overlap(F.coalesce("expected_keys", F.array().cast("array<string>")), "retrieved_keys")
    samples = samples.withColumn("doc_hit", F.coalesce(hit, F.lit(False)))
    samples.write.mode("errorifexists").partitionBy("mode").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SAMPLE).json(path)


def write_snapshot(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """Write a table as an immutable version and then list it.

    A version is never replaced, so readers of older ones keep their files; one whose write failed
    is not listed.
    """
    path = f"{root.rstrip('/')}/data/v={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    listed = df.sparkSession.createDataFrame([(version,)], "version bigint").coalesce(1)
    listed.write.mode("append").parquet(f"{root.rstrip('/')}/versions")
    return path


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest listed one by default."""
    if version is None:
        versions = spark.read.schema("version bigint").parquet(f"{root.rstrip('/')}/versions")
        version = versions.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/data/v={version}")
