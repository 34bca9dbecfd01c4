"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_chosen: dict[str, str] = {}

#: Bytes of an Arrow batch: the default of 10,000 rows can be very large with long texts.
BATCH_BYTES = 1 << 21


def get_session(app_name: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session: UTC, AQE with skew-join splitting, Arrow exchange with Python workers.

    Nothing here fixes cluster sizes; pass ``spark.sql.shuffle.partitions`` and memory through
    ``conf`` or spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or by ``use_work_dir`` where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _chosen.get(spark.conf.get("spark.app.id", ""))
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured


def use_work_dir(spark: SparkSession, path: str) -> None:
    """Name the shared folder of a session that was started without ``spark.checkpoint.dir``."""
    _chosen[spark.conf.get("spark.app.id", "")] = path


def use_own_dir(spark: SparkSession) -> None:
    """A new temporary folder, for a session of one machine that names none; others stay as they are."""
    own = spark.conf.get("spark.app.id", "") in _chosen or spark.conf.get("spark.checkpoint.dir", None)
    if not own and spark.conf.get("spark.master", "").split("[")[0] == "local":
        use_work_dir(spark, tempfile.mkdtemp(prefix="quarry-"))


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the work folder that no other call gets."""
    return f"{work_dir(spark).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so the plan (and recovery after a lost
    executor) restarts from files instead of from the whole lineage."""
    path = work_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` for a Python function, which gets batches of about ``BATCH_BYTES`` (or one row) at most.

    The session's bound is read when the rows are, so it is lowered for good, and said here.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", conf.get(name))[0]) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return rows
