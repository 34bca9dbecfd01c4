"""Starting streams: file sources, sinks with checkpoints in the shared folder, state settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_parquet_stream(spark: SparkSession, folder: str, name: str,
                        files_per_trigger: int = 64) -> DataFrame:
    """Files of a folder that match ``name``, or those inside a folder of that name (a table is one or
    the other), as a stream. The trigger size bounds a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # only a pattern may stand for files and folders alike, so a plain name is written as one
    pattern = name if "*" in name else f"{name[:-1]}[{name[-1]}]"
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{pattern}"))


def start_parquet(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to parquet until the available input is used up; exactly once per checkpoint, which
    belongs to the path unless one is given."""
    location = checkpoint or f"{path.rstrip('/')}.checkpoint"
    return (df.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", location).trigger(availableNow=True).start(path))


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over the input that is there and read back what it wrote."""
    spark = df.sparkSession
    path = work_path(spark, name)
    start_parquet(df, path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_closed(df: DataFrame, name: str, close: Callable[[], None]) -> DataFrame:
    """Like ``run_available``; then ``close`` adds rows far ahead in time to the input, and a second run
    from the same checkpoint delivers what waited for the watermark."""
    spark = df.sparkSession
    path = work_path(spark, name)
    start_parquet(df, path).awaitTermination()
    close()
    start_parquet(df, path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """RocksDB state, and in a local session no more state partitions than its threads can use."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if spark.conf.get("spark.master", "").startswith("local"):
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted["spark.sql.shuffle.partitions"] = str(
            min(partitions, spark.sparkContext.defaultParallelism))
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
