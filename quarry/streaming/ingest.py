"""Continuous corpus build: documents in, chunk and vector deltas and a manifest out.

Each batch writes its chunks, parents and new vectors, and last its part of the manifest: one row per
document version that it saw, also where nothing came of it. Readers take a version's chunks from the
batch of its newest manifest row, so text that was emptied, deleted or replaced is gone, and a batch
that did not end is not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import constants as C
from quarry.operators.access import keep_current
from quarry.operators.chunking import chunk_documents, embedding_text
from quarry.operators.models import Embedder, Generator, embed_incremental
from quarry.session import cut
from quarry.sources.files import image_rows

DELETE = "DELETE"
#: States of a manifest row.
READY, FAILED, DELETED, CANCELED = C.READY, "FAILED", C.DELETED, "CANCELED"
_KEYS = ["document_id", "version"]
#: Columns of the input that say what to do and are not copied to chunks.
_CONTROL = ("kind", "images")


def stream_ingest(docs: DataFrame, target: str, embed_fn: Embedder, model: str,
                  checkpoint: str | None = None, size: int = C.CHUNK_SIZE,
                  overlap: int = C.CHUNK_OVERLAP, threshold: float = C.SEMANTIC_THRESHOLD,
                  order: str | None = None, registry: Callable[[], DataFrame] | None = None,
                  prefix_fn: Generator | None = None, image_fn: Embedder | None = None) -> StreamingQuery:
    """Chunk, identify and embed each micro-batch of documents into ``target``.

    ``docs``: document_id, version, content, strategy and metadata, and optionally

    * ``kind``: DELETE takes the version out, or, without a version, all versions seen before;
    * ``images``: array of (page int, bytes binary), each an IMAGE chunk after the text chunks; needs
      filename and content_type. ``image_fn`` embeds their data URLs, else their captions are embedded.

    Of several rows of one version in a batch the one with the largest ``order`` (a column; then of
    the largest content) counts; across batches the later batch counts. ``registry`` gives the
    versions that are current (document_id, version): others are CANCELED, whether they are stale when
    the batch begins or become so while it runs. With ``prefix_fn`` the embedded text is that of
    ``embedding_text``. A version without a chunk is FAILED.

    A batch writes only its own rows, below ``batch=N``, replacing what an earlier try of the same
    batch left, so nothing is written twice and the cost of chunks follows the input. Texts and, for
    the SEMANTIC strategy, sentences that earlier batches embedded are looked up in
    ``target/vectors``. The checkpoint belongs to the target unless one is given, so a second run goes
    on where the first ended. ``latest_chunks`` and ``latest_manifest`` read the result.
    """
    def ingest(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.col(order) if order else F.lit(0)
        rows = _one_row_per_version(batch.withColumn("__place", place))
        deleted = F.coalesce(F.upper("kind") == DELETE, F.lit(False)) if "kind" in batch.columns else F.lit(False)
        asked = rows.filter(~deleted)
        if registry is not None:
            asked = keep_current(asked, registry())

        cache = _vectors(spark, target, number)
        made = [cache]

        def embed(sentences: DataFrame) -> DataFrame:
            vectors, new = embed_incremental(sentences, cache, model, embed_fn, "sentence")
            made.append(new)
            return vectors

        whole = asked.drop("__place", *_CONTROL)
        children, parents = chunk_documents(whole, size=size, overlap=overlap, threshold=threshold, embed=embed)
        asked_text = "content"
        if prefix_fn is not None:
            children, asked_text = embedding_text(children, parents, whole, prefix_fn), "embedding_text"
        children = cut(children, "children")  # read for their vectors, their number and themselves
        known = reduce(DataFrame.unionByName, made)
        embedded, added = embed_incremental(children, known, model, embed_fn, asked_text)
        made.append(added)
        if "images" in batch.columns:
            pictures, added = _images(asked, children, cache, model, embed_fn, image_fn)
            made.append(added)
            embedded = embedded.withColumn("modality", F.lit(C.TEXT)).unionByName(pictures, allowMissingColumns=True)
        _replace(reduce(DataFrame.unionByName, made[1:]), f"{target}/vectors/batch={number}")
        _replace(embedded.drop("text_hash"), f"{target}/chunks/batch={number}")
        _replace(parents, f"{target}/parents/batch={number}")

        counts = (spark.read.schema(embedded.drop("text_hash").schema).parquet(f"{target}/chunks/batch={number}")
                  .groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("chunks")))
        seen = rows.select(*_KEYS, F.col("__place").alias("place"), deleted.alias("__deleted")).join(counts, _KEYS, "left")
        current = F.lit(True)
        if registry is not None:  # asked again: it may have moved on
            seen = seen.join(registry().select(*_KEYS, F.lit(True).alias("__current")).distinct(), _KEYS, "left")
            current = F.coalesce("__current", F.lit(False))
        _replace(seen.select(*_KEYS, "place", *_state(F.col("__deleted"), current)), f"{target}/manifest/batch={number}")

    return (docs.writeStream.foreachBatch(ingest)
            .option("checkpointLocation", checkpoint or f"{target}/_checkpoint")
            .trigger(availableNow=True).start())


def _state(deleted: Column, current: Column) -> list[Column]:
    chunks = F.coalesce("chunks", F.lit(0))
    state = (F.when(deleted, DELETED).when(~current, CANCELED)
             .when(chunks == 0, FAILED).otherwise(READY))
    code = (F.when(deleted, None).when(~current, "DOCUMENT_VERSION_STALE")
            .when(chunks == 0, "DOCUMENT_EMPTY_FILE"))
    kept = F.when(deleted | ~current, 0).otherwise(chunks)
    return [state.alias("state"), code.alias("error_code"), kept.cast("long").alias("chunks")]


def _one_row_per_version(batch: DataFrame) -> DataFrame:
    """Only rows whose version comes more than once are shuffled with their texts."""
    keys = batch.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    repeated = cut(keys.filter("n > 1").select(*_KEYS), "repeated-versions")
    if repeated.isEmpty():
        return batch
    same = [batch[k].eqNullSafe(repeated[k]) for k in _KEYS]
    rest = [c for c in batch.columns if c not in _KEYS]
    newest = (batch.join(repeated, same, "left_semi").groupBy(*_KEYS)
              .agg(F.max_by(F.struct(*rest), F.struct("__place", "content")).alias("__row"))
              .select(*_KEYS, "__row.*"))
    return batch.join(repeated, same, "left_anti").unionByName(cut(newest, "newest-versions"))


def _images(asked: DataFrame, children: DataFrame, cache: DataFrame, model: str, embed_fn: Embedder,
            image_fn: Embedder | None) -> tuple[DataFrame, DataFrame]:
    """(IMAGE chunks with their vectors, vectors to add)."""
    meta = [c for c in asked.columns if c not in ("content", "strategy", "__place", *_CONTROL)]
    before = children.groupBy(*_KEYS).agg(F.count(F.lit(1)).cast("int").alias("text_chunks"))
    each = (asked.select(*meta, F.posexplode("images").alias("image_no", "__image"))
            .select(*meta, "image_no", "__image.page", "__image.bytes").filter("bytes is not null"))
    rows = image_rows(each.join(before, _KEYS, "left"), data_url=image_fn is not None)
    rows = rows.withColumn("content_hash", F.col("image_ref"))
    text, fn, name = ("data_url", image_fn, f"{model}/image") if image_fn else ("content", embed_fn, model)
    vectors, added = embed_incremental(rows, cache, name, fn, text)
    return vectors.drop("data_url", "text_hash"), added


def _vectors(spark: SparkSession, target: str, before: int) -> DataFrame:
    """Vectors made by earlier batches; a repeated batch does not see its own."""
    schema = "model string, text_hash string, embedding array<double>"
    if before == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{target}/vectors")
    return rows.filter(F.col("batch") < before).drop("batch")


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def latest_manifest(spark: SparkSession, target: str) -> DataFrame:
    """document_id, version, batch, state (READY, FAILED, DELETED, CANCELED), error_code and chunks of
    every version that was seen, by the newest batch that saw it. A deletion of the whole document
    outdates what stands before it, by batch and, in one batch, by place (at a tie the deletion)."""
    rows = spark.read.parquet(f"{target}/manifest")
    when = F.struct("batch", "place")
    gone = (rows.filter("version is null").groupBy("document_id")
            .agg(F.max(when).alias("__gone")))
    newest = (rows.filter("version is not null").groupBy(*_KEYS)
              .agg(F.max_by(F.struct("batch", "place", "state", "error_code", "chunks"), "batch").alias("__row"))
              .select(*_KEYS, "__row.*"))
    joined = newest.join(gone, "document_id", "left")
    dead = F.coalesce(when <= F.col("__gone"), F.lit(False))
    return joined.select(
        *_KEYS, "batch", F.when(dead, DELETED).otherwise(F.col("state")).alias("state"),
        F.when(~dead, F.col("error_code")).alias("error_code"),
        F.when(dead, 0).otherwise(F.col("chunks")).cast("long").alias("chunks"))


def _latest(spark: SparkSession, target: str, kind: str, registry: DataFrame | None) -> DataFrame:
    ready = latest_manifest(spark, target).filter(F.col("state") == READY).select(*_KEYS, "batch")
    rows = spark.read.option("mergeSchema", True).parquet(f"{target}/{kind}")
    newest = rows.join(ready, [*_KEYS, "batch"], "left_semi")
    return newest if registry is None else keep_current(newest, registry)


def latest_chunks(spark: SparkSession, target: str, registry: DataFrame | None = None) -> DataFrame:
    """Chunks of each READY document version as its newest batch left them. With a registry
    (document_id, version) only current versions."""
    return _latest(spark, target, "chunks", registry)


def latest_parents(spark: SparkSession, target: str, registry: DataFrame | None = None) -> DataFrame:
    """The same of the parent sections."""
    return _latest(spark, target, "parents", registry)
