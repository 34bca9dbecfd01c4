"""File readers: text corpora, images and evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as C
from quarry import schemas
from quarry.functions.text import content_type_norm, file_basename, has_text

TEXT_FILES = "\\.(txt|md|markdown)$"
RICH_FILES = "\\.(pdf|png|jpg|jpeg)$"
TEXT_TYPES = "^(text/plain|text/markdown|text/x-markdown)"
RICH_TYPES = "^(application/pdf|image/png|image/jpeg|image/jpg)"


def read_corpus(spark: SparkSession, path: str, glob: str = "*.{txt,md,markdown}",
                streaming: bool = False) -> DataFrame:
    """UTF-8 text files as document rows: filename, content_type, size, created_at, content."""
    reader = spark.readStream if streaming else spark.read
    files = (reader.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true"))
    if streaming:
        files = files.schema("path string, modificationTime timestamp, length bigint, "
                             "content binary")
    name = file_basename(F.regexp_replace("path", "%20", " "))
    suffix = F.lower(F.regexp_extract(name, TEXT_FILES, 1))
    kind = F.when(suffix == "txt", "text/plain").otherwise("text/markdown")
    return files.load(path).select(
        "path", name.alias("filename"), kind.alias("content_type"), F.col("length").alias("size"),
        F.col("modificationTime").alias("created_at"),
        F.decode("content", "UTF-8").alias("content"))


def is_supported(filename: Column, content_type: Column, multimodal: bool) -> Column:
    """By extension when there is a name, by content type otherwise."""
    name = F.lower(file_basename(filename))
    kind = content_type_norm(content_type)
    by_name, by_kind = name.rlike(TEXT_FILES), kind.rlike(TEXT_TYPES) | (
        kind == "application/octet-stream")
    if multimodal:
        by_name, by_kind = by_name | name.rlike(RICH_FILES), by_kind | kind.rlike(RICH_TYPES)
    return F.when(has_text(filename), by_name).otherwise(by_kind)


def route_files(df: DataFrame, multimodal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): names lose their folders, types are normalised, and rejected files
    carry an error code. ``df``: filename, content_type, size and anything else."""
    empty = F.coalesce(F.col("size"), F.lit(0)) <= 0
    supported = is_supported(F.col("filename"), F.col("content_type"), multimodal)
    code = (F.when(empty, F.lit("DOCUMENT_EMPTY_FILE"))
            .when(~supported, F.lit("DOCUMENT_UNSUPPORTED_TYPE")))
    marked = (df.withColumn("error_code", code)
              .withColumn("filename", file_basename("filename"))
              .withColumn("content_type", content_type_norm("content_type")))
    return (marked.filter("error_code IS NULL").drop("error_code"),
            marked.filter("error_code IS NOT NULL"))


def image_mime(filename: Column, content_type: Column) -> Column:
    kind = content_type_norm(content_type)
    return (F.when(kind.rlike("^image/(png|jpeg|jpg)"), kind)
            .when(F.lower(filename).endswith(".png"), F.lit("image/png"))
            .otherwise(F.lit("image/jpeg")))


def image_rows(images: DataFrame, index_offset: str = "text_chunks",
               data_url: bool = False) -> DataFrame:
    """One IMAGE chunk per image: id, caption, a reference made from its bytes, and the position
    after the document's text chunks.

    ``images``: document_id, version, filename, content_type, page, image_no (from 0 within the
    document), bytes and the number of text chunks.
    """
    index = (F.coalesce(F.col(index_offset), F.lit(0)) + F.col("image_no")).cast("int")
    page = F.when(F.col("page") > 0, F.format_string(C.PAGE_FORMAT, F.col("page"))).otherwise("")
    rows = (images.withColumn("chunk_index", index)
            .withColumn("chunk_id", F.concat(
                F.col("document_id"), F.lit("::image::v"), F.col("version").cast("string"),
                F.lit("::"), F.col("chunk_index").cast("string")))
            .withColumn("content", F.concat(F.lit(C.IMAGE_LABEL), F.col("filename"), page))
            .withColumn("modality", F.lit(C.IMAGE))
            .withColumn("image_ref", F.sha2("bytes", 256)))
    if data_url:
        mime = image_mime(F.col("filename"), F.col("content_type"))
        encoded = F.regexp_replace(F.base64("bytes"), "[\\r\\n]", "")
        rows = rows.withColumn("data_url", F.concat(
            F.lit("data:"), mime, F.lit(";base64,"), encoded))
    return rows.drop("bytes", "image_no", index_offset)


def read_eval_cases(spark: SparkSession, path: str, schema: str = schemas.EVAL_CASE) -> DataFrame:
    """JSON array of evaluation cases, questions or follow-up pairs (see ``schemas``)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
