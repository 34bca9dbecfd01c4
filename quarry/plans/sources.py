"""Queries that write and read back files derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import schemas
from quarry.plans import bindings as B
from quarry.plans.registry import query
from quarry.session import work_path
from quarry.sources import files as S
from quarry.sources.tables import append_usage, read_snapshot, write_snapshot


@query("read_corpus", """SELECT source, sum(length(text) + 1)::BIGINT AS chars,
    sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source""")
def read_corpus(spark, sf_dir):
    """Documents as text files in one folder per source, read back as a corpus."""
    path = work_path(spark, "corpus")
    B.table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(
        path)
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return S.read_corpus(spark, path).groupBy(source.alias("source")).agg(
        F.sum(F.length("content")).alias("chars"), F.sum("size").alias("bytes"))


_UPLOADS = """SELECT doc_id, n_chars, CASE doc_id % 6 WHEN 0 THEN 'C:\\dir\\' || source || '.md'
    WHEN 1 THEN source || '.TXT' WHEN 2 THEN 'x/' || source || '.pdf' WHEN 3 THEN source || '.exe' END
    AS filename, CASE doc_id % 5 WHEN 0 THEN 'text/plain; charset=utf-8' WHEN 1 THEN 'image/PNG'
    WHEN 2 THEN 'application/zip' END AS content_type FROM documents"""


@query("route_files", f"""SELECT doc_id, CASE WHEN filename IS NULL THEN 'unknown' ELSE
      regexp_replace(replace(filename, '\\', '/'), '^.*/', '') END AS filename,
      coalesce(lower(content_type), 'application/octet-stream') AS content_type,
      CASE WHEN n_chars <= 100 THEN 'DOCUMENT_EMPTY_FILE' WHEN NOT CASE WHEN filename IS NOT NULL
        THEN regexp_matches(lower(filename), '\\.(txt|md|pdf)$') ELSE content_type IS NULL OR
          doc_id % 5 < 2 END THEN 'DOCUMENT_UNSUPPORTED_TYPE' END AS error_code FROM ({_UPLOADS})""")
def route_files(spark, sf_dir):
    n = F.col("doc_id")
    name = (F.when(n % 6 == 0, F.concat(F.lit("C:\\dir\\"), "source", F.lit(".md")))
            .when(n % 6 == 1, F.concat("source", F.lit(".TXT")))
            .when(n % 6 == 2, F.concat(F.lit("x/"), "source", F.lit(".pdf")))
            .when(n % 6 == 3, F.concat("source", F.lit(".exe"))))
    kind = (F.when(n % 5 == 0, "text/plain; charset=utf-8").when(n % 5 == 1, "image/PNG")
            .when(n % 5 == 2, "application/zip"))
    size = F.when(F.col("n_chars") > 100, F.col("n_chars")).otherwise(0)
    uploads = B.table(spark, sf_dir, "documents").select(
        "doc_id", name.alias("filename"), kind.alias("content_type"), size.alias("size"))
    accepted, rejected = S.route_files(uploads, multimodal=True)
    return accepted.withColumn("error_code", F.lit(None).cast("string")).unionByName(
        rejected).drop("size")


@query("image_rows", """SELECT 'd' || doc_id || '::image::v1::' || (n_chars // 600 + doc_id % 3) AS chunk_id,
    (n_chars // 600 + doc_id % 3)::INT AS chunk_index, '[图片] ' || source || '.png' ||
      CASE WHEN doc_id % 4 > 0 THEN ' 第' || doc_id % 4 || '页' ELSE '' END AS content,
    'IMAGE' AS modality, sha256(text) AS image_ref,
    'data:image/png;base64,' || to_base64(encode(text)) AS data_url FROM documents""")
def image_rows(spark, sf_dir):
    n = F.col("doc_id")
    images = B.table(spark, sf_dir, "documents").select(
        B.tag("d", n).alias("document_id"), F.lit(1).alias("version"),
        F.concat("source", F.lit(".png")).alias("filename"), F.lit(None).cast("string")
        .alias("content_type"), (n % 4).cast("int").alias("page"),
        (n % 3).cast("int").alias("image_no"), F.encode("text", "UTF-8").alias("bytes"),
        F.floor(F.col("n_chars") / 600).cast("int").alias("text_chunks"))
    return S.image_rows(images, data_url=True).select(
        "chunk_id", "chunk_index", "content", "modality", "image_ref", "data_url")


@query("read_eval_cases", """SELECT 'b' || item_id AS case_id, text AS question, 2::BIGINT AS expected,
    'd' || item_id AS first FROM benchmark""")
def read_eval_cases(spark, sf_dir):
    """Benchmark texts as JSON arrays of cases, a bounded number per file, read back."""
    n = F.col("item_id")
    case = F.struct(B.tag("b", n).alias("caseId"), F.col("text").alias("question"),
                    F.array(B.tag("d", n), F.lit("x")).alias("expectedSourceDocumentIds"))
    path = work_path(spark, "cases")
    (B.table(spark, sf_dir, "benchmark").select(F.floor(n / 100).alias("block"), case.alias("case"))
     .groupBy("block").agg(F.to_json(F.collect_list("case")).alias("value"))
     .write.partitionBy("block").text(path))
    cases = S.read_eval_cases(spark, path, schemas.EVAL_CASE)
    return cases.select(F.col("caseId").alias("case_id"), "question",
                        F.size("expectedSourceDocumentIds").cast("long").alias("expected"),
                        F.col("expectedSourceDocumentIds")[0].alias("first"))


@query("append_usage", B.with_views("usage", """SELECT strftime(created_at, '%Y-%m-%d') AS usage_date,
    count(*) AS calls, sum(total_tokens)::BIGINT AS total_tokens,
    round(sum(estimated_cost)::DOUBLE, 6) AS estimated_cost FROM usage GROUP BY 1"""))
def append_ledger(spark, sf_dir):
    """The ledger written in two appends and read back per day."""
    usage = B.usage(spark, sf_dir)
    path = work_path(spark, "usage")
    append_usage(usage.filter("success"), path)
    append_usage(usage.filter("NOT success"), path)
    return spark.read.parquet(path).groupBy(F.col("usage_date").cast("string").alias(
        "usage_date")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"),
        F.round(F.sum("estimated_cost").cast("double"), 6).alias("estimated_cost"))


@query("snapshots", "SELECT doc_id, n_chars + doc_id AS n_chars FROM documents")
def snapshots(spark, sf_dir):
    """Two versions of a table; the newest is read."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    root = work_path(spark, "snapshots")
    write_snapshot(docs, root, 1)
    write_snapshot(read_snapshot(spark, root).withColumn("n_chars", F.col("n_chars") + F.col("doc_id")), root, 2)
    return read_snapshot(spark, root)
