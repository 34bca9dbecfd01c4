"""Queries for chunking, corpus tables and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunking as K
from quarry.operators import corpus as O
from quarry.operators.models import embed_incremental
from quarry.plans import bindings as B
from quarry.plans.registry import query
from quarry.plans.text import sql_strip

_DOCS = ("SELECT doc_id::VARCHAR AS document_id, (1 + doc_id % 3)::INT AS version, "
         "text AS content FROM documents")


def documents(spark, sf_dir):
    n = F.col("doc_id")
    return B.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("document_id"), (1 + n % 3).cast("int").alias("version"),
        F.col("text").alias("content"))


def sql_windows(source: str, size: int = 600, overlap: int = 100) -> str:
    """Rows (document_id, version, at, content) of the windows of column t."""
    step = size - overlap
    return (f"SELECT document_id, version, i AS chunk_index, "
            f"substring(t, (i * {step} + 1)::INT, {size}) AS content FROM (SELECT *, "
            f"unnest(range(0, 1 + greatest(0, ceil((length(t) - {size}) / {step}.0))::BIGINT)) AS i "
            f"FROM {source} WHERE t <> '')")


_IDENTITY = """document_id || '-v' || version || '-c' || chunk_index || '-' ||
    left(sha256(content), 16)"""


@query("chunk_fixed", f"""WITH docs AS ({_DOCS}), texts AS (SELECT document_id, version,
      {sql_strip('content')} AS t FROM docs), cut AS ({sql_windows('texts')})
    SELECT document_id, version, chunk_index::INT AS chunk_index, content, sha256(content) AS content_hash,
      {_IDENTITY} AS chunk_id FROM cut""")
def chunk_fixed(spark, sf_dir):
    return K.with_chunk_identity(K.chunk_fixed(documents(spark, sf_dir)))


_LINES = """SELECT document_id, version, n, line, regexp_extract(line, '^(#{1,6})\\s+(.*)\\z', 1) AS marks,
      STRIP(regexp_extract(line, '^(#{1,6})\\s+(.*)\\z', 2)) AS title FROM (
    SELECT document_id, version, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (
      SELECT *, string_split(content, chr(10)) AS lines FROM pages_markdown
      WHERE regexp_matches(content, '\\S')))""".replace(
    "STRIP(regexp_extract(line, '^(#{1,6})\\s+(.*)\\z', 2))",
    sql_strip("regexp_extract(line, '^(#{1,6})\\s+(.*)\\z', 2)"))

# a heading is open in a section when no later heading up to the section has its level or a smaller one
_SECTIONS = f"""SELECT document_id, version, section, {sql_strip("string_agg(CASE WHEN marks = '' THEN line END, chr(10) ORDER BY n)")} AS body
    FROM (SELECT *, sum(CASE WHEN marks <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY n)
      AS section FROM lines) GROUP BY ALL"""
_HEADS = """SELECT document_id, length(marks) AS level, title,
      row_number() OVER (PARTITION BY document_id ORDER BY n) AS pos FROM lines WHERE marks <> ''"""
_PATHS = """SELECT s.document_id, s.section, array_to_string(list(h.title ORDER BY h.pos), ' > ') AS path
    FROM (SELECT DISTINCT document_id, section FROM sections) s JOIN heads h
      ON h.document_id = s.document_id AND h.pos <= s.section
    WHERE NOT EXISTS (SELECT 1 FROM heads l WHERE l.document_id = h.document_id AND l.pos > h.pos
      AND l.pos <= s.section AND l.level <= h.level) GROUP BY ALL"""
_KEPT = """SELECT s.document_id, s.version, row_number() OVER (PARTITION BY s.document_id ORDER BY s.section)
      - 1 AS section_index, coalesce(p.path, '') AS path, s.body
    FROM sections s LEFT JOIN paths p ON p.document_id = s.document_id AND p.section = s.section
    WHERE coalesce(s.body, '') <> ''"""
_MARKDOWN = {"lines": _LINES, "sections": _SECTIONS, "heads": _HEADS, "paths": _PATHS, "kept": _KEPT}


@query("markdown_sections", B.with_views("pages_markdown", """SELECT document_id, section_index::INT AS
    section_index, path, body, document_id || '-v' || version || '-p' || section_index AS parent_id
    FROM kept""", **_MARKDOWN))
def markdown_sections(spark, sf_dir):
    rows = K.with_parent_id(K.markdown_sections(B.pages_markdown(spark, sf_dir)))
    return rows.select("document_id", "section_index",
                       F.array_join("headings", " > ").alias("path"), "body", "parent_id")


@query("chunk_markdown", B.with_views("pages_markdown", f"""SELECT document_id, section_index::INT AS section_index,
      (row_number() OVER (PARTITION BY document_id ORDER BY section_index, chunk_index) - 1)::INT
        AS chunk_index, CASE WHEN path = '' THEN '' ELSE '标题：' || path || chr(10) END || content AS content
    FROM (SELECT w.*, k.section_index, k.path FROM ({sql_windows(
        "(SELECT parent AS document_id, version, body AS t FROM (SELECT *, document_id || ':' || section_index AS parent FROM kept))",
        200, 40)}) w JOIN (SELECT *, document_id || ':' || section_index AS parent FROM kept) k ON w.document_id = k.parent)"""
    .replace("SELECT document_id, section_index::INT", "SELECT split_part(document_id, ':', 1) AS document_id, section_index::INT")
    .replace("PARTITION BY document_id ORDER BY section_index, chunk_index",
             "PARTITION BY split_part(document_id, ':', 1) ORDER BY section_index, chunk_index"), **_MARKDOWN))
def chunk_markdown(spark, sf_dir):
    return K.chunk_markdown(B.pages_markdown(spark, sf_dir), 200, 40).select(
        "document_id", "section_index", "chunk_index", "content")


_SENTENCES = f"""SELECT document_id, version, list_filter(list_transform(regexp_extract_all(content,
      '[^。！？!?\\n]*[。！？!?]|[^。！？!?\\n]+'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS s
    FROM docs"""


@query("split_sentences", f"""WITH docs AS ({_DOCS}), found AS ({_SENTENCES})
    SELECT document_id, (generate_subscripts(s, 1) - 1)::INT AS sentence_index, unnest(s) AS sentence
    FROM found""")
def split_sentences(spark, sf_dir):
    return K.split_sentences(documents(spark, sf_dir)).drop("version")


LETTERS = "aeinrst"
THRESHOLD = 0.93


def letter_counts(texts):
    """An embedder that SQL can say too."""
    return [[float(t.count(c)) for c in LETTERS] for t in ((t or "").lower() for t in texts)]


_LETTER_SQL = "[" + ", ".join(f"(length(s) - length(replace(lower(s), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


def sql_semantic(docs: str) -> str:
    """Rows (document_id, version, chunk_index, content, sentences) of the semantic chunks of ``docs``."""
    found = _SENTENCES.replace("FROM docs", f"FROM {docs}")
    return f"""SELECT document_id, version, part::INT AS chunk_index, string_agg(s, '' ORDER BY i) AS content,
        count(*) AS sentences FROM (
      SELECT *, sum(CASE WHEN i > 1 AND near < {THRESHOLD} THEN 1 ELSE 0 END) OVER w AS part FROM (
        SELECT *, coalesce(CASE WHEN list_sum(v) > 0 AND list_sum(lag(v) OVER w) > 0
          THEN list_cosine_similarity(v, lag(v) OVER w) END, 0) AS near FROM (
          SELECT document_id, version, i, s, {_LETTER_SQL} AS v FROM (
            SELECT document_id, version, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM ({found})))
        WINDOW w AS (PARTITION BY document_id, version ORDER BY i))
      WINDOW w AS (PARTITION BY document_id, version ORDER BY i)) GROUP BY document_id, version, part"""


# a second version of every document, with its lines in the opposite order
_TWO_VERSIONS = """SELECT doc_id::VARCHAR AS document_id, 1 AS version, text AS content FROM documents UNION ALL
    SELECT doc_id::VARCHAR, 2, array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) FROM documents"""


def two_versions(docs):
    """documents rows (a batch or a stream) as version 1 and version 2."""
    turned = F.array_join(F.reverse(F.split("text", "\n", -1)), "\n")
    both = F.explode(F.array(F.struct(F.lit(1).alias("version"), F.col("text").alias("content")),
                             F.struct(F.lit(2).alias("version"), turned.alias("content"))))
    return docs.select("doc_id", both.alias("v")).select(
        F.col("doc_id").cast("string").alias("document_id"), "v.version", "v.content")


@query("chunk_semantic", f"WITH docs AS ({_TWO_VERSIONS}) {sql_semantic('docs')}")
def chunk_semantic(spark, sf_dir):
    docs = two_versions(B.table(spark, sf_dir, "documents"))
    return K.chunk_semantic(_embedded(spark, K.split_sentences(docs)), THRESHOLD)


def _embedded(spark, sents):
    """Sentences with vectors; equal sentences are embedded once."""
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    return embed_incremental(sents, cache, "letters", letter_counts, "sentence")[0]


def strategy_views(source: str, semantic: str) -> dict[str, str]:
    """Views of the chunks of ``source``: semantic ones where that holds, windows for the others."""
    return {
        f"{source}_fixed": f"SELECT document_id, version, {sql_strip('content')} AS t FROM {source} WHERE NOT ({semantic})",
        f"{source}_sem": f"SELECT * FROM {source} WHERE {semantic}",
        f"{source}_chunks": f"""SELECT document_id, version, chunk_index::INT AS chunk_index, content
            FROM ({sql_windows(source + '_fixed')}) UNION ALL
          SELECT document_id, version, chunk_index, content FROM ({sql_semantic(source + '_sem')})"""}


_PAGE_CHUNKS = """SELECT 'page-' || document_id AS document_id, version, (row_number() OVER (PARTITION BY document_id
      ORDER BY section_index, i) - 1)::INT AS chunk_index, content,
      'page-' || document_id || '-v' || version || '-p' || section_index AS parent_id FROM children"""
_CHILDREN = f"""SELECT k.document_id, k.version, k.section_index, k.body, w.chunk_index AS i,
      CASE WHEN k.path = '' THEN '' ELSE '标题：' || k.path || chr(10) END || w.content AS content
    FROM ({sql_windows("(SELECT parent AS document_id, version, body AS t FROM parts)")}) w
    JOIN parts k ON k.parent = w.document_id"""
_PARTS = "SELECT *, document_id || ':' || section_index AS parent FROM kept"


@query("chunk_documents", B.with_views("pages_markdown", f"""SELECT {_IDENTITY} AS chunk_id, document_id, version,
      chunk_index, parent_id, sha256(content) AS content_hash FROM (
      SELECT document_id, version, chunk_index, content, NULL AS parent_id FROM docs_chunks
      UNION ALL SELECT document_id, version, chunk_index, content, parent_id FROM page_chunks)""",
    **_MARKDOWN, parts=_PARTS, children=_CHILDREN, page_chunks=_PAGE_CHUNKS, docs=_TWO_VERSIONS,
    **strategy_views("docs", "document_id::BIGINT % 3 = 1")))
def chunk_documents(spark, sf_dir):
    docs = two_versions(B.table(spark, sf_dir, "documents")).withColumn(
        "strategy", B.pick(("FIXED", "SEMANTIC", "other"), F.col("document_id").cast("long")))
    pages = B.pages_markdown(spark, sf_dir).select(
        F.concat(F.lit("page-"), "document_id").alias("document_id"), "version", "content",
        F.lit("markdown").alias("strategy"))
    children, _ = K.chunk_documents(docs.unionByName(pages), threshold=THRESHOLD,
                                    embed=lambda s: _embedded(spark, s))
    return children.select("chunk_id", "document_id", "version", "chunk_index", "parent_id",
                           "content_hash")


# every document as two rows of one key, with unlike texts, and every fourth one a third time
_TWICE = """SELECT doc_id || '#' || k AS document_id, 1 AS version, CASE k WHEN 1 THEN 'Other. ' || text ELSE text END AS content
    FROM documents, (VALUES (0), (1), (2)) AS t(k) WHERE k < 2 OR doc_id % 4 = 0"""


@query("chunk_repeated_keys", B.with_views("", f"""SELECT {_IDENTITY} AS chunk_id, document_id, chunk_index FROM (
      SELECT split_part(document_id, '#', 1) AS document_id, version, chunk_index, content FROM twice_chunks)""",
    twice=_TWICE, **strategy_views("twice", "split_part(document_id, '#', 1)::BIGINT % 2 = 1")))
def chunk_repeated_keys(spark, sf_dir):
    """Rows that share document_id and version."""
    n, text = F.col("doc_id"), F.col("text")
    texts = F.when(n % 4 == 0, F.array(text, F.concat(F.lit("Other. "), text), text)).otherwise(
        F.array(text, F.concat(F.lit("Other. "), text)))
    docs = B.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("document_id"), F.lit(1).alias("version"), F.explode(texts).alias("content"),
        F.when(n % 2 == 1, "SEMANTIC").otherwise("FIXED").alias("strategy"))
    children, _ = K.chunk_documents(docs, threshold=THRESHOLD, embed=lambda s: _embedded(spark, s))
    return children.select("chunk_id", "document_id", "chunk_index")


@query("embedding_text", B.with_views("pages_markdown", f"""SELECT {_IDENTITY} AS chunk_id,
      sha256(content) AS content_hash,
      {sql_strip("right(left(body, 8000) || chr(10) || content, 900)")} || chr(10) || content AS embedding_text
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_index, i) - 1 AS chunk_index
      FROM children)""", **_MARKDOWN, parts=_PARTS, children=_CHILDREN))
def embedding_text(spark, sf_dir):
    pages = B.pages_markdown(spark, sf_dir).withColumn("strategy", F.lit("MARKDOWN"))
    children, parents = K.chunk_documents(pages)
    docs = pages.select("document_id", "version", "content")
    made = K.embedding_text(children, parents, docs, lambda prompt: prompt[-900:])
    return made.select("chunk_id", "content_hash", "embedding_text")


# ---- corpus tables ------------------------------------------------------------------------------

_UPSERT = """SELECT document_id, mutation_id, kind, chunks FROM mutations QUALIFY row_number() OVER (
    PARTITION BY document_id ORDER BY mutation_id DESC) = 1"""


@query("upsert_latest", B.with_views("mutations", _UPSERT))
def upsert_latest(spark, sf_dir):
    rows = B.mutations(spark, sf_dir).select("document_id", "mutation_id", "kind", "chunks")
    old, new = rows.filter("kind <> 'UPDATE'"), rows.filter("kind = 'UPDATE'")
    return O.upsert_latest(old, new, "document_id", "mutation_id")


@query("delete_keys", B.with_views("kb_docs kb_chunks", """SELECT chunk_id, document_id, version FROM kb_chunks c
    WHERE NOT EXISTS (SELECT 1 FROM kb_docs d WHERE d.status = 'DELETED' AND d.document_id = c.document_id)
      AND NOT EXISTS (SELECT 1 FROM kb_docs d WHERE d.status = 'PROCESSING' AND
        d.document_id = c.document_id AND d.current_version = c.version)"""))
def delete_keys(spark, sf_dir):
    docs = B.kb_docs(spark, sf_dir)
    gone = docs.filter("status = 'DELETED'")
    redone = docs.filter("status = 'PROCESSING'").withColumnRenamed("current_version", "version")
    chunks = B.kb_chunks(spark, sf_dir).select("chunk_id", "document_id", "version")
    kept = O.delete_keys(chunks, gone, ["document_id"])
    return O.delete_keys(kept, redone, ["document_id", "version"]).select(
        "chunk_id", "document_id", "version")


@query("embedding_snapshot", """SELECT 'c' || vec_id AS chunk_id, len(embedding) AS dim FROM embeddings
    WHERE vec_id IN (SELECT doc_id FROM documents)""")
def embedding_snapshot(spark, sf_dir):
    snapshot = O.embedding_snapshot(B.kb_chunks(spark, sf_dir))
    return snapshot.select("chunk_id", F.size(F.split("vector", ",")).cast("long").alias("dim"))


@query("list_documents", B.with_views("kb_docs", """SELECT document_id, filename, status,
    created_at::BIGINT AS created_at FROM kb_docs ORDER BY created_at DESC, document_id"""))
def list_documents(spark, sf_dir):
    return O.list_documents(B.kb_docs(spark, sf_dir)).select(
        "document_id", "filename", "status", F.unix_seconds("created_at").alias("created_at"))


@query("list_chunks", f"""WITH docs AS ({_DOCS}), texts AS (SELECT document_id, version,
      {sql_strip('content')} AS t FROM docs WHERE document_id = (SELECT doc_id::VARCHAR FROM documents
        ORDER BY n_chars DESC, doc_id LIMIT 1)), cut AS ({sql_windows('texts')})
    SELECT document_id, version, chunk_index::INT AS chunk_index, content FROM cut""")
def list_chunks(spark, sf_dir):
    longest = B.table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id")).first()["document_id"]
    docs = documents(spark, sf_dir)
    return O.list_chunks(K.chunk_fixed(docs), longest, docs)


@query("corpus_stats", B.with_views("kb_docs kb_chunks", """SELECT (SELECT count(*) FROM kb_docs) AS documents,
    count(*) AS active_chunks, sum(length(content))::BIGINT AS total_chars,
    max(len(embedding))::INT AS vector_dimension FROM kb_chunks WHERE status = 'ACTIVE'"""))
def corpus_stats(spark, sf_dir):
    return O.corpus_stats(B.kb_docs(spark, sf_dir), B.kb_chunks(spark, sf_dir))


@query("kb_version", B.with_views("mutations", """SELECT mutation_id, 1 + row_number() OVER (
    ORDER BY ts, mutation_id) AS kb_version FROM mutations"""))
def kb_version(spark, sf_dir):
    return O.kb_version(B.mutations(spark, sf_dir)).select("mutation_id", "kb_version")


@query("document_history", B.with_views("mutations", """SELECT document_id, mutation_id, kind, version::BIGINT AS version,
      ts AS valid_from, valid_to, valid_to IS NULL AND kind <> 'DELETE' AS current,
      CASE WHEN valid_to IS NULL AND kind <> 'DELETE' THEN 'ACTIVE' ELSE 'DELETED' END AS status,
      coalesce(before, 0)::BIGINT AS deactivated_chunks, made::BIGINT AS new_chunks FROM (
    SELECT *, sum(CASE WHEN kind = 'DELETE' THEN 0 ELSE 1 END) OVER w AS version,
      lead(ts) OVER w AS valid_to, lag(made) OVER w AS before
    FROM (SELECT *, CASE WHEN kind = 'DELETE' THEN 0 ELSE chunks END AS made FROM mutations)
    WINDOW w AS (PARTITION BY document_id ORDER BY ts, mutation_id))"""))
def document_history(spark, sf_dir):
    rows = O.document_history(B.mutations(spark, sf_dir))
    return rows.withColumns({c: F.unix_seconds(c) for c in ("valid_from", "valid_to")}).select(
        "document_id", "mutation_id", "kind", "version", "valid_from", "valid_to", "current",
        "status", "deactivated_chunks", "new_chunks")


def _seconds(df, *columns):
    return df.withColumns({c: F.unix_seconds(c) for c in columns})


@query("latest_task_per_document", B.with_views("tasks", """SELECT document_id, task_id, document_version, status,
    created_at FROM tasks QUALIFY row_number() OVER (PARTITION BY document_id
      ORDER BY created_at DESC, task_id DESC) = 1"""))
def latest_task_per_document(spark, sf_dir):
    rows = O.latest_task_per_document(B.tasks(spark, sf_dir))
    return _seconds(rows, "created_at").select(
        "document_id", "task_id", "document_version", "status", "created_at")


@query("stale_tasks", B.with_views("tasks task_documents", """SELECT task_id, t.document_id,
      CASE WHEN document_version <> current_version THEN 'CANCELED' ELSE status END AS status,
      CASE WHEN document_version <> current_version THEN 'DOCUMENT_VERSION_STALE' ELSE error_code END
        AS error_code FROM tasks t JOIN task_documents d ON d.document_id = t.document_id"""))
def stale_tasks(spark, sf_dir):
    return O.stale_tasks(B.tasks(spark, sf_dir), B.task_documents(spark, sf_dir)).select(
        "task_id", "document_id", "status", "error_code")


@query("task_backlog", B.with_views("tasks", """SELECT task_id, document_id, status, created_at,
      CASE WHEN stuck THEN 'INGEST_LOCK_TIMEOUT' END AS error_code,
      row_number() OVER (ORDER BY created_at, task_id) AS position FROM (
    SELECT *, coalesce(status = 'RUNNING' AND locked_at < now - 300, false) AS stuck,
      status IN ('PENDING', 'RETRYING') AND (next_retry_at IS NULL OR next_retry_at <= now) AS waiting
    FROM tasks, (SELECT epoch(TIMESTAMP '1996-06-01 00:00:00')::BIGINT AS now)) WHERE stuck OR waiting"""))
def task_backlog(spark, sf_dir):
    due = O.task_backlog(B.tasks(spark, sf_dir), "1996-06-01 00:00:00")
    return _seconds(due, "created_at").select("task_id", "document_id", "status", "created_at",
                                              "error_code", "position")


@query("backlog_counts", B.with_views("tasks", "SELECT status, count(*) AS tasks FROM tasks GROUP BY 1"))
def backlog_counts(spark, sf_dir):
    return O.backlog_counts(B.tasks(spark, sf_dir))


_RETRIES = """SELECT *, sum(CASE WHEN retryable THEN 1 ELSE 0 END) OVER (PARTITION BY task_id
      ORDER BY ts, attempt_id) AS n FROM (SELECT *, error_code NOT IN
      ('DOCUMENT_EMPTY_FILE', 'INVALID_STRUCTURED_OUTPUT') AS retryable FROM attempts)"""


@query("retry_schedule", B.with_views("attempts", """SELECT task_id, attempt_id, retryable, n::BIGINT AS retry_no,
      CASE WHEN retryable AND n < 3 THEN least(300, 5 * 2 ** (n - 1))::INT END AS delay_seconds,
      CASE WHEN retryable AND n < 3 THEN 'RETRYING' ELSE 'FAILED' END AS next_status FROM counted""",
    counted=_RETRIES))
def retry_schedule(spark, sf_dir):
    return O.retry_schedule(B.attempts(spark, sf_dir)).select(
        "task_id", "attempt_id", "retryable", "retry_no", "delay_seconds", "next_status")
