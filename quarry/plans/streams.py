"""Queries that run a stream over the driver files to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import bindings as B
from quarry.plans.chunks import (_IDENTITY, _TWO_VERSIONS, LETTERS, THRESHOLD, letter_counts,
                                 strategy_views, two_versions)
from quarry.plans.operations import (_COUNTERS, _RATES, _TRANSITIONS, SQL_ALERTS,
                                     SQL_OUTCOMES, SQL_QUOTA)
from quarry.plans.registry import query
from quarry.session import cut, work_path
from quarry.streaming import state as T
from quarry.streaming import windows as W
from quarry.streaming.ingest import latest_chunks, latest_manifest, stream_ingest
from quarry.streaming.run import read_parquet_stream, run_available, run_closed, state_settings


def _typed(rows):
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))


def event_stream(spark, sf_dir):
    return _typed(read_parquet_stream(spark, sf_dir, "events.parquet"))


def _closed(spark, sf_dir, build, name):
    """All that ``build`` makes of the event stream, windows that are open at its end included: a
    purchase in the far future, which closes them, arrives after the other rows."""
    folder = work_path(spark, "closing")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").limit(0)
    last.write.parquet(folder)
    far = spark.range(1).select(*[
        {"ts": F.lit("2999-01-01 00:00:00"), "event_type": F.lit("purchase"), "event_id": F.lit(-1),
         "user_id": F.lit(-1), "value": F.lit(0), "props": F.lit('{"k": 2}')}
        .get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in last.schema])
    rows = read_parquet_stream(spark, sf_dir, "events.parquet").unionByName(
        read_parquet_stream(spark, folder, "*.parquet"))
    with state_settings(spark):
        return run_closed(build(_typed(rows)), name, lambda: far.write.mode("append").parquet(folder))


def _shuffled(spark, sf_dir, build, name):
    """All that ``build`` makes of the events when they come in four files dealt by hash, one to a
    batch, so that each batch spans all of the time. The watermark has to span it too; rows far ahead
    then close what waits."""
    folder = work_path(spark, "shuffled")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    far = rows.limit(1).withColumns({"ts": F.lit("2200-01-01 00:00:00").cast(rows.schema["ts"].dataType),
                                     "event_id": F.lit(1 << 30).cast(rows.schema["event_id"].dataType),
                                     "user_id": F.lit(-1).cast(rows.schema["user_id"].dataType)})
    stream = _typed(read_parquet_stream(spark, folder, "*.parquet", files_per_trigger=1))
    with state_settings(spark):
        return run_closed(build(stream), name, lambda: far.write.mode("append").parquet(folder))


#: Longer than the events last.
SPAN = "60 days"


def usage_of(events):
    prompt, k = F.floor("value").cast("int"), F.col("k")
    return B.usage_of(events, prompt, k, prompt + k)


def calls_of(events):
    return events.select(
        B.tag("e", F.col("event_id")).alias("call_id"), B.tag("t", F.col("user_id") % 5)
        .alias("tenant_id"), B.tag("u", F.col("user_id")).alias("user_id"),
        F.col("event_type").alias("interface_name"), "ts",
        (F.floor("value") + 100).cast("long").alias("need"),
        (F.floor("value") + F.col("k")).cast("long").alias("charge"))


def _finish(df, name):
    with state_settings(df.sparkSession):
        return run_available(df, name)


@query("stream_usage", B.with_views("usage", f"""SELECT epoch(w)::BIGINT AS window_start, tenant_id, model,
      interface_name, count(*) AS calls, sum(total_tokens)::BIGINT AS total_tokens,
      sum(cached_tokens)::BIGINT AS cached_tokens, round(sum(estimated_cost)::DOUBLE, 6) AS estimated_cost
    FROM (SELECT *, date_trunc('hour', created_at) AS w FROM usage)
    GROUP BY ALL"""))
def stream_usage(spark, sf_dir):
    rows = _closed(spark, sf_dir, lambda events: W.stream_usage(usage_of(events)), "usage")
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "tenant_id", "model",
                       "interface_name", "calls", "total_tokens", "cached_tokens",
                       F.round("estimated_cost", 6).alias("estimated_cost"))


@query("stream_alerts", B.with_views("metric_events", SQL_ALERTS.replace("KEY", "hour"),
    rated=f"""SELECT *, {_RATES} FROM (SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, {_COUNTERS}
      FROM metric_events GROUP BY 1)"""))
def stream_alerts(spark, sf_dir):
    rows = _closed(spark, sf_dir, lambda events: W.stream_alerts(
        B.metric_events_of(events), max_tokens=1000), "alerts")
    return rows.select(F.floor(F.unix_seconds("window_start") / 3600).alias("hour"), "alert",
                       F.round("value", 6).alias("value"))


@query("stream_rate_limit", B.with_views("calls", f"""SELECT epoch(w)::BIGINT AS window_start, tenant_id AS user_id,
      interface_name, count(*) AS calls, greatest(0, count(*) - 1)::BIGINT AS overflow
    FROM (SELECT *, date_trunc('minute', ts) AS w FROM calls)
    GROUP BY ALL"""))
def stream_rate_limit(spark, sf_dir):
    rows = _closed(spark, sf_dir, lambda events: W.stream_rate_limit(
        calls_of(events).withColumn("user_id", F.col("tenant_id")), 1), "rate-limit")
    return rows.withColumn("window_start", F.unix_seconds("window_start")).drop("window_end")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice and leaves once."""
    twice = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = W.stream_dedup(twice.select("event_id", "user_id", "ts"), ["event_id"], "ts", "1 hour")
    return _finish(once, "dedup").select("event_id", "user_id")


@query("stream_sessions", """SELECT user_id, epoch_us(min(ts)) AS session_start,
      epoch_us(max(ts) + INTERVAL 30 MINUTES) AS session_end, count(*) AS events FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTES
        THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    rows = _closed(spark, sf_dir, lambda events: W.stream_sessions(events.select("ts", "user_id")),
                   "sessions")
    return rows.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


@query("stream_confirmations", B.with_views("created confirmed", SQL_OUTCOMES))
def stream_confirmations(spark, sf_dir):
    rows = _closed(spark, sf_dir, lambda events: W.stream_confirmations(
        *B.confirmation_events_of(events)), "confirmations")
    return rows.select("confirmation_id", "owner_id", "outcome")


@query("stream_quota", f"SELECT call_id, tenant_id, user_id, admitted FROM ({SQL_QUOTA})")
def stream_quota(spark, sf_dir):
    """Calls in any order of arrival get the verdicts of their order in time."""
    return _shuffled(spark, sf_dir, lambda events: T.stream_quota(
        calls_of(events), 2500, 8000, watermark=SPAN, by=T.EVENT), "quota")


@query("stream_workflow", B.with_views("workflow_states", """SELECT workflow_id, event_id, from_state,
    state AS to_state, event, session_no::BIGINT AS session_no, legal FROM moves""",
    moves=_TRANSITIONS))
def stream_workflow(spark, sf_dir):
    """Events in any order of arrival."""
    return _shuffled(spark, sf_dir, lambda events: T.stream_workflow(
        B.workflow_states_of(events), watermark=SPAN, by=T.EVENT), "workflow")


# one attempt after the other: what the task was, whether its lock ran out first, and what it becomes
_TASKS = B.with_views("ev", """SELECT task_id, ms AS at_ms, status, retries, code AS error_code, delay AS delay_seconds
      FROM walk WHERE n > 0 AND told
    UNION ALL SELECT task_id, lost, 'RETRYING', lost_retries, 'INGEST_LOCK_TIMEOUT', 0 FROM walk WHERE lost IS NOT NULL
    UNION ALL SELECT task_id, locked + 300000, 'RETRYING', retries, 'INGEST_LOCK_TIMEOUT', 0 FROM walk w
      WHERE locked IS NOT NULL AND n = (SELECT max(n) FROM numbered b WHERE b.task_id = w.task_id)""",
    numbered=f"""SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, attempt_id) AS n FROM (
      SELECT 'k' || user_id || '-' || k % 20 AS task_id, event_id AS attempt_id, ts, epoch_us(ts) // 1000 AS ms,
        CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'START' WHEN event_type = 'purchase' THEN 'SUCCESS'
          ELSE 'FAILURE' END AS kind,
        CASE WHEN event_type = 'error' THEN {B._sql_pick(B.ATTEMPT_CODES, 'event_id')} END AS error_code FROM ev)""",
    walk="""SELECT DISTINCT task_id, 0::BIGINT AS n, 0::BIGINT AS ms, 'PENDING' AS status, 0::INT AS retries,
        NULL::BIGINT AS locked, false AS told, NULL::VARCHAR AS code, NULL::INT AS delay, NULL::BIGINT AS lost,
        0::INT AS lost_retries FROM numbered
      UNION ALL SELECT task_id, n, ms,
        CASE kind WHEN 'START' THEN CASE WHEN open THEN 'RUNNING' ELSE before END WHEN 'SUCCESS' THEN 'SUCCESS'
          ELSE CASE WHEN retryable AND tried < 3 THEN 'RETRYING' ELSE 'FAILED' END END,
        tried, CASE WHEN kind = 'START' THEN CASE WHEN open THEN ms ELSE held END END, kind <> 'START' OR open,
        CASE WHEN kind = 'FAILURE' THEN error_code END,
        CASE WHEN kind = 'FAILURE' AND retryable AND tried < 3 THEN least(300, 5 * 2 ** (tried - 1))::INT END, lost, had
      FROM (SELECT *, before IN ('PENDING', 'RETRYING') AS open,
          had + (kind = 'FAILURE' AND retryable)::INT AS tried FROM (
        SELECT c.task_id, c.n, c.ms, c.kind, c.error_code, w.retries AS had,
          coalesce(c.error_code NOT IN ('DOCUMENT_EMPTY_FILE', 'INVALID_STRUCTURED_OUTPUT'), false) AS retryable,
          CASE WHEN w.locked + 300000 <= c.ms THEN 'RETRYING' ELSE w.status END AS before,
          CASE WHEN w.locked + 300000 <= c.ms THEN NULL ELSE w.locked END AS held,
          CASE WHEN w.locked + 300000 <= c.ms THEN w.locked + 300000 END AS lost
        FROM walk w JOIN numbered c ON c.task_id = w.task_id AND c.n = w.n + 1))"""
    ).replace("WITH", "WITH RECURSIVE", 1)


@query("stream_ingest_tasks", _TASKS)
def stream_ingest_tasks(spark, sf_dir):
    """Attempts in any order of arrival."""
    return _shuffled(spark, sf_dir, lambda events: T.stream_ingest_tasks(
        attempts_of(events), watermark=SPAN, by=T.EVENT), "ingest-tasks")


def attempts_of(events):
    kind = F.col("event_type")
    return events.select(
        F.concat(B.tag("k", F.col("user_id")), F.lit("-"), (F.col("k") % 20).cast("string"))
        .alias("task_id"), F.col("event_id").alias("attempt_id"), "ts",
        F.when(kind.isin("click", "view", "signup"), "START").when(kind == "purchase", "SUCCESS")
        .otherwise("FAILURE").alias("kind"),
        F.when(kind == "error", B.pick(B.ATTEMPT_CODES, F.col("event_id"))).alias("error_code"))


def _summary(old, lines):
    return f"{len(old or '')}+{len(lines)}"


@query("stream_history", B.with_views("chat", """SELECT conversation_id, seq,
      CASE WHEN n <= 4 THEN n ELSE 2 + (n - 5) % 3 END::INT AS retained,
      n > 4 AND (n - 5) % 3 = 0 AS compressed
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS n FROM chat)"""))
def stream_history(spark, sf_dir):
    """Turns in any order of arrival: four files dealt by hash, one to a batch."""
    folder = work_path(spark, "shuffled")
    B.table(spark, sf_dir, "conversations").repartition(4, F.xxhash64("conv_id", "turn")).write.parquet(folder)
    rows = read_parquet_stream(spark, folder, "*.parquet", files_per_trigger=1)
    n = F.col("conv_id")
    turns = rows.select(
        B.tag("u", n % 5).alias("user_id"), n.cast("string").alias("conversation_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", F.col("text")).alias("user_message"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("assistant_message"))
    done = _finish(T.stream_history(turns, _summary, keep=2, threshold=4, first=0), "history")
    return done.select("conversation_id", "seq", "retained", "compressed")


@query("stream_ingest", B.with_views("", f"""SELECT {_IDENTITY} AS chunk_id, document_id, version, chunk_index,
      sha256(content) AS content_hash, array_to_string([(length(content) - length(replace(lower(content), x, '')))
        FOR x IN [{", ".join(f"'{c}'" for c in LETTERS)}]], ',') AS vector FROM docs_chunks""",
    docs=_TWO_VERSIONS, **strategy_views("docs", "document_id::BIGINT % 3 = 1")))
def stream_ingest_documents(spark, sf_dir):
    """Two versions of every document through all three strategies (documents have no headings, so a
    MARKDOWN one is a single section)."""
    docs = two_versions(read_parquet_stream(spark, sf_dir, "documents.parquet")).withColumn(
        "strategy", B.pick(("FIXED", "SEMANTIC", "MARKDOWN"), F.col("document_id").cast("long")))
    target = work_path(spark, "corpus")
    stream_ingest(docs, target, letter_counts, "letters", threshold=THRESHOLD).awaitTermination()
    numbers = F.transform("embedding", lambda x: x.cast("long").cast("string"))
    return latest_chunks(spark, target).select(
        "chunk_id", "document_id", "version", "chunk_index", "content_hash",
        F.array_join(numbers, ",").alias("vector"))


# after two runs: version 1 of a fifth of the documents is emptied, of a fifth deleted, of a fifth sent
# twice, of a fifth replaced by version 2 and sent again all the same, and of a fifth sent with an image
_SENT = """SELECT doc_id::VARCHAR AS document_id, 1 + (doc_id % 5 = 3)::INT AS version, doc_id % 5 AS what,
      CASE doc_id % 5 WHEN 2 THEN 'New. ' || text WHEN 3 THEN 'Second. ' || text WHEN 4 THEN text END AS content, text
    FROM documents"""
_SENT_CHUNKS = """SELECT document_id, version, chunk_index, sha256(content) AS content_hash, 'TEXT' AS modality FROM sent_chunks
    UNION ALL SELECT document_id, version, coalesce(n, 0)::INT, sha256(text), 'IMAGE'
      FROM sent LEFT JOIN (SELECT document_id, version, count(*) AS n FROM sent_chunks GROUP BY ALL)
      USING (document_id, version) WHERE what = 4 AND text IS NOT NULL"""


@query("stream_ingest_manifest", B.with_views("", """SELECT document_id, version,
      CASE WHEN what = 1 THEN 'DELETED' WHEN modality IS NULL THEN 'FAILED' ELSE 'READY' END AS state,
      CASE WHEN what <> 1 AND modality IS NULL THEN 'DOCUMENT_EMPTY_FILE' END AS error_code,
      chunk_index, content_hash, modality
    FROM sent LEFT JOIN all_chunks USING (document_id, version)
    UNION ALL SELECT document_id, 1, 'CANCELED', 'DOCUMENT_VERSION_STALE', NULL, NULL, NULL FROM sent WHERE what = 3""",
    sent=_SENT, **strategy_views("sent", "document_id::BIGINT % 3 = 1"), all_chunks=_SENT_CHUNKS))
def stream_ingest_manifest(spark, sf_dir):
    """Every document, and then each of them again in one of five ways, in a second run of the stream."""
    folder, target = work_path(spark, "sent"), work_path(spark, "corpus")
    n = F.col("doc_id")
    docs = B.table(spark, sf_dir, "documents")
    image = F.struct(F.lit(2).alias("page"), F.encode("text", "UTF-8").alias("bytes"))

    def row(version, content, at, kind="UPSERT", images=None):
        return F.struct(
            n.cast("string").alias("document_id"), F.lit(version).cast("int").alias("version"),
            content.cast("string").alias("content"), F.lit(at).alias("at"), F.lit(kind).alias("kind"),
            B.pick(("FIXED", "SEMANTIC", "MARKDOWN"), n).alias("strategy"), F.lit("a.png").alias("filename"),
            F.lit(None).cast("string").alias("content_type"),
            (images if images is not None else F.array().cast("array<struct<page:int,bytes:binary>>")).alias("images"))

    text = F.col("text")
    whole_document = F.when(n % 2 == 0, 1)
    again = (F.when(n % 5 == 0, F.array(row(1, F.lit(" \n"), 2)))
             .when(n % 5 == 1, F.array(row(whole_document, F.lit(None), 2, "DELETE")))
             .when(n % 5 == 2, F.array(row(1, F.concat(F.lit("New. "), text), 3), row(1, F.concat(text, F.lit(" old")), 2)))
             .when(n % 5 == 3, F.array(row(2, F.concat(F.lit("Second. "), text), 2), row(1, text, 3)))
             .otherwise(F.array(row(1, text, 2, images=F.array(image)))))
    current = cut(docs.select(n.cast("string").alias("document_id"), F.when(n % 5 == 3, 2).otherwise(1).alias("version")), "current")
    for sent, registry in ((F.array(row(1, text, 1)), None), (again, lambda: current)):
        docs.select(F.explode(sent).alias("row")).select("row.*").write.mode("append").parquet(folder)
        stream = read_parquet_stream(spark, folder, "*.parquet", files_per_trigger=1 << 20)
        stream_ingest(stream, target, letter_counts, "letters", threshold=THRESHOLD, order="at",
                      registry=registry).awaitTermination()
    chunks = latest_chunks(spark, target).select("document_id", "version", "chunk_index", "content_hash", "modality")
    return latest_manifest(spark, target).select("document_id", "version", "state", "error_code").join(
        chunks, ["document_id", "version"], "left")
