"""Views over the driver tables with the columns the operators need.

The tables have no access, usage or agent columns, so those are derived from ids by arithmetic. Each
view has a twin in ``SQL`` with the same rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dense import centroids

EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
VISIBILITIES = ("PRIVATE", "DEPARTMENT", "TENANT", "PUBLIC", "CUSTOM")
STATES = ("INIT", "NEED_ORDER_ID", "ORDER_READY", "ORDER_QUERIED", "POLICY_CHECKED",
          "WAITING_CONFIRMATION", "SUBMITTED", "REJECTED", "CANCELLED", "FAILED", "DONE")
ATTEMPT_CODES = ("TIMEOUT", "HTTP_ERROR", "DOCUMENT_EMPTY_FILE", "CLIENT_ERROR", "EMPTY_OUTPUT",
                 "INVALID_STRUCTURED_OUTPUT", "NETWORK_ERROR", "INGEST_EXECUTION_FAILED")
TASK_STATUSES = ("PENDING", "RUNNING", "RETRYING", "SUCCESS", "FAILED", "CANCELED")

_schemas: dict = {}  # path -> schema, so that footers are read once per table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without a zone are read as session time (UTC)."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_schemas[path]).parquet(path)
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def tag(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def pick(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def acl(n: Column) -> dict[str, Column]:
    """Access columns from a number."""
    return {
        "tenant_id": tag("t", n % 3), "owner_id": tag("u", n % 50),
        "department_id": tag("d", n % 7), "visibility": pick(VISIBILITIES, n),
        "allowed_user_ids": F.array(tag("u", n % 11)), "allowed_role_ids": F.array(tag("r", n % 4)),
    }


def principal(n: Column) -> dict[str, Column]:
    """Principal columns from a number."""
    return {
        "tenant_id": tag("t", n % 3), "user_id": tag("u", n),
        "department_ids": F.array(tag("d", n % 7), tag("d", (n + 3) % 7)),
        "role_ids": F.array(tag("r", n % 4)),
    }


def kb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    status = (F.when(n % 17 == 0, "DELETED").when(n % 13 == 0, "PROCESSING").otherwise("READY"))
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("document_id"), n.alias("doc_no"),
        F.concat("source", F.lit("-"), n.cast("string"), F.lit(".md")).alias("filename"),
        F.col("text").alias("content"), *[c.alias(k) for k, c in acl(n).items()],
        (1 + n % 3).cast("int").alias("current_version"), status.alias("status"),
        (n % 3).cast("int").alias("permission_level"),
        F.timestamp_seconds(EPOCH + n * 60).alias("created_at"))


def kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document, with a vector where the embeddings table has one; some are deleted
    or belong to an older version."""
    docs = kb_docs(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_no"), "embedding", "label")
    n, items = F.col("doc_no"), table(spark, sf_dir, "benchmark").count()
    return docs.join(vectors, "doc_no", "left").select(
        F.concat(F.lit("c"), "document_id").alias("chunk_id"), "document_id", "filename", "content",
        "tenant_id", "owner_id", "department_id", "visibility", "allowed_user_ids",
        "allowed_role_ids",
        (F.col("current_version") - F.when(n % 19 == 0, 1).otherwise(0)).cast("int")
        .alias("version"),
        F.when(n % 23 == 0, "DELETED").otherwise("ACTIVE").alias("status"),
        F.col("status").alias("document_status"), F.lit(0).alias("chunk_index"),
        F.when(n % 2 == 0, F.concat(F.lit("p"), (F.floor(n / 2) % items).cast("string"))).alias("parent_id"),
        "embedding", "label")


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.access import current_versions, filter_live, keep_current

    registry = current_versions(kb_docs(spark, sf_dir))
    return keep_current(filter_live(kb_chunks(spark, sf_dir)), registry)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One principal per user of the event log."""
    n = F.col("user_id")
    rights = F.array_compact(F.array(
        F.when(n % 2 == 0, F.lit("order:query")), F.when(n % 3 == 0, F.lit("order:cancel")),
        F.lit("knowledge:search")))
    people = table(spark, sf_dir, "events").select("user_id").distinct()
    return people.select(*[c.alias(k) for k, c in principal(n).items()],
                         rights.alias("permissions"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(table(spark, sf_dir, "embeddings"), "label")


def dense_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, asked by a principal of each tenant."""
    means = label_centroids(spark, sf_dir).withColumn(
        "tenant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = F.col("label") * 3 + F.col("tenant")
    return means.select(
        F.concat(F.lit("q"), F.col("label").cast("string"), F.lit("-"),
                 F.col("tenant").cast("string")).alias("query_id"),
        "label", "embedding", *[c.alias(k) for k, c in principal(n).items()])


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, with the mean vector of one label."""
    n = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(
        tag("b", n).alias("query_id"), "text", (n % 10).cast("int").alias("label"),
        *[c.alias(k) for k, c in principal(n).items()])
    # a left join on unique labels: plans that need no vector drop it
    return asked.join(label_centroids(spark, sf_dir), "label", "left")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parent blocks: labels of the benchmark texts stand in for section bodies."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(tag("p", F.col("item_id")).alias("parent_id"), F.col("text").alias("content"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, k = F.floor("value").cast("int"), F.col("k")
    total = prompt + k
    return usage_of(_events(spark, sf_dir), prompt, k, total)


def usage_of(events: DataFrame, prompt: Column, k: Column, total: Column) -> DataFrame:
    model = F.concat(pick(("FAST", "STANDARD", "ADVANCED"), k), F.lit(":default"))
    cost = (total.cast("decimal(12,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    return events.select(
        tag("e", F.col("event_id")).alias("request_id"), tag("t", F.col("user_id") % 5)
        .alias("tenant_id"), tag("u", F.col("user_id")).alias("user_id"),
        F.col("event_type").alias("interface_name"), model.alias("model"),
        prompt.alias("prompt_tokens"), k.alias("completion_tokens"), total.alias("total_tokens"),
        F.when(k % 2 == 0, F.least(prompt, k)).otherwise(0).alias("cached_tokens"),
        cost.alias("estimated_cost"), (prompt * 3 + k).cast("long").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with a planned and an actual token count."""
    return _events(spark, sf_dir).select(
        tag("e", F.col("event_id")).alias("call_id"), tag("t", F.col("user_id") % 5)
        .alias("tenant_id"), tag("u", F.col("user_id")).alias("user_id"),
        F.col("event_type").alias("interface_name"), "ts",
        (F.floor("value") + 100).cast("long").alias("need"),
        (F.floor("value") + F.col("k")).cast("long").alias("charge"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("event_id"), F.col("k")
    tool = (F.when(F.col("event_type").isin("click", "signup"), "query_order")
            .when(F.col("event_type") == "view", "search_knowledge_base")
            .when(F.col("event_type") == "purchase", "cancel_order").otherwise("unknown_tool"))
    args = (F.when(n % 7 == 0, F.concat(F.lit('{"orderId":"ORD'), (k % 5).cast("string"),
                                        F.lit('"}')))
            .when(n % 7 == 1, F.concat(F.lit('{"query":"refund policy","topK":'),
                                       k.cast("string"), F.lit("}")))
            .when(n % 7 == 2, '{"orderId":"bad id!"}')
            .when(n % 7 == 3, '{"userId":"u1","orderId":"ORD1"}')
            .when(n % 7 == 4, "not json").when(n % 7 == 5, '["a"]')
            .otherwise('{"query":"","extra":1}'))
    code = pick(("", "TOOL_NOT_FOUND", "ORDER_NOT_FOUND", "TIMEOUT"), k)
    return _events(spark, sf_dir).select(
        _request().alias("request_id"), tag("e", n).alias("call_id"), tool.alias("tool_name"),
        args.alias("arguments"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", code).alias("error_code"),
        F.floor("value").cast("long").alias("elapsed_ms"),
        tag("t", F.col("user_id") % 5).alias("tenant_id"),
        F.array(tag("r", F.col("user_id") % 4)).alias("role_ids"), "ts")


def _request() -> Column:
    """One agent request per user and day."""
    return F.concat(tag("u", F.col("user_id")), F.lit("-"),
                    F.date_format("ts", "yyyyMMdd"))


def agent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.skew import hour_of, running

    kind = F.col("event_type")
    action = (F.when(kind == "view", "TOOL_CALL").when(kind == "purchase", "TOOL_RESULT")
              .when(kind == "signup", "FINAL_ANSWER").otherwise("MODEL_CALL"))
    rows = _events(spark, sf_dir).select(
        _request().alias("request_id"), "event_id", action.alias("action_type"),
        (kind != "error").alias("success"),
        F.when((kind == "error") & (F.col("k") % 2 == 0), "LLM_OUTPUT_INVALID").alias("error_code"),
        F.floor(F.col("value") * 20).cast("long").alias("elapsed_ms"),
        F.when(kind == "signup", "FINAL_ANSWER")
        .when(kind == "error", "LLM_CALL_FAILED").alias("stop_reason"),
        F.col("ts").alias("created_at"))
    return running(rows, ["request_id"], ["created_at", "event_id"], hour_of("created_at"),
                   step_index=("row_number", None))


def tool_policy(spark: SparkSession) -> DataFrame:
    """Rollout policy of three tools."""
    return spark.createDataFrame(
        [("query_order", True, False, True, False, 2, [], []),
         ("search_knowledge_base", True, False, True, False, 3, ["t0", "t1", "t2"], []),
         ("cancel_order", True, False, False, True, 1, [], ["r0", "r1"])],
        "tool_name string, enabled boolean, shadow_only boolean, auto_execute boolean, "
        "requires_confirmation boolean, max_calls_per_request int, "
        "allowed_tenant_ids array<string>, allowed_role_ids array<string>")


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_events_of(_events(spark, sf_dir))


def metric_events_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.when(kind == "click", "API_REQUEST").when(kind == "view", "LLM_CALL")
        .when(kind == "purchase", "RAG_NO_ANSWER").when(kind == "signup", "AGENT_MAX_STEPS")
        .otherwise("TOOL_FAILURE").alias("kind"),
        F.when(F.col("k") % 5 == 0, 500).otherwise(200).alias("status"),
        (F.col("k") % 4 != 0).alias("success"), F.floor("value").cast("int").alias("tokens"), "ts")


def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow_states_of(_events(spark, sf_dir))


def workflow_states_of(events: DataFrame) -> DataFrame:
    return events.select(
        tag("w", F.col("user_id")).alias("workflow_id"), F.col("event_id"), "ts",
        pick(STATES, F.col("k")).alias("state"), F.col("event_type").alias("event"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as turns: the speaker's field is filled, the other one is null."""
    n = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        tag("u", n % 5).alias("user_id"), n.cast("string").alias("conversation_id"),
        F.col("turn").alias("seq"), "role",
        F.when(F.col("role") == "user", F.col("text")).alias("user_message"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("assistant_message"),
        F.col("text").alias("content"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    kind = F.when(n % 7 == 0, "DELETE").when(n % 5 == 0, "UPLOAD").otherwise("UPDATE")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), (n % 5).cast("string")).alias("document_id"),
        n.alias("mutation_id"), F.timestamp_seconds(EPOCH + n * 60).alias("ts"),
        kind.alias("kind"), (1 + F.floor(F.col("n_chars") / 500)).cast("long").alias("chunks"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.col("o_orderkey"), F.unix_seconds("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        tag("k", n).alias("task_id"), tag("d", F.col("o_custkey")).alias("document_id"),
        (1 + n % 3).cast("int").alias("document_version"), pick(TASK_STATUSES, n).alias("status"),
        F.when(n % 4 != 0, F.timestamp_seconds(at + (n % 48) * 3600)).alias("next_retry_at"),
        F.when(n % 6 == 1, F.timestamp_seconds(at + n % 1000)).alias("locked_at"),
        F.lit(None).cast("string").alias("error_code"), F.col("o_orderdate").alias("created_at"))


def task_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        tag("d", n).alias("document_id"), (1 + n % 3).cast("int").alias("current_version"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed ingest attempts: several per task."""
    n = F.col("event_id")
    return _events(spark, sf_dir).select(
        F.concat(tag("k", F.col("user_id")), F.lit("-"), (F.col("k") % 20).cast("string"))
        .alias("task_id"), n.alias("attempt_id"), "ts",
        pick(ATTEMPT_CODES, n).alias("error_code"))


def confirmation_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return confirmation_events_of(_events(spark, sf_dir))


def confirmation_events_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(created, confirmed): purchases ask, three in four are answered up to ten minutes later, some
    by another user."""
    asked = events.filter(F.col("event_type") == "purchase")
    k = F.col("k")
    created = asked.select(tag("c", F.col("event_id")).alias("confirmation_id"),
                           tag("u", F.col("user_id")).alias("user_id"),
                           F.col("ts").alias("created_at"))
    answerer = F.when(k % 4 == 1, F.col("user_id") + 1).otherwise(F.col("user_id"))
    confirmed = asked.filter(k % 4 != 0).select(
        tag("c", F.col("event_id")).alias("confirmation_id"), tag("u", answerer).alias("user_id"),
        (F.col("ts") + F.make_dt_interval(secs=k * 6)).alias("confirmed_at"))
    return created, confirmed


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.cast("string").alias("order_id"), tag("u", F.col("o_custkey")).alias("owner_id"),
        F.when(F.col("o_orderstatus") == "F", "SHIPPED").otherwise("NOT_SHIPPED").alias("status"))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line item: the owner for even lines, a neighbour for the others, and some for
    orders that do not exist."""
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    order = F.when(line == 1, n + 100_000_000).otherwise(n)
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                                   "o_custkey")
    asker = F.when(line % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1)
    return lines.join(owners, "l_orderkey").select(
        F.concat(n.cast("string"), F.lit("-"), line.cast("string")).alias("request_id"),
        tag("u", asker).alias("user_id"), order.cast("string").alias("order_id"))


def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their h1 to h6 turned into heading lines and the other tags into newlines."""
    html = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    for level in range(1, 7):
        html = F.regexp_replace(html, f"<h{level}[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(html, "<[^>]*>", "\n")
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        n.cast("string").alias("document_id"), (1 + n % 3).cast("int").alias("version"),
        text.alias("content"))


# ---- the same views in SQL ------------------------------------------------------------------

def _sql_pick(values, n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({n}) % {len(values)} + 1]"


def _sql_acl(n: str) -> str:
    return (f"'t' || ({n}) % 3 AS tenant_id, 'u' || ({n}) % 50 AS owner_id, "
            f"'d' || ({n}) % 7 AS department_id, {_sql_pick(VISIBILITIES, n)} AS visibility, "
            f"['u' || ({n}) % 11] AS allowed_user_ids, ['r' || ({n}) % 4] AS allowed_role_ids")


def _sql_principal(n: str) -> str:
    return (f"'t' || ({n}) % 3 AS tenant_id, 'u' || ({n}) AS user_id, "
            f"['d' || ({n}) % 7, 'd' || (({n}) + 3) % 7] AS department_ids, "
            f"['r' || ({n}) % 4] AS role_ids")


_REQUEST = "'u' || user_id || '-' || strftime(ts, '%Y%m%d')"

SQL: dict[str, str] = {
    "kb_docs": f"""SELECT doc_id::VARCHAR AS document_id, doc_id AS doc_no,
        source || '-' || doc_id || '.md' AS filename, text AS content, {_sql_acl('doc_id')},
        (1 + doc_id % 3)::INT AS current_version,
        CASE WHEN doc_id % 17 = 0 THEN 'DELETED' WHEN doc_id % 13 = 0 THEN 'PROCESSING'
             ELSE 'READY' END AS status, (doc_id % 3)::INT AS permission_level,
        {EPOCH} + doc_id * 60 AS created_at FROM documents""",
    "kb_chunks": """SELECT 'c' || document_id AS chunk_id, document_id, filename, content, tenant_id,
        owner_id, department_id, visibility, allowed_user_ids, allowed_role_ids,
        current_version - CASE WHEN doc_no % 19 = 0 THEN 1 ELSE 0 END AS version,
        CASE WHEN doc_no % 23 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS status,
        status AS document_status, 0 AS chunk_index,
        CASE WHEN doc_no % 2 = 0 THEN 'p' || (doc_no // 2) % (SELECT count(*) FROM benchmark) END AS parent_id,
        embedding::DOUBLE[] AS embedding, label
        FROM kb_docs LEFT JOIN embeddings ON vec_id = doc_no""",
    "live_chunks": """SELECT c.* FROM kb_chunks c WHERE c.status = 'ACTIVE'
        AND c.document_status = 'READY' AND EXISTS (SELECT 1 FROM kb_docs d
          WHERE d.document_id = c.document_id AND d.status = 'READY'
            AND d.current_version = c.version)""",
    "users": f"""SELECT {_sql_principal('user_id')},
        list_filter([CASE WHEN user_id % 2 = 0 THEN 'order:query' END,
          CASE WHEN user_id % 3 = 0 THEN 'order:cancel' END, 'knowledge:search'],
          lambda x: x IS NOT NULL) AS permissions
        FROM (SELECT DISTINCT user_id FROM events)""",
    "label_centroids": """SELECT label, list(x ORDER BY pos) AS embedding FROM (
        SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
          generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos)
        GROUP BY label""",
    "dense_queries": f"""SELECT 'q' || label || '-' || tenant AS query_id, label, embedding,
        {_sql_principal('label * 3 + tenant')}
        FROM label_centroids, (SELECT unnest([0, 1, 2]) AS tenant)""",
    "text_queries": f"""SELECT 'b' || item_id AS query_id, text, label, embedding,
        {_sql_principal('item_id')} FROM benchmark JOIN label_centroids ON label = item_id % 10""",
    "parents": "SELECT 'p' || item_id AS parent_id, text AS content FROM benchmark",
    "ev": "SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events",
    "usage": f"""SELECT 'e' || event_id AS request_id, 't' || user_id % 5 AS tenant_id,
        'u' || user_id AS user_id, event_type AS interface_name,
        {_sql_pick(('FAST', 'STANDARD', 'ADVANCED'), 'k')} || ':default' AS model,
        floor(value)::INT AS prompt_tokens, k AS completion_tokens,
        floor(value)::INT + k AS total_tokens,
        CASE WHEN k % 2 = 0 THEN least(floor(value)::INT, k) ELSE 0 END AS cached_tokens,
        ((floor(value)::INT + k) * 0.000001)::DECIMAL(18, 6) AS estimated_cost,
        (floor(value)::INT * 3 + k)::BIGINT AS latency_ms, event_type <> 'error' AS success,
        ts AS created_at FROM ev""",
    "calls": """SELECT 'e' || event_id AS call_id, 't' || user_id % 5 AS tenant_id,
        'u' || user_id AS user_id, event_type AS interface_name, ts,
        (floor(value) + 100)::BIGINT AS need, (floor(value) + k)::BIGINT AS charge FROM ev""",
    "tool_calls": f"""SELECT {_REQUEST} AS request_id, 'e' || event_id AS call_id,
        CASE WHEN event_type IN ('click', 'signup') THEN 'query_order'
             WHEN event_type = 'view' THEN 'search_knowledge_base'
             WHEN event_type = 'purchase' THEN 'cancel_order' ELSE 'unknown_tool' END AS tool_name,
        CASE event_id % 7 WHEN 0 THEN '{{"orderId":"ORD' || k % 5 || '"}}'
             WHEN 1 THEN '{{"query":"refund policy","topK":' || k || '}}'
             WHEN 2 THEN '{{"orderId":"bad id!"}}' WHEN 3 THEN '{{"userId":"u1","orderId":"ORD1"}}'
             WHEN 4 THEN 'not json' WHEN 5 THEN '["a"]' ELSE '{{"query":"","extra":1}}' END
             AS arguments, event_type <> 'error' AS success,
        CASE WHEN event_type = 'error' THEN
          {_sql_pick(('', 'TOOL_NOT_FOUND', 'ORDER_NOT_FOUND', 'TIMEOUT'), 'k')} END AS error_code,
        floor(value)::BIGINT AS elapsed_ms, 't' || user_id % 5 AS tenant_id,
        ['r' || user_id % 4] AS role_ids, ts FROM ev""",
    "agent_steps": f"""SELECT *, row_number() OVER (PARTITION BY request_id
          ORDER BY created_at, event_id) AS step_index FROM (
        SELECT {_REQUEST} AS request_id, event_id, CASE event_type WHEN 'view' THEN 'TOOL_CALL'
          WHEN 'purchase' THEN 'TOOL_RESULT' WHEN 'signup' THEN 'FINAL_ANSWER' ELSE 'MODEL_CALL'
          END AS action_type, event_type <> 'error' AS success,
          CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'LLM_OUTPUT_INVALID' END AS error_code,
          floor(value * 20)::BIGINT AS elapsed_ms, CASE event_type WHEN 'signup' THEN 'FINAL_ANSWER'
          WHEN 'error' THEN 'LLM_CALL_FAILED' END AS stop_reason, ts AS created_at FROM ev)""",
    "tool_policy": """SELECT * FROM (VALUES
        ('query_order', true, false, true, false, 2, []::VARCHAR[], []::VARCHAR[]),
        ('search_knowledge_base', true, false, true, false, 3, ['t0', 't1', 't2'], []),
        ('cancel_order', true, false, false, true, 1, [], ['r0', 'r1']))
        AS p(tool_name, enabled, shadow_only, auto_execute, requires_confirmation,
             max_calls_per_request, allowed_tenant_ids, allowed_role_ids)""",
    "metric_events": """SELECT CASE event_type WHEN 'click' THEN 'API_REQUEST'
        WHEN 'view' THEN 'LLM_CALL' WHEN 'purchase' THEN 'RAG_NO_ANSWER'
        WHEN 'signup' THEN 'AGENT_MAX_STEPS' ELSE 'TOOL_FAILURE' END AS kind,
        CASE WHEN k % 5 = 0 THEN 500 ELSE 200 END AS status, k % 4 <> 0 AS success,
        floor(value)::INT AS tokens, ts FROM ev""",
    "workflow_states": f"""SELECT 'w' || user_id AS workflow_id, event_id, ts,
        {_sql_pick(STATES, 'k')} AS state, event_type AS event FROM ev""",
    "chat": """SELECT 'u' || conv_id % 5 AS user_id, conv_id::VARCHAR AS conversation_id,
        turn AS seq, role, CASE WHEN role = 'user' THEN text END AS user_message,
        CASE WHEN role = 'assistant' THEN text END AS assistant_message, text AS content
        FROM conversations""",
    "mutations": f"""SELECT source || '-' || doc_id % 5 AS document_id, doc_id AS mutation_id,
        {EPOCH} + doc_id * 60 AS ts, CASE WHEN doc_id % 7 = 0 THEN 'DELETE'
        WHEN doc_id % 5 = 0 THEN 'UPLOAD' ELSE 'UPDATE' END AS kind,
        (1 + n_chars // 500)::BIGINT AS chunks FROM documents""",
    "tasks": f"""SELECT 'k' || o_orderkey AS task_id, 'd' || o_custkey AS document_id,
        (1 + o_orderkey % 3)::INT AS document_version,
        {_sql_pick(TASK_STATUSES, 'o_orderkey')} AS status,
        CASE WHEN o_orderkey % 4 <> 0 THEN epoch(o_orderdate)::BIGINT + o_orderkey % 48 * 3600 END
          AS next_retry_at,
        CASE WHEN o_orderkey % 6 = 1 THEN epoch(o_orderdate)::BIGINT + o_orderkey % 1000 END
          AS locked_at, NULL::VARCHAR AS error_code,
        epoch(o_orderdate)::BIGINT AS created_at FROM orders""",
    "task_documents": """SELECT 'd' || c_custkey AS document_id,
        (1 + c_custkey % 3)::INT AS current_version FROM customer""",
    "attempts": f"""SELECT 'k' || user_id || '-' || k % 20 AS task_id, event_id AS attempt_id, ts,
        {_sql_pick(ATTEMPT_CODES, 'event_id')} AS error_code FROM ev""",
    "created": """SELECT 'c' || event_id AS confirmation_id, 'u' || user_id AS user_id,
        ts AS created_at FROM ev WHERE event_type = 'purchase'""",
    "confirmed": """SELECT 'c' || event_id AS confirmation_id,
        'u' || CASE WHEN k % 4 = 1 THEN user_id + 1 ELSE user_id END AS user_id,
        ts + to_seconds(k * 6) AS confirmed_at FROM ev
        WHERE event_type = 'purchase' AND k % 4 <> 0""",
    "kb_orders": """SELECT o_orderkey::VARCHAR AS order_id, 'u' || o_custkey AS owner_id,
        CASE WHEN o_orderstatus = 'F' THEN 'SHIPPED' ELSE 'NOT_SHIPPED' END AS status
        FROM orders""",
    "order_requests": """SELECT l_orderkey || '-' || l_linenumber AS request_id,
        'u' || CASE WHEN l_linenumber % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS user_id,
        CASE WHEN l_linenumber = 1 THEN l_orderkey + 100000000 ELSE l_orderkey END::VARCHAR
          AS order_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "pages_markdown": """SELECT page_id::VARCHAR AS document_id, (1 + page_id % 3)::INT AS version,
        regexp_replace(""" + "".join("regexp_replace(" for _ in range(6)) + """regexp_replace(html,
          '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')""" + "".join(
            f", '<h{n}[^>]*>', chr(10) || '{'#' * n} ', 'g')" for n in range(1, 7)) + """,
          '<[^>]*>', chr(10), 'g') AS content FROM pages""",
}

_NEEDS = {
    "kb_chunks": ["kb_docs"], "live_chunks": ["kb_chunks", "kb_docs"],
    "dense_queries": ["label_centroids"], "text_queries": ["label_centroids"],
    **{name: ["ev"] for name in ("usage", "calls", "tool_calls", "agent_steps", "metric_events",
                                 "workflow_states", "attempts", "created", "confirmed")},
}


def with_views(names: str, body: str, **extra: str) -> str:
    """SQL text that defines the named views (and ``extra`` ones, in order) before ``body``."""
    ordered: list[str] = []

    def add(name):
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS ({SQL[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
