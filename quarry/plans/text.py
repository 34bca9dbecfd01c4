"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.functions import tools as U
from quarry.functions.vectors import format_vector, norm, parse_vector
from quarry.plans import bindings as B
from quarry.plans.registry import query

_CJK = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}]"
_BLANK = "[\\t-\\r\\x1c-\\x20\\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200a}\\x{2028}\\x{2029}\\x{205f}\\x{3000}]"


def sql_tokens(text: str) -> str:
    """Token estimate of a SQL expression."""
    other = (f"length(regexp_replace(regexp_replace({text}, '{_CJK}', '', 'g'), '{_BLANK}', '', 'g'))"
             f" + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g'))")
    cjk = f"length(regexp_replace({text}, '{_CJK.replace('[', '[^', 1)}', '', 'g'))"
    return (f"CASE WHEN {text} IS NULL OR {text} = '' THEN 0 ELSE greatest(1, "
            f"ceil({cjk} / 1.5) + ceil(({other}) / 4.0))::INT END")


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


_LABELLED = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text
    WHEN 1 THEN '用户问题：' || text || '。退款政策！' ELSE '第一段 ' || text || ' 结束' END AS text
    FROM documents"""


def labelled(spark, sf_dir):
    """Documents, two thirds of them wrapped in Chinese phrases."""
    n = F.col("doc_id")
    text = (F.when(n % 3 == 0, F.col("text"))
            .when(n % 3 == 1, F.concat(F.lit("用户问题："), "text", F.lit("。退款政策！")))
            .otherwise(F.concat(F.lit("第一段 "), "text", F.lit(" 结束"))))
    return B.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("token_estimate", f"""SELECT doc_id, {sql_tokens('text')} AS tokens
    FROM ({_LABELLED})""")
def token_estimate(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", T.token_estimate("text").alias("tokens"))


@query("sha256_hex", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def sha256_hex(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.sha256_hex("text").alias("hash"))


_IDS = """SELECT page_id, list_filter(regexp_extract_all(url,
      '\\b([A-Za-z0-9][A-Za-z0-9_-]{2,63})\\b', 1), lambda x: regexp_matches(x, '[_-]|^ORD|[0-9]{3}'))
    AS found FROM pages"""


@query("extract_order_id", f"SELECT page_id, found[1] AS order_id FROM ({_IDS})")
def extract_order_id(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", T.order_id("url").alias("order_id"))


_FENCED = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '  ```json' || chr(10) || props || chr(10)
      || '```  ' WHEN 1 THEN props || '```' ELSE chr(10) || props || chr(9) END AS raw FROM events"""


def fenced(spark, sf_dir):
    n = F.col("event_id")
    raw = (F.when(n % 3 == 0, F.concat(F.lit("  ```json\n"), "props", F.lit("\n```  ")))
           .when(n % 3 == 1, F.concat("props", F.lit("```")))
           .otherwise(F.concat(F.lit("\n"), "props", F.lit("\t"))))
    return B.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def sql_clean(raw: str) -> str:
    opened = sql_strip(f"regexp_replace({sql_strip(raw)}, '^```json', '')")
    return sql_strip(f"regexp_replace({opened}, '```$', '')")


@query("clean_json", f"SELECT event_id, {sql_clean('raw')} AS json FROM ({_FENCED})")
def clean_json(spark, sf_dir):
    return fenced(spark, sf_dir).select("event_id", T.clean_json("raw").alias("json"))


_INTENTS = """SELECT event_id, CASE event_type
      WHEN 'click' THEN '{"intent":" chat ","confidence":' || (k / 100.0)::VARCHAR || '}'
      WHEN 'view' THEN '```json{"intent":"rag_query","confidence":' || k || '}```'
      WHEN 'signup' THEN '{"intent":"weather","confidence":0.5}'
      WHEN 'error' THEN '{"intent":"order_query"}' ELSE 'not json' END AS raw FROM ev"""


def intents(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k")
    raw = (F.when(kind == "click", F.concat(F.lit('{"intent":" chat ","confidence":'),
                                            (k / 100.0).cast("string"), F.lit("}")))
           .when(kind == "view", F.concat(F.lit('```json{"intent":"rag_query","confidence":'),
                                          k.cast("string"), F.lit("}```")))
           .when(kind == "signup", '{"intent":"weather","confidence":0.5}')
           .when(kind == "error", '{"intent":"order_query"}').otherwise("not json"))
    return B._events(spark, sf_dir).select("event_id", raw.alias("raw"))


@query("validate_intent", B.with_views("ev", """SELECT event_id, intent, confidence,
      CASE WHEN NOT is_object THEN 'INVALID_JSON' WHEN coalesce(intent, '') = '' THEN 'INTENT_BLANK'
        WHEN intent NOT IN ('chat', 'rag_query', 'order_query') THEN 'INTENT_UNKNOWN'
        WHEN confidence IS NULL THEN 'CONFIDENCE_MISSING'
        WHEN confidence < 0 OR confidence > 1 THEN 'CONFIDENCE_RANGE' END AS error_code
    FROM (SELECT event_id, is_object, CASE WHEN is_object THEN trim(json_extract_string(json, '$.intent'))
        END AS intent, CASE WHEN is_object THEN json_extract_string(json, '$.confidence')::DOUBLE END
        AS confidence FROM (SELECT *, CASE WHEN json_valid(json) THEN json_type(json) = 'OBJECT'
          ELSE false END AS is_object FROM cleaned))""",
    raws=_INTENTS, cleaned=f"SELECT event_id, {sql_clean('raw')} AS json FROM raws"))
def validate_intent(spark, sf_dir):
    checked = intents(spark, sf_dir).withColumn("v", U.validate_intent("raw"))
    return checked.select("event_id", "v.intent", "v.confidence", "v.error_code")


_DECISIONS = """SELECT event_id, CASE event_id % 5
      WHEN 0 THEN '{"answer":"done"}'
      WHEN 1 THEN '{"toolCall":{"toolName":"query_order","arguments":{"orderId":"ORD' || k || '"}}}'
      WHEN 2 THEN '{"toolCalls":[{"toolName":"cancel_order"}]}'
      WHEN 3 THEN '{"toolCalls":[{"toolName":"a"},{"toolName":"b"}]}' ELSE '{broken' END AS raw
    FROM ev"""


@query("parse_tool_decision", B.with_views("ev", """SELECT event_id, event_id % 5 < 3 AS valid,
      CASE WHEN event_id % 5 = 0 THEN json_extract_string(raw, '$.answer') END AS answer,
      CASE event_id % 5 WHEN 1 THEN json_extract_string(raw, '$.toolCall.toolName')
        WHEN 2 THEN json_extract_string(raw, '$.toolCalls[0].toolName') END AS tool_name,
      CASE event_id % 5 WHEN 1 THEN json_extract(raw, '$.toolCall.arguments')::VARCHAR END AS arguments
    FROM raws""", raws=_DECISIONS))
def parse_tool_decision(spark, sf_dir):
    n = F.col("event_id")
    raw = (F.when(n % 5 == 0, '{"answer":"done"}')
           .when(n % 5 == 1, F.concat(
               F.lit('{"toolCall":{"toolName":"query_order","arguments":{"orderId":"ORD'),
               F.col("k").cast("string"), F.lit('"}}}')))
           .when(n % 5 == 2, '{"toolCalls":[{"toolName":"cancel_order"}]}')
           .when(n % 5 == 3, '{"toolCalls":[{"toolName":"a"},{"toolName":"b"}]}')
           .otherwise("{broken"))
    parsed = B._events(spark, sf_dir).select("event_id", U.parse_tool_decision(raw).alias("d"))
    return parsed.select("event_id", "d.valid", "d.answer", "d.tool_name", "d.arguments")


_ARGS = """SELECT call_id, tool_name, arguments, is_object,
      CASE WHEN is_object THEN json_keys(arguments) ELSE [] END AS keys,
      CASE WHEN is_object THEN json_extract_string(arguments, '$.orderId') END AS o,
      CASE WHEN is_object THEN json_extract_string(arguments, '$.query') END AS q,
      CASE WHEN is_object THEN json_extract_string(arguments, '$.topK') END AS t
    FROM (SELECT *, CASE WHEN json_valid(arguments) THEN json_type(arguments) = 'OBJECT'
      ELSE false END AS is_object FROM tool_calls)"""


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("validate_tool_args", B.with_views("tool_calls", f"""SELECT call_id, CASE
      WHEN NOT is_object THEN 'VALIDATION_ERROR'
      WHEN list_has_any(keys, CASE WHEN tool_name = 'search_knowledge_base'
        THEN {_sql_list(C.FORBIDDEN_SEARCH_ARGS)} ELSE {_sql_list(C.FORBIDDEN_ARGS)} END)
        THEN 'PERMISSION_DENIED'
      WHEN len(list_filter(keys, lambda x: NOT list_contains(CASE
        WHEN tool_name = 'search_knowledge_base' THEN ['query', 'topK'] ELSE ['orderId'] END, x))) > 0
        THEN 'VALIDATION_ERROR'
      WHEN tool_name = 'search_knowledge_base' AND NOT (coalesce(trim(q), '') <> '' AND length(q) <= 500
        AND (t IS NULL OR coalesce(try_cast(t AS INT) BETWEEN 1 AND 10, false))) THEN 'VALIDATION_ERROR'
      WHEN tool_name <> 'search_knowledge_base' AND NOT coalesce(
        regexp_matches(o, '^[A-Za-z0-9_-]{{1,64}}$'), false) THEN 'VALIDATION_ERROR'
      END AS error_code FROM args""", args=_ARGS))
def validate_tool_args(spark, sf_dir):
    return B.tool_calls(spark, sf_dir).select(
        "call_id", U.validate_tool_args("tool_name", "arguments").alias("error_code"))


@query("args_hash_and_summary", B.with_views("tool_calls", """SELECT call_id,
      sha256(coalesce(arguments, '{}')) AS arguments_hash,
      CASE WHEN o IS NOT NULL AND trim(o) <> '' THEN 'orderId=' || o
        ELSE 'keys=[' || array_to_string(keys, ', ') || ']' END AS summary FROM args""", args=_ARGS))
def args_hash_and_summary(spark, sf_dir):
    return B.tool_calls(spark, sf_dir).select(
        "call_id", U.args_hash("arguments").alias("arguments_hash"),
        U.args_summary("arguments").alias("summary"))


@query("check_tool_permission", B.with_views("users", """SELECT user_id, tool_name, CASE
      WHEN tool_name = 'cancel_order' AND user_id[-1] NOT IN ('1', '3', '5', '7', '9')
        THEN 'CONFIRMATION_REQUIRED'
      WHEN NOT list_contains(permissions, permission_code) THEN 'PERMISSION_DENIED' END AS error_code
    FROM users, (VALUES ('query_order', 'order:query'), ('cancel_order', 'order:cancel'),
      ('search_knowledge_base', 'knowledge:search')) AS t(tool_name, permission_code)"""))
def check_tool_permission(spark, sf_dir):
    tools = F.array(*[F.struct(F.lit(t).alias("tool_name"), F.lit(p).alias("permission_code"))
                      for t, p in C.TOOL_PERMISSIONS.items()])
    asked = B.users(spark, sf_dir).select("user_id", "permissions", F.inline(tools))
    risk = F.when(F.col("tool_name") == "cancel_order", "HIGH").otherwise("LOW")
    confirmed = F.substring("user_id", -1, 1).isin("1", "3", "5", "7", "9")
    return asked.select("user_id", "tool_name", U.check_tool_permission(
        risk, confirmed, "permission_code", "permissions").alias("error_code"))


# each phrase that must not be shown, and one that may
_SHOWN = ("你是一个企业客服 Agent", "工具选择规则", "当前用户可用工具", "后端当前暴露给你的工具", "你必须只返回 JSON",
          "system prompt", "系统提示")


@query("prompt_leak", f"""SELECT doc_id, CASE WHEN doc_id % 14 < 6 OR text LIKE '%system prompt%'
      THEN '抱歉，当前回答包含不可展示的内部指令内容，请换一种问法重试。'
    WHEN doc_id % 14 = 6 THEN text || ' {_SHOWN[6]} ' || text ELSE text END AS answer FROM documents""")
def prompt_leak(spark, sf_dir):
    n = F.col("doc_id")
    answer = F.when(n % 14 < 7, F.concat("text", F.lit(" "), B.pick(_SHOWN, n % 14), F.lit(" "), "text")).otherwise(
        F.col("text"))
    return B.table(spark, sf_dir, "documents").select("doc_id", U.prompt_leak(answer)
                                                      .alias("answer"))


def _sql_any(words):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query("reply_intent", f"""SELECT conv_id, turn, CASE WHEN {_sql_any(C.CANCEL_WORDS)} THEN 'CANCEL'
    WHEN {_sql_any(C.CONFIRM_WORDS)} THEN 'CONFIRM' ELSE 'OTHER' END AS reply FROM conversations""")
def reply_intent(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", U.reply_intent("text").alias("reply"))


@query("refund_eligibility", B.with_views("kb_orders", """SELECT order_id,
    CASE WHEN status = 'SHIPPED' THEN 'REJECTED' ELSE 'WAITING_CONFIRMATION' END AS next_state
    FROM kb_orders"""))
def refund_eligibility(spark, sf_dir):
    return B.orders(spark, sf_dir).select(
        "order_id", U.refund_eligibility("status").alias("next_state"))


@query("has_text_and_normalize_list", """SELECT conv_id, turn, regexp_matches(text, '\\S') AS has_text,
      array_to_string(list_transform(list_distinct_ordered, lambda x: x), '|') AS words FROM (
    SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(
        string_split(text, ' '), lambda x: regexp_matches(x, '\\S')), lambda x: [x])),
      lambda acc, x: CASE WHEN list_contains(acc, trim_all(x[1])) THEN acc
        ELSE list_append(acc, trim_all(x[1])) END) AS list_distinct_ordered FROM conversations)"""
       .replace("trim_all(x[1])", sql_strip("x[1]")))
def has_text_and_normalize_list(spark, sf_dir):
    words = T.normalize_list(F.split("text", " "))
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.has_text("text").alias("has_text"),
        F.array_join(words, "|").alias("words"))


_RESULTS = """SELECT event_id, event_type, CASE event_type
      WHEN 'click' THEN '{"orderId":"ORD' || k || '","status":"PAID","amount":199.9}'
      WHEN 'view' THEN '{"answerable":true,"retrievedCount":' || k || ',"sources":[1,2]}'
      WHEN 'error' THEN NULL ELSE props END AS json FROM ev"""


@query("result_summary", B.with_views("ev", """SELECT event_id, CASE WHEN json IS NULL THEN 'null'
      WHEN event_type = 'click' THEN 'orderId=' || json_extract_string(json, '$.orderId') ||
        ',status=' || json_extract_string(json, '$.status') || ',amount=' ||
        json_extract_string(json, '$.amount')
      WHEN event_type = 'view' THEN 'answerable=' || json_extract_string(json, '$.answerable') ||
        ',retrievedCount=' || json_extract_string(json, '$.retrievedCount') || ',sourceCount=' ||
        json_array_length(json, '$.sources')
      ELSE 'type=other,stringLength=' || length(json) END AS summary FROM results""",
    results=_RESULTS))
def result_summary(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k").cast("string")
    json = (F.when(kind == "click", F.concat(F.lit('{"orderId":"ORD'), k, F.lit(
        '","status":"PAID","amount":199.9}')))
        .when(kind == "view", F.concat(F.lit('{"answerable":true,"retrievedCount":'), k,
                                       F.lit(',"sources":[1,2]}')))
        .when(kind != "error", F.col("props")))
    tool = (F.when(kind == "click", "query_order").when(kind == "view", "search_knowledge_base")
            .otherwise("other"))
    return B._events(spark, sf_dir).select("event_id", U.result_summary(tool, json)
                                           .alias("summary"))


@query("conversation_summary", B.with_views("ev", """SELECT event_id, CASE event_type
      WHEN 'click' THEN 'orderId=ORD' || k || ', status=PAID, amount=199.9'
      WHEN 'error' THEN 'orderId=null, status=null, amount='
      ELSE 'orderId=' || coalesce(json_extract_string(json, '$.orderId'), '') || ', status=' ||
        coalesce(json_extract_string(json, '$.status'), '') END AS summary
    FROM (SELECT r.*, k FROM results r JOIN ev USING (event_id))""", results=_RESULTS))
def conversation_summary(spark, sf_dir):
    """The summary a conversation keeps; errors are order queries without a result."""
    kind, k = F.col("event_type"), F.col("k").cast("string")
    json = (F.when(kind == "click", F.concat(F.lit('{"orderId":"ORD'), k, F.lit('","status":"PAID","amount":199.9}')))
            .when(kind == "view", F.concat(F.lit('{"answerable":true,"retrievedCount":'), k, F.lit(',"sources":[1,2]}')))
            .when(kind != "error", F.col("props")))
    tool = F.when(kind.isin("click", "error"), "query_order").otherwise("other")
    return B._events(spark, sf_dir).select("event_id", U.conversation_summary(tool, json).alias("summary"))


@query("file_names_and_types", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown'
      ELSE source || '.MD' END AS filename, CASE WHEN doc_id % 4 = 0 THEN 'application/octet-stream'
      ELSE 'text/' || lower(lang) END AS content_type FROM documents""")
def file_names_and_types(spark, sf_dir):
    n = F.col("doc_id")
    path = (F.when(n % 9 == 0, F.lit("  ")).when(n % 2 == 0, F.concat(
        F.lit("C:\\docs\\"), "source", F.lit(".MD"))).otherwise(
            F.concat(F.lit("/srv/docs/"), "source", F.lit(".MD"))))
    mime = F.when(n % 4 != 0, F.concat(F.lit("TEXT/"), F.upper("lang")))
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", T.file_basename(path).alias("filename"),
        T.content_type_norm(mime).alias("content_type"))


@query("previews", f"""SELECT doc_id, left(text, 100) AS preview,
      CASE WHEN length(text) > 220 THEN left(text, 220) || '...' ELSE text END AS snippet,
      left(text, 500) AS context,
      left({sql_strip("regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")}, 260) AS collapsed
    FROM documents""")
def previews(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", T.preview("text").alias("preview"), T.snippet("text").alias("snippet"),
        T.limit_text("text", C.CONTEXT_CHARS).alias("context"),
        T.collapse_ws("text").alias("collapsed"))


@query("prompt_text", """SELECT conv_id, turn, '问题：' || chr(10) || text || chr(10) || chr(10) ||
      '资料：' || chr(10) || role AS prompt, length(text) > 200 AS too_long FROM conversations""")
def prompt_text(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.prompt_text("text", "role").alias("prompt"),
        T.input_too_long("text", 200).alias("too_long"))


@query("iso_instant", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch(date_trunc('second', ts))
      ::BIGINT END AS seconds, event_id % 3 <> 1 AS valid FROM events""")
def iso_instant(spark, sf_dir):
    n = F.col("event_id")
    raw = (F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(n % 3 == 1, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise("  "))
    return B.table(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds(T.iso_instant(raw)).alias("seconds"),
        T.iso_instant_valid(raw).alias("valid"))


@query("error_codes", B.with_views("attempts tool_calls", f"""SELECT attempt_id::VARCHAR AS id, error_code AS raw,
      error_code AS code, error_code IN ({", ".join(f"'{c}'" for c in C.RETRYABLE_CODES)}) AS retryable
    FROM attempts UNION ALL SELECT call_id, error_code, CASE WHEN coalesce(trim(error_code), '') = ''
      THEN 'TOOL_EXECUTION_FAILED' WHEN error_code = 'TOOL_NOT_FOUND' THEN 'UNKNOWN_TOOL'
      WHEN error_code = 'ORDER_NOT_FOUND' THEN 'BUSINESS_REJECTED' ELSE error_code END,
      coalesce(error_code = 'TIMEOUT', false) FROM tool_calls"""))
def error_codes(spark, sf_dir):
    failed = B.attempts(spark, sf_dir).select(F.col("attempt_id").cast("string").alias("id"),
                                              F.col("error_code").alias("raw"))
    called = B.tool_calls(spark, sf_dir).select(F.col("call_id").alias("id"),
                                                F.col("error_code").alias("raw"))
    return failed.unionByName(called).select(
        "id", "raw", U.error_code_norm("raw").alias("code"),
        U.classify_error("raw").alias("retryable"))


@query("state_text", f"""SELECT conv_id, turn, left('conversation_state:' || chr(10) ||
      'conversationId=' || conv_id || chr(10) || 'userId=u' || conv_id % 5 || chr(10) ||
      CASE WHEN turn % 2 = 0 THEN 'currentOrderId=ORD' || conv_id || chr(10) ELSE '' END ||
      'lastToolName=query_order' || chr(10) || 'lastToolResultSummary=' || text || chr(10) ||
      'allowedTools=[query_order, cancel_order]' || chr(10) ||
      'instruction={C.STATE_INSTRUCTION}' || chr(10), 1000) AS state FROM conversations""")
def state_text(spark, sf_dir):
    n = F.col("conv_id").cast("string")
    order = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("ORD"), n))
    tools = F.array(F.lit("query_order"), F.lit("cancel_order"))
    state = U.state_text(n, B.tag("u", F.col("conv_id") % 5), order, F.lit(" "),
                         F.lit("query_order"), "text", tools)
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("state"))


@query("tokenize", """SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')
    AS terms FROM documents""")
def tokenize(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(T.tokenize("text"), " ").alias("terms"))


@query("vector_codec", """SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(
    embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings""")
def vector_codec(spark, sf_dir):
    rows = B.table(spark, sf_dir, "embeddings").withColumn(
        "text", format_vector(F.col("embedding").cast("array<double>")))
    back = rows.withColumn("vector", parse_vector("text"))
    return back.select("vec_id", F.size("vector").cast("long").alias("dim"),
                       F.round(norm("vector"), 6).alias("norm"))
