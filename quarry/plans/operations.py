"""Queries for usage, limits, agents, workflows and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import agents as G
from quarry.operators import history as H
from quarry.operators import usage as S
from quarry.plans import bindings as B
from quarry.plans.registry import query
from quarry.plans.text import sql_tokens

# ---- usage --------------------------------------------------------------------------------------

_SUMS = """count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens,
    sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
    sum(cached_tokens)::BIGINT AS cached_tokens, round(sum(estimated_cost)::DOUBLE, 6) AS estimated_cost"""


@query("usage_summary", B.with_views("usage", f"""SELECT model, interface_name, {_SUMS} FROM usage
    GROUP BY model, interface_name ORDER BY model, interface_name"""))
def usage_summary(spark, sf_dir):
    return S.usage_summary(B.usage(spark, sf_dir)).withColumn(
        "estimated_cost", F.round("estimated_cost", 6))


@query("usage_summary_tenant_range", B.with_views("usage", f"""SELECT model, interface_name, {_SUMS}
    FROM usage WHERE tenant_id = 't1' AND created_at >= TIMESTAMP '2024-01-10 00:00:00'
      AND created_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY model, interface_name"""))
def usage_summary_tenant_range(spark, sf_dir):
    rows = S.usage_summary(
        B.usage(spark, sf_dir), "t1", F.to_timestamp(F.lit("2024-01-10 00:00:00")),
        F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return rows.withColumn("estimated_cost", F.round("estimated_cost", 6))


@query("usage_totals", B.with_views("usage", f"""SELECT model, interface_name,
    grouping(model, interface_name)::BIGINT AS level, {_SUMS} FROM usage
    GROUP BY ROLLUP (model, interface_name)"""))
def usage_totals(spark, sf_dir):
    return S.usage_totals(B.usage(spark, sf_dir)).withColumn(
        "estimated_cost", F.round("estimated_cost", 6))


_RAW = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'FAST' ELSE 'EMBEDDING' END AS tier,
    CASE WHEN turn % 3 <> 0 THEN role END AS model_name, role AS instructions, text AS message,
    left(text, 80) AS answer, CASE WHEN turn % 4 = 1 THEN length(text) END AS prompt_tokens,
    CASE WHEN turn % 4 = 2 THEN -5 ELSE NULL END AS completion_tokens,
    CASE WHEN turn % 5 = 3 THEN 777 END AS total_tokens, turn - 2 AS cached_tokens FROM conversations"""


@query("cost_rows", f"""SELECT conv_id, turn, prompt_tokens, completion_tokens, total_tokens, cached_tokens,
      (total_tokens * 0.000001)::DECIMAL(18, 6)::DOUBLE AS estimated_cost, model FROM (
    SELECT conv_id, turn, p::BIGINT AS prompt_tokens, c::BIGINT AS completion_tokens,
      CASE WHEN total_tokens > 0 THEN total_tokens ELSE p + c END AS total_tokens,
      greatest(0, coalesce(cached_tokens, 0)) AS cached_tokens,
      tier || ':' || coalesce(model_name, 'default') AS model FROM (SELECT *,
        CASE WHEN prompt_tokens > 0 THEN prompt_tokens ELSE {sql_tokens('instructions')} + {sql_tokens('message')}
          END AS p, CASE WHEN completion_tokens > 0 THEN completion_tokens ELSE {sql_tokens('answer')} END AS c
        FROM ({_RAW})))""")
def cost_rows(spark, sf_dir):
    turn = F.col("turn")
    raw = B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(turn % 2 == 0, "FAST").otherwise("EMBEDDING").alias("tier"),
        F.when(turn % 3 != 0, F.col("role")).alias("model_name"), F.col("role")
        .alias("instructions"), F.col("text").alias("message"),
        F.substring("text", 1, 80).alias("answer"),
        F.when(turn % 4 == 1, F.length("text")).cast("long").alias("prompt_tokens"),
        F.when(turn % 4 == 2, -5).cast("long").alias("completion_tokens"),
        F.when(turn % 5 == 3, 777).cast("long").alias("total_tokens"),
        (turn - 2).alias("cached_tokens"))
    return S.cost_rows(raw).withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@query("cache_savings", B.with_views("usage", """SELECT interface_name, calls, p AS prompt_tokens,
      c AS cached_tokens, round(l, 6) AS avg_latency_ms, round(c / p::DOUBLE, 6) AS hit_ratio,
      round((p - c) + c * 0.2::DOUBLE, 6) AS billed_tokens,
      round((1 - ((p - c) + c * 0.2::DOUBLE) / p) * 100, 6) AS saved_pct FROM (
    SELECT interface_name, count(*) AS calls, sum(prompt_tokens)::BIGINT AS p, sum(cached_tokens)::BIGINT AS c,
      avg(latency_ms) AS l FROM usage GROUP BY 1)"""))
def cache_savings(spark, sf_dir):
    rows = S.cache_savings(B.usage(spark, sf_dir), ["interface_name"])
    return rows.withColumns({c: F.round(c, 6) for c in (
        "avg_latency_ms", "hit_ratio", "billed_tokens", "saved_pct")})


@query("cache_hit_ratio", B.with_views("usage", """SELECT request_id, CASE WHEN prompt_tokens > 0 THEN
    round(cached_tokens / prompt_tokens::DOUBLE, 3) END AS ratio FROM usage"""))
def cache_hit_ratio(spark, sf_dir):
    return B.usage(spark, sf_dir).select("request_id", F.round(S.cache_hit_ratio(), 3)
                                         .alias("ratio"))


@query("prefix_cacheability", f"""SELECT sha256(text) AS prefix_hash, count(*) AS calls,
      any_value(tokens)::INT AS prefix_tokens, any_value(tokens) >= 1024 AS cacheable
    FROM (SELECT text, {sql_tokens('text')} AS tokens FROM documents) GROUP BY text""")
def prefix_cacheability(spark, sf_dir):
    return S.prefix_cacheability(B.table(spark, sf_dir, "documents").select(
        F.col("text").alias("prefix")))


@query("dedup_rate", """SELECT lang AS model, sum(n)::BIGINT AS requests, count(*) AS distinct_texts,
      sum(size)::BIGINT AS tokens_sent, sum(size * (n - 1))::BIGINT AS tokens_saved,
      (sum(n) - count(*))::BIGINT AS hits, round((sum(n) - count(*)) / sum(n)::DOUBLE, 6) AS hit_rate
    FROM (SELECT lang, text, count(*) AS n, greatest(1, ceil(length(text) / 4.0))::BIGINT AS size
      FROM documents GROUP BY lang, text) GROUP BY lang""")
def dedup_rate(spark, sf_dir):
    requests = B.table(spark, sf_dir, "documents").select(F.col("lang").alias("model"), "text")
    return S.dedup_rate(requests).withColumn("hit_rate", F.round("hit_rate", 6))


# ---- limits -------------------------------------------------------------------------------------

@query("rate_limit", B.with_views("calls", """SELECT call_id, minute, call_no, call_no > 1 AS rejected FROM (
    SELECT call_id, epoch(ts)::BIGINT // 60 AS minute, row_number() OVER (PARTITION BY tenant_id,
      interface_name, floor(epoch(ts) / 60) ORDER BY ts, call_id) AS call_no FROM calls)"""
    .replace("epoch(ts)::BIGINT // 60", "floor(epoch(ts) / 60)::BIGINT")))
def rate_limit(spark, sf_dir):
    # callers are tenants here, so that minutes hold more than one call
    calls = B.calls(spark, sf_dir).withColumn("user_id", F.col("tenant_id"))
    return S.rate_limit(calls, 1).select("call_id", "minute", "call_no", "rejected")


@query("daily_call_cap", B.with_views("calls", """SELECT call_id, strftime(day, '%Y-%m-%d') AS day, call_no,
      call_no <= 300 AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, call_id)
        AS call_no FROM (SELECT *, date_trunc('day', ts + INTERVAL 8 HOUR) AS day FROM calls))"""))
def daily_call_cap(spark, sf_dir):
    return S.daily_call_cap(B.calls(spark, sf_dir), 300).select(
        "call_id", F.col("day").cast("string").alias("day"), "call_no", "admitted")


@query("input_budget", f"""SELECT conv_id::VARCHAR AS call_id, sum(tokens)::BIGINT + 2 AS prompt_estimate,
      sum(tokens) + 2 > 250 AS rejected FROM (SELECT conv_id, {sql_tokens('text')} AS tokens
      FROM conversations) GROUP BY conv_id""")
def input_budget(spark, sf_dir):
    messages = B.chat(spark, sf_dir).select(F.col("conversation_id").alias("call_id"), "content")
    calls = messages.select("call_id").distinct().withColumn("instructions", F.lit("be short"))
    return S.input_budget(calls, messages, 250)


#: The calls of each tenant-day one after the other, with what the tenant and each user have spent.
SQL_QUOTA = B.with_views("calls", """SELECT call_id, tenant_id, user_id, need, charge, admitted
    FROM walk WHERE n > 0""", numbered="""SELECT *, ts::DATE AS day,
      row_number() OVER (PARTITION BY tenant_id, ts::DATE ORDER BY ts, call_id) AS n FROM calls""",
    walk="""SELECT DISTINCT tenant_id, day, 0::BIGINT AS n, 0::BIGINT AS spent, MAP {}::MAP(VARCHAR, BIGINT) AS users,
      ''::VARCHAR AS call_id, ''::VARCHAR AS user_id, 0::BIGINT AS need, 0::BIGINT AS charge, false AS admitted
      FROM numbered
    UNION ALL SELECT tenant_id, day, n, spent + CASE WHEN admitted THEN charge ELSE 0 END, CASE WHEN admitted
        THEN map_from_entries(list_concat(list_filter(map_entries(users), lambda x: x.key <> user_id),
          [{'key': user_id, 'value': mine + charge}])) ELSE users END, call_id, user_id, need, charge, admitted
      FROM (SELECT *, mine + need <= 2500 AND spent + need <= 8000 AS admitted FROM (
        SELECT c.tenant_id, c.day, c.n, w.spent, w.users, c.call_id, c.user_id, c.need, c.charge,
          coalesce(list_extract(map_extract(w.users, c.user_id), 1), 0) AS mine
        FROM walk w JOIN numbered c ON c.tenant_id = w.tenant_id AND c.day = w.day AND c.n = w.n + 1))"""
    ).replace("WITH", "WITH RECURSIVE", 1)


@query("token_quota", SQL_QUOTA)
def token_quota(spark, sf_dir):
    rows = S.token_quota(B.calls(spark, sf_dir), 2500, 8000)
    return rows.select("call_id", "tenant_id", "user_id", "need", "charge", "admitted")


# ---- agents -------------------------------------------------------------------------------------

_COUNTERS = """count(*) FILTER (kind = 'API_REQUEST') AS api_requests,
    count(*) FILTER (kind = 'API_REQUEST' AND status >= 400) AS api_errors,
    count(*) FILTER (kind = 'LLM_CALL') AS llm_calls,
    count(*) FILTER (kind = 'LLM_CALL' AND NOT success) AS llm_errors,
    coalesce(sum(CASE WHEN kind = 'LLM_CALL' THEN greatest(0, tokens) END), 0)::BIGINT AS total_tokens,
    count(*) FILTER (kind = 'RAG_NO_ANSWER') AS no_answers,
    count(*) FILTER (kind = 'AGENT_MAX_STEPS') AS max_steps,
    count(*) FILTER (kind = 'TOOL_FAILURE') AS tool_failures"""
_RATES = """CASE WHEN llm_calls > 0 THEN llm_errors / llm_calls::DOUBLE ELSE 0 END AS llm_error_rate,
    CASE WHEN api_requests > 0 THEN no_answers / api_requests::DOUBLE ELSE 0 END AS no_answer_rate"""


@query("metrics_snapshot", B.with_views("metric_events", f"""SELECT * EXCLUDE (llm_error_rate, no_answer_rate),
      round(llm_error_rate, 6) AS llm_error_rate, round(no_answer_rate, 6) AS no_answer_rate FROM (
    SELECT *, {_RATES} FROM (SELECT {_COUNTERS} FROM metric_events))"""))
def metrics_snapshot(spark, sf_dir):
    rows = G.metrics_snapshot(B.metric_events(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("llm_error_rate", "no_answer_rate")})


SQL_ALERTS = """SELECT KEY, 'LLM_ERROR_RATE' AS alert, round(llm_error_rate, 6) AS value FROM rated
      WHERE llm_calls > 0 AND llm_error_rate > 0.2 UNION ALL
    SELECT KEY, 'RAG_NO_ANSWER_RATE', round(no_answer_rate, 6) FROM rated
      WHERE api_requests > 0 AND no_answer_rate > 0.3 UNION ALL
    SELECT KEY, 'AGENT_MAX_STEPS', max_steps::DOUBLE FROM rated WHERE max_steps > 5 UNION ALL
    SELECT KEY, 'TOKEN_USAGE', total_tokens::DOUBLE FROM rated WHERE total_tokens > 1000"""


@query("alert_rows", B.with_views("metric_events", SQL_ALERTS.replace("KEY", "hour"),
    rated=f"""SELECT *, {_RATES} FROM (SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, {_COUNTERS}
      FROM metric_events GROUP BY 1)"""))
def alert_rows(spark, sf_dir):
    hours = B.metric_events(spark, sf_dir).groupBy(
        F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(*G.metric_counters())
    rows = G.alert_rows(hours.select("*", *G.metric_rates()), max_tokens=1000)
    return rows.withColumn("value", F.round("value", 6))


def _generations(spark, sf_dir):
    return B.usage(spark, sf_dir).select(
        F.concat("user_id", F.lit("-"), F.date_format("created_at", "yyyyMMdd"))
        .alias("request_id"), F.col("request_id").alias("call_id"),
        F.col("interface_name").alias("name"), "model",
        F.when(F.col("prompt_tokens") > 2, F.col("prompt_tokens")).alias("prompt_tokens"),
        "completion_tokens", "latency_ms", F.col("created_at").alias("ts"))


_GENERATIONS = """SELECT user_id || '-' || strftime(created_at, '%Y%m%d') AS request_id, request_id AS call_id,
    interface_name AS name, CASE WHEN prompt_tokens > 2 THEN prompt_tokens END + completion_tokens AS total,
    created_at AS ts, created_at - to_milliseconds(latency_ms) AS started FROM usage"""


@query("trace_rollup", B.with_views("usage", """SELECT request_id, count(*) AS generations,
      coalesce(sum(total), 0)::BIGINT AS total_tokens, epoch_us(min(started)) AS started_at,
      epoch_us(max(ts)) AS ended_at, arg_min(name, ts) AS first_name, arg_max(name, ts) AS last_name
    FROM gens GROUP BY request_id""", gens=_GENERATIONS))
def trace_rollup(spark, sf_dir):
    traces, _ = G.trace_rollup(_generations(spark, sf_dir))
    return traces.withColumns({c: F.unix_micros(c) for c in ("started_at", "ended_at")})


@query("trace_generations", B.with_views("usage", """SELECT request_id, call_id, total::BIGINT AS total_tokens,
      epoch_us(started) AS started_at, row_number() OVER (PARTITION BY request_id ORDER BY ts, call_id)
        AS generation_no FROM gens""", gens=_GENERATIONS))
def trace_generations(spark, sf_dir):
    _, rows = G.trace_rollup(_generations(spark, sf_dir))
    return rows.select("request_id", "call_id", F.col("total_tokens").cast("long"),
                       F.unix_micros("started_at").alias("started_at"), "generation_no")


@query("tool_call_stats", B.with_views("tool_calls", """SELECT tool_name, CASE WHEN success THEN 'OK'
      WHEN coalesce(error_code, '') = '' THEN 'TOOL_EXECUTION_FAILED'
      WHEN error_code = 'TOOL_NOT_FOUND' THEN 'UNKNOWN_TOOL'
      WHEN error_code = 'ORDER_NOT_FOUND' THEN 'BUSINESS_REJECTED' ELSE error_code END AS error_code,
      count(*) AS calls, count(*) FILTER (NOT success) AS failures,
      round(avg(elapsed_ms), 6) AS avg_elapsed_ms, max(elapsed_ms) AS max_elapsed_ms
    FROM tool_calls GROUP BY ALL"""))
def tool_call_stats(spark, sf_dir):
    rows = G.tool_call_stats(B.tool_calls(spark, sf_dir))
    return rows.withColumn("avg_elapsed_ms", F.round("avg_elapsed_ms", 6))


@query("agent_run_summary", B.with_views("agent_steps", """SELECT request_id, count(*) AS steps,
      count(*) FILTER (action_type = 'MODEL_CALL') AS model_calls,
      count(*) FILTER (action_type = 'TOOL_CALL') AS tool_calls,
      arg_max(stop_reason, step_index) FILTER (stop_reason IS NOT NULL) AS stop_reason,
      coalesce(arg_max(stop_reason, step_index) FILTER (stop_reason IS NOT NULL) = 'FINAL_ANSWER', false)
        AS success, sum(elapsed_ms)::BIGINT AS elapsed_ms FROM agent_steps GROUP BY request_id"""))
def agent_run_summary(spark, sf_dir):
    return G.agent_run_summary(B.agent_steps(spark, sf_dir))


@query("repeated_tool_calls", B.with_views("tool_calls", """SELECT call_id, n AS repeat_no,
      CASE WHEN n > 1 THEN 'DUPLICATE_TOOL_CALL' END AS duplicate_code FROM (SELECT *, row_number() OVER (
        PARTITION BY tenant_id, tool_name, arguments ORDER BY ts, call_id) AS n FROM tool_calls)"""))
def repeated_tool_calls(spark, sf_dir):
    calls = B.tool_calls(spark, sf_dir).withColumn("request_id", F.col("tenant_id"))
    return G.repeated_tool_calls(calls).select("call_id", "repeat_no", "duplicate_code")


@query("tool_rollout", B.with_views("tool_calls tool_policy", """SELECT call_id, n AS call_no,
      split_part(outcome, ':', 1) AS decision, nullif(split_part(outcome, ':', 2), '') AS reason FROM (
    SELECT *, CASE WHEN NOT coalesce(enabled, true) THEN 'BLOCKED:TOOL_DISABLED'
      WHEN len(coalesce(allowed_tenant_ids, [])) > 0 AND NOT list_contains(allowed_tenant_ids, tenant_id)
        THEN 'BLOCKED:TENANT_NOT_ALLOWED'
      WHEN len(coalesce(allowed_role_ids, [])) > 0 AND NOT list_has_any(allowed_role_ids, role_ids)
        THEN 'BLOCKED:ROLE_NOT_ALLOWED'
      WHEN max_calls_per_request > 0 AND n > max_calls_per_request
        THEN 'MAX_CALLS_EXCEEDED:MAX_CALLS_PER_REQUEST_EXCEEDED'
      WHEN coalesce(shadow_only, false) THEN 'SHADOW_ONLY:SHADOW_ONLY'
      WHEN coalesce(requires_confirmation, false) THEN 'CONFIRMATION_REQUIRED:REQUIRES_CONFIRMATION'
      WHEN NOT coalesce(auto_execute, true) THEN 'CONFIRMATION_REQUIRED:AUTO_EXECUTE_DISABLED'
      ELSE 'ALLOW:' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id, tool_name ORDER BY ts, call_id) AS n
      FROM tool_calls) c LEFT JOIN tool_policy p ON p.tool_name = c.tool_name)"""))
def tool_rollout(spark, sf_dir):
    return G.tool_rollout(B.tool_calls(spark, sf_dir), B.tool_policy(spark)).select(
        "call_id", "call_no", "decision", "reason")


@query("stop_reason", B.with_views("agent_steps", """SELECT request_id,
      arg_min(reason, step_index) FILTER (reason IS NOT NULL) AS stop_reason,
      min(step_index) FILTER (reason IS NOT NULL) AS stopped_at FROM (
    SELECT *, CASE WHEN action_type = 'MODEL_CALL' AND calls >= 3 THEN 'AGENT_MAX_STEPS_EXCEEDED'
      WHEN action_type = 'MODEL_CALL' AND elapsed > 10000 THEN 'AGENT_TIMEOUT'
      WHEN action_type = 'MODEL_CALL' AND calls >= 4 THEN 'AGENT_MAX_LLM_CALLS_EXCEEDED'
      WHEN action_type = 'TOOL_CALL' AND elapsed > 10000 THEN 'AGENT_TIMEOUT'
      WHEN NOT success THEN coalesce(error_code, CASE WHEN action_type = 'MODEL_CALL' THEN 'LLM_CALL_FAILED'
        ELSE 'TOOL_EXECUTION_FAILED' END)
      WHEN action_type = 'FINAL_ANSWER' THEN 'FINAL_ANSWER' END AS reason FROM (
    SELECT *, coalesce(sum(elapsed_ms) OVER w, 0) AS elapsed,
      coalesce(sum(CASE WHEN action_type = 'MODEL_CALL' THEN 1 ELSE 0 END) OVER w, 0) AS calls
    FROM agent_steps WINDOW w AS (PARTITION BY request_id ORDER BY step_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY request_id"""))
def stop_reason(spark, sf_dir):
    return G.stop_reason(B.agent_steps(spark, sf_dir))


_TRANSITIONS = """SELECT *, from_state || '>' || state IN ({}) AS legal, state IN ('DONE', 'REJECTED',
      'CANCELLED', 'FAILED') AS terminal FROM (SELECT *, CASE WHEN previous IS NULL OR previous IN
        ('DONE', 'REJECTED', 'CANCELLED', 'FAILED') THEN 'INIT' ELSE previous END AS from_state FROM (
    SELECT *, lag(state) OVER w AS previous, 1 + coalesce(sum(CASE WHEN state IN ('DONE', 'REJECTED',
        'CANCELLED', 'FAILED') THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session_no
    FROM workflow_states WINDOW w AS (PARTITION BY workflow_id ORDER BY ts, event_id)))
    WHERE from_state <> state""".format(", ".join(f"'{a}>{b}'" for a, b in G.C.WORKFLOW_EDGES))


@query("workflow_transitions", B.with_views("workflow_states", """SELECT workflow_id, event_id, from_state,
    state AS to_state, event, session_no::BIGINT AS session_no, legal, terminal FROM moves""",
    moves=_TRANSITIONS))
def workflow_transitions(spark, sf_dir):
    return G.workflow_transitions(B.workflow_states(spark, sf_dir)).select(
        "workflow_id", "event_id", "from_state", "to_state", "event", "session_no", "legal",
        "terminal")


@query("workflow_funnel", B.with_views("workflow_states", """SELECT from_state, state AS to_state,
    count(*) AS transitions, count(*) FILTER (legal) AS legal_transitions FROM moves GROUP BY ALL""",
    moves=_TRANSITIONS))
def workflow_funnel(spark, sf_dir):
    return G.workflow_funnel(G.workflow_transitions(B.workflow_states(spark, sf_dir)))


@query("recent_decisions", B.with_views("tool_calls", """SELECT call_id AS decision_id, tool_name,
    epoch_us(ts) AS created_at FROM tool_calls ORDER BY ts DESC, call_id DESC LIMIT 200"""))
def recent_decisions(spark, sf_dir):
    log = B.tool_calls(spark, sf_dir).select(
        F.col("call_id").alias("decision_id"), "tool_name", F.col("ts").alias("created_at"))
    return G.recent_decisions(log, 500).withColumn("created_at", F.unix_micros("created_at"))


@query("owned_orders", B.with_views("kb_orders order_requests", """SELECT request_id, verdict,
      CASE WHEN verdict = 'OK' THEN status END AS status FROM (SELECT r.request_id, o.status,
        CASE WHEN o.owner_id IS NULL THEN 'BUSINESS_REJECTED' WHEN o.owner_id = r.user_id
          OR r.order_id IN ('ORD001', 'ORD002', 'ORD202605220001', '123456') THEN 'OK'
          ELSE 'PERMISSION_DENIED' END AS verdict
      FROM order_requests r LEFT JOIN kb_orders o ON o.order_id = r.order_id)"""))
def owned_orders(spark, sf_dir):
    public = ("ORD001", "ORD002", "ORD202605220001", "123456")
    return G.owned_orders(B.order_requests(spark, sf_dir), B.orders(spark, sf_dir), public).select(
        "request_id", "verdict", "status")


SQL_OUTCOMES = """SELECT c.confirmation_id, c.user_id AS owner_id, CASE
      WHEN bool_or(f.user_id = c.user_id) THEN 'EXECUTED' WHEN count(f.user_id) > 0 THEN 'USER_MISMATCH'
      ELSE 'EXPIRED' END AS outcome
    FROM created c LEFT JOIN confirmed f ON f.confirmation_id = c.confirmation_id
      AND f.confirmed_at BETWEEN c.created_at AND c.created_at + INTERVAL 300 SECONDS GROUP BY ALL"""


@query("confirmations", B.with_views("created confirmed", SQL_OUTCOMES))
def confirmations(spark, sf_dir):
    return G.confirmations(*B.confirmation_events(spark, sf_dir)).select(
        "confirmation_id", "owner_id", "outcome")


# ---- conversations ------------------------------------------------------------------------------

@query("recent_turns", B.with_views("chat", """SELECT user_id, conversation_id, seq FROM chat
    QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 3"""))
def recent_turns(spark, sf_dir):
    return H.recent_turns(B.chat(spark, sf_dir), 3).select("user_id", "conversation_id", "seq")


@query("history_at_turn", B.with_views("chat", """SELECT conversation_id, seq, coalesce(string_agg(line, '')
      OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history
    FROM (SELECT *, coalesce('用户：' || user_message || chr(10), '') ||
      coalesce('助手：' || assistant_message || chr(10), '') AS line FROM chat)"""))
def history_at_turn(spark, sf_dir):
    return H.history_at_turn(B.chat(spark, sf_dir), 3, block=4).select(
        "conversation_id", "seq", "history")


@query("compression_schedule", B.with_views("chat", """SELECT conversation_id, seq,
      CASE WHEN n <= 4 THEN n ELSE 2 + (n - 5) % 3 END::INT AS retained,
      n > 4 AND (n - 5) % 3 = 0 AS compressed, CASE WHEN n <= 4 THEN 0 ELSE (n - 5) // 3 + 1 END::INT AS summaries
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS n FROM chat)"""))
def compression_schedule(spark, sf_dir):
    return H.compression_schedule(B.chat(spark, sf_dir), 2, 4, block=3).select(
        "conversation_id", "seq", "retained", "compressed", "summaries")


@query("truncate_chat", B.with_views("chat", """SELECT conversation_id, seq, role FROM chat
    QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 4"""))
def truncate_chat(spark, sf_dir):
    return H.truncate_chat(B.chat(spark, sf_dir), 4).select("conversation_id", "seq", "role")


@query("carry_entity", """SELECT user_id, event_id, last_value(found IGNORE NULLS) OVER (PARTITION BY user_id
      ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_order_id FROM (
    SELECT user_id, event_id, CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'ORD' || k
      WHEN event_type = 'view' AND k % 2 = 0 THEN 'A-' || k END AS found FROM (
      SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))""")
def carry_entity(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k")
    number = k.cast("string")
    said = F.when(k % 3 == 0, F.concat(F.lit("where is ORD"), number, F.lit(" now?"))).otherwise(
        F.lit("hello there you"))
    returned = F.concat(F.lit('{"orderId":"A-'), number, F.lit('"}'))
    events = B._events(spark, sf_dir).select(
        "user_id", F.lit("x").alias("conversation_id"), F.col("event_id").alias("seq"),
        F.when(kind == "click", "USER").when(kind == "view", "TOOL").otherwise("OTHER")
        .alias("kind"), F.when(kind == "click", said).otherwise(returned).alias("text"),
        (k % 2 == 0).alias("success"))
    return H.carry_entity(events, block=512).select(
        "user_id", F.col("seq").alias("event_id"), "current_order_id")
