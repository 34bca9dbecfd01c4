"""Agent logs: runs, tools, policies, workflows, traces, metrics and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import has_text
from quarry.functions.tools import args_hash, error_code_norm
from quarry.operators.skew import hour_of, running


def metrics_snapshot(events: DataFrame) -> DataFrame:
    """Eight counters and two rates over an event log: kind, status, success, tokens.

    ``kind`` is API_REQUEST, LLM_CALL, RAG_NO_ANSWER, AGENT_MAX_STEPS or TOOL_FAILURE.
    """
    return events.agg(*metric_counters()).select("*", *metric_rates())


def metric_counters() -> list[Column]:
    kind = F.col("kind")

    def count(condition, name):
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    tokens = F.when(kind == "LLM_CALL", F.greatest(F.lit(0), F.col("tokens")))
    return [
        count(kind == "API_REQUEST", "api_requests"),
        count((kind == "API_REQUEST") & (F.col("status") >= 400), "api_errors"),
        count(kind == "LLM_CALL", "llm_calls"),
        count((kind == "LLM_CALL") & ~F.col("success"), "llm_errors"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens"),
        count(kind == "RAG_NO_ANSWER", "no_answers"),
        count(kind == "AGENT_MAX_STEPS", "max_steps"),
        count(kind == "TOOL_FAILURE", "tool_failures"),
    ]


def metric_rates() -> list[Column]:
    def rate(part, whole, name):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0).alias(name)

    return [rate("llm_errors", "llm_calls", "llm_error_rate"),
            rate("no_answers", "api_requests", "no_answer_rate")]


def alert_rows(snapshots: DataFrame, max_llm_error_rate: float = C.MAX_LLM_ERROR_RATE,
               max_no_answer_rate: float = C.MAX_NO_ANSWER_RATE,
               max_steps: int = C.MAX_STEPS_ALERT,
               max_tokens: int = C.MAX_TOKENS_ALERT) -> DataFrame:
    """One row per fired rule of each snapshot: ``alert`` and ``value``. All limits are strict and a
    rate without a denominator never fires."""
    def rule(name, condition, value):
        found = F.struct(F.lit(name).alias("alert"), value.cast("double").alias("value"))
        return F.when(condition, found)

    rules = F.array_compact(F.array(
        rule("LLM_ERROR_RATE", (F.col("llm_calls") > 0)
             & (F.col("llm_error_rate") > max_llm_error_rate), F.col("llm_error_rate")),
        rule("RAG_NO_ANSWER_RATE", (F.col("api_requests") > 0)
             & (F.col("no_answer_rate") > max_no_answer_rate), F.col("no_answer_rate")),
        rule("AGENT_MAX_STEPS", F.col("max_steps") > max_steps, F.col("max_steps")),
        rule("TOKEN_USAGE", F.col("total_tokens") > max_tokens, F.col("total_tokens"))))
    counters = {"api_requests", "api_errors", "llm_calls", "llm_errors", "total_tokens",
                "no_answers", "max_steps", "tool_failures", "llm_error_rate", "no_answer_rate"}
    rest = [c for c in snapshots.columns if c not in counters]
    return snapshots.select(*rest, F.explode(rules).alias("__rule")).select(
        *rest, "__rule.alert", "__rule.value")


def trace_rollup(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, generations) of calls sharing a request id.

    ``calls``: request_id, call_id, name, model, prompt_tokens, completion_tokens, latency_ms, ts
    (its end). A generation's total exists only when both parts are known; it started
    ``latency_ms`` before its end. Generations stay rows, numbered per trace, so a trace of any
    length is never held in one place.
    """
    started = F.col("ts") - F.make_dt_interval(
        secs=F.greatest(F.lit(0), F.col("latency_ms")).cast("decimal(18,6)") / 1000)
    generations = running(calls, ["request_id"], ["ts", "call_id"], hour_of("ts"),
                          generation_no=("row_number", None))
    generations = (generations
                   .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
                   .withColumn("started_at", started))
    start = calls.withColumn("started_at", started)
    traces = start.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("generations"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0))
        .cast("long").alias("total_tokens"),
        F.min("started_at").alias("started_at"), F.max("ts").alias("ended_at"),
        F.min_by("name", F.struct("ts", "call_id")).alias("first_name"),
        F.max_by("name", F.struct("ts", "call_id")).alias("last_name"))
    return traces, generations


def tool_call_stats(tool_calls: DataFrame) -> DataFrame:
    """Per tool and error code: calls, failures and elapsed times. ``error_code`` OK is success."""
    code = F.when(F.col("success"), F.lit("OK")).otherwise(error_code_norm("error_code"))
    return (tool_calls.withColumn("__code", code).groupBy("tool_name", "__code").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failures"),
        F.avg("elapsed_ms").alias("avg_elapsed_ms"), F.max("elapsed_ms").alias("max_elapsed_ms"))
        .withColumnRenamed("__code", "error_code"))


def agent_run_summary(steps: DataFrame) -> DataFrame:
    """Per request: steps, model and tool calls, last stop reason, success and elapsed time."""
    last = F.struct("step_index", "created_at")
    reason = F.max_by("stop_reason", F.when(has_text("stop_reason"), last))
    return steps.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("action_type") == "MODEL_CALL").alias("model_calls"),
        F.count_if(F.col("action_type") == "TOOL_CALL").alias("tool_calls"),
        reason.alias("stop_reason"),
        F.coalesce(reason == "FINAL_ANSWER", F.lit(False)).alias("success"),
        F.sum("elapsed_ms").alias("elapsed_ms"))


def repeated_tool_calls(tool_calls: DataFrame, max_repeat: int = C.MAX_REPEATED_CALLS) -> DataFrame:
    """Adds ``repeat_no`` of identical (tool, arguments) in a request, and the error code beyond
    the limit. ``tool_calls``: request_id, call_id, tool_name, arguments, ts."""
    hashed = tool_calls.withColumn("arguments_hash", args_hash("arguments"))
    counted = running(hashed, ["request_id", "tool_name", "arguments_hash"], ["ts", "call_id"],
                      hour_of("ts"), repeat_no=("row_number", None))
    return counted.withColumn("duplicate_code", F.when(
        F.col("repeat_no") > max_repeat, F.lit("DUPLICATE_TOOL_CALL")))


def tool_rollout(tool_calls: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds ``call_no`` per (request, tool), ``decision`` and ``reason`` of the rollout policy.

    ``tool_calls``: request_id, call_id, tool_name, tenant_id, role_ids, ts; ``policy``: one row per
    tool (see ``schemas.TOOL_POLICY``). Tools without a policy get the defaults: enabled,
    auto-execute, no limit.
    """
    counted = running(tool_calls, ["request_id", "tool_name"], ["ts", "call_id"], hour_of("ts"),
                      call_no=("row_number", None))
    rules = policy.select("tool_name", *[F.col(c).alias(f"__{c}") for c in (
        "enabled", "shadow_only", "auto_execute", "requires_confirmation",
        "max_calls_per_request", "allowed_tenant_ids", "allowed_role_ids")])
    ruled = counted.join(rules, "tool_name", "left")
    none = F.array().cast("array<string>")
    tenants = F.coalesce("__allowed_tenant_ids", none)
    roles = F.coalesce("__allowed_role_ids", none)
    limit = F.coalesce("__max_calls_per_request", F.lit(0))
    confirm = F.coalesce("__requires_confirmation", F.lit(False))
    tenant_ok = (F.size(tenants) == 0) | F.coalesce(
        F.array_contains(tenants, F.col("tenant_id")), F.lit(False))
    role_ok = (F.size(roles) == 0) | F.arrays_overlap(roles, F.coalesce("role_ids", none))
    outcome = (
        F.when(~F.coalesce("__enabled", F.lit(True)), _verdict("BLOCKED", "TOOL_DISABLED"))
        .when(~tenant_ok, _verdict("BLOCKED", "TENANT_NOT_ALLOWED"))
        .when(~role_ok, _verdict("BLOCKED", "ROLE_NOT_ALLOWED"))
        .when((limit > 0) & (F.col("call_no") > limit),
              _verdict("MAX_CALLS_EXCEEDED", "MAX_CALLS_PER_REQUEST_EXCEEDED"))
        .when(F.coalesce("__shadow_only", F.lit(False)), _verdict("SHADOW_ONLY", "SHADOW_ONLY"))
        .when(confirm, _verdict("CONFIRMATION_REQUIRED", "REQUIRES_CONFIRMATION"))
        .when(~F.coalesce("__auto_execute", F.lit(True)),
              _verdict("CONFIRMATION_REQUIRED", "AUTO_EXECUTE_DISABLED"))
        .otherwise(_verdict("ALLOW", None)))
    return (ruled.withColumn("__outcome", outcome)
            .select(*counted.columns, "__outcome.decision", "__outcome.reason"))


def _verdict(decision: str, reason: str | None) -> Column:
    return F.struct(F.lit(decision).alias("decision"),
                    F.lit(reason).cast("string").alias("reason"))


def stop_reason(steps: DataFrame, max_steps: int = C.MAX_STEPS,
                max_llm_calls: int = C.MAX_LLM_CALLS,
                max_duration_ms: int = C.MAX_DURATION_MS) -> DataFrame:
    """Per request: the first limit it broke or the reason it ended, with that step's index; null
    while it may go on. ``steps``: request_id, step_index, action_type, success, error_code,
    elapsed_ms. A model call opens a loop step."""
    is_model = F.col("action_type") == "MODEL_CALL"
    slices = F.floor(F.col("step_index") / 1024)
    run = running(steps, ["request_id"], ["step_index"], slices,
                  __elapsed=("before", F.col("elapsed_ms")),
                  __calls=("before", F.when(is_model, 1).otherwise(0)))
    late = F.col("__elapsed") > max_duration_ms
    fallback = F.when(is_model, F.lit("LLM_CALL_FAILED")).otherwise(
        F.lit("TOOL_EXECUTION_FAILED"))
    failure = F.when(has_text("error_code"), F.col("error_code")).otherwise(fallback)
    reason = (F.when(is_model & (F.col("__calls") >= max_steps),
                     F.lit("AGENT_MAX_STEPS_EXCEEDED"))
              .when(is_model & late, F.lit("AGENT_TIMEOUT"))
              .when(is_model & (F.col("__calls") >= max_llm_calls),
                    F.lit("AGENT_MAX_LLM_CALLS_EXCEEDED"))
              .when((F.col("action_type") == "TOOL_CALL") & late, F.lit("AGENT_TIMEOUT"))
              .when(~F.col("success"), failure)
              .when(F.col("action_type") == "FINAL_ANSWER", F.lit("FINAL_ANSWER")))
    flagged = run.withColumn("__reason", reason)
    at = F.when(F.col("__reason").isNotNull(), F.col("step_index"))
    return flagged.groupBy("request_id").agg(
        F.min_by("__reason", at).alias("stop_reason"), F.min(at).alias("stopped_at"))


def workflow_transitions(states: DataFrame) -> DataFrame:
    """State changes of each workflow key with their legality and session number.

    ``states``: workflow_id, event_id, ts, state, event. A row that keeps the state gives none. The
    row after a terminal state opens a new session, which starts from INIT.
    """
    ended = F.col("state").isin(*C.TERMINAL_STATES)
    run = running(states, ["workflow_id"], ["ts", "event_id"], hour_of("ts"),
                  __previous=("lag", "state"),
                  __ended=("before", F.when(ended, 1).otherwise(0)))
    fresh = F.col("__previous").isNull() | F.col("__previous").isin(*C.TERMINAL_STATES)
    before = F.when(fresh, F.lit("INIT")).otherwise(F.col("__previous"))
    step = F.concat(F.col("from_state"), F.lit(">"), F.col("state"))
    edges = [f"{a}>{b}" for a, b in C.WORKFLOW_EDGES]
    return (run.withColumn("from_state", before)
            .withColumn("session_no", (F.col("__ended") + 1).cast("long"))
            .filter(F.col("from_state") != F.col("state"))
            .withColumn("legal", step.isin(*edges))
            .withColumn("terminal", ended)
            .withColumnRenamed("state", "to_state").drop("__previous", "__ended"))


def workflow_funnel(transitions: DataFrame) -> DataFrame:
    """Counts per edge."""
    return transitions.groupBy("from_state", "to_state").agg(
        F.count(F.lit(1)).alias("transitions"), F.count_if("legal").alias("legal_transitions"))


def recent_decisions(decisions: DataFrame, n: int = 0) -> DataFrame:
    """Newest n decisions, at most 200; 50 when n is not positive."""
    wanted = C.DEFAULT_RECENT_DECISIONS if n <= 0 else min(n, C.MAX_RECENT_DECISIONS)
    return decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(wanted)


def owned_orders(requests: DataFrame, orders: DataFrame, public: Sequence[str] = ()) -> DataFrame:
    """Access verdict per order request: OK, PERMISSION_DENIED or BUSINESS_REJECTED (unknown id).

    ``requests``: request_id, user_id, order_id; ``orders``: order_id, owner_id, status. An order
    in ``public`` is anyone's.
    """
    known = orders.select("order_id", F.col("owner_id").alias("__owner"), "status")
    mine = (F.col("__owner") == F.col("user_id")) | F.col("order_id").isin(*public)
    verdict = (F.when(~has_text("user_id"), F.lit("PERMISSION_DENIED"))
               .when(F.col("__owner").isNull(), F.lit("BUSINESS_REJECTED"))
               .when(mine, F.lit("OK")).otherwise(F.lit("PERMISSION_DENIED")))
    joined = requests.join(known, "order_id", "left").withColumn("verdict", verdict)
    return joined.withColumn("status", F.when(F.col("verdict") == "OK", F.col("status"))).drop(
        "__owner")


def confirmations(created: DataFrame, confirmed: DataFrame,
                  ttl_seconds: int = C.CONFIRMATION_TTL_SECONDS,
                  as_of: Column | None = None) -> DataFrame:
    """Outcome of each request: EXECUTED when its owner answered in time, else USER_MISMATCH when only
    others did, else EXPIRED, or PENDING while its lifetime has not passed at ``as_of`` (None: the log
    is finished).

    ``created``: confirmation_id, user_id, created_at; ``confirmed``: confirmation_id, user_id,
    confirmed_at. Answers after the lifetime change nothing. ``first_own`` is the owner's first answer.
    """
    asked = created.select("confirmation_id", F.col("user_id").alias("owner_id"), "created_at")
    after = F.unix_micros("confirmed_at") - F.unix_micros("created_at")
    in_time = (after >= 0) & (after <= ttl_seconds * 1_000_000)
    own = in_time & (F.col("user_id") == F.col("owner_id"))
    decided = asked.join(confirmed, "confirmation_id", "left").groupBy(
        "confirmation_id", "owner_id", "created_at").agg(
        F.min(F.when(own, F.col("confirmed_at"))).alias("first_own"),
        F.coalesce(F.bool_or(in_time & F.col("user_id").isNotNull()), F.lit(False)).alias("answered"))
    outcome = F.when(F.col("first_own").isNotNull(), F.lit("EXECUTED"))
    if as_of is not None:
        open_ = F.unix_micros(as_of) - F.unix_micros("created_at") <= ttl_seconds * 1_000_000
        outcome = outcome.when(open_, F.lit("PENDING"))
    outcome = outcome.when(F.col("answered"), F.lit("USER_MISMATCH")).otherwise(F.lit("EXPIRED"))
    return decided.withColumn("outcome", outcome).drop("answered")
