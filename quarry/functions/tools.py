"""Functions over tool calls, intents and workflow messages kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import clean_json, has_text, strip


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_json_object(json: Column | str) -> Column:
    c = _col(json)
    parsed = F.try_parse_json(c)
    kind = F.schema_of_variant(parsed)
    return F.coalesce(kind.startswith("OBJECT<"), F.lit(False))


def validate_intent(raw: Column | str) -> Column:
    """struct(intent, confidence, error_code): error_code is null for a valid answer."""
    parsed = F.from_json(clean_json(raw), "intent string, confidence double")
    intent, confidence = strip(parsed["intent"]), parsed["confidence"]
    error = (F.when(~is_json_object(clean_json(raw)), F.lit("INVALID_JSON"))
             .when(~has_text(intent), F.lit("INTENT_BLANK"))
             .when(~intent.isin(*C.INTENTS), F.lit("INTENT_UNKNOWN"))
             .when(confidence.isNull(), F.lit("CONFIDENCE_MISSING"))
             .when((confidence < 0) | (confidence > 1), F.lit("CONFIDENCE_RANGE")))
    return F.struct(intent.alias("intent"), confidence.alias("confidence"),
                    error.alias("error_code"))


def parse_tool_decision(raw: Column | str) -> Column:
    """struct(valid, answer, tool_name, arguments); a single element of ``toolCalls`` stands in for
    a missing ``toolCall``, more than one makes the answer invalid."""
    text = clean_json(raw)
    calls = F.from_json(F.get_json_object(text, "$.toolCalls"), "array<string>")
    single = F.get_json_object(text, "$.toolCall")
    chosen = F.coalesce(single, F.when(F.size(calls) == 1, F.get(calls, F.lit(0))))
    valid = is_json_object(text) & (F.coalesce(F.size(calls), F.lit(0)) <= 1)
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.get_json_object(text, "$.answer")).alias("answer"),
        F.when(valid, F.get_json_object(chosen, "$.toolName")).alias("tool_name"),
        F.when(valid, F.get_json_object(chosen, "$.arguments")).alias("arguments"))


def validate_tool_args(tool: Column | str, args: Column | str) -> Column:
    """Error code of the arguments, null when they are fine.

    Checked in this order: a JSON object, no forbidden key, only known keys, value constraints.
    """
    name, json = _col(tool), _col(args)
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    search = name == "search_knowledge_base"
    forbidden = F.when(search, _strings(C.FORBIDDEN_SEARCH_ARGS)).otherwise(
        _strings(C.FORBIDDEN_ARGS))
    known = F.when(search, _strings(("query", "topK"))).otherwise(_strings(("orderId",)))
    order = F.get_json_object(json, "$.orderId")
    query = F.get_json_object(json, "$.query")
    top_k = F.get_json_object(json, "$.topK")
    order_ok = has_text(order) & order.rlike("^[A-Za-z0-9_-]{1,64}$")
    top_k_ok = top_k.isNull() | F.coalesce(top_k.try_cast("int").between(1, 10), F.lit(False))
    query_ok = has_text(query) & (F.length(query) <= 500) & top_k_ok
    return (F.when(~is_json_object(json), F.lit("VALIDATION_ERROR"))
            .when(F.arrays_overlap(keys, forbidden), F.lit("PERMISSION_DENIED"))
            .when(F.size(F.array_except(keys, known)) > 0, F.lit("VALIDATION_ERROR"))
            .when(search & ~query_ok, F.lit("VALIDATION_ERROR"))
            .when(~search & ~order_ok, F.lit("VALIDATION_ERROR")))


def check_tool_permission(risk: Column | str, confirmed: Column | str, permission: Column | str,
                          held: Column | str) -> Column:
    """A high-risk tool needs a confirmation first, then the permission code must be held."""
    code = _col(permission)
    missing = has_text(code) & ~F.coalesce(F.array_contains(_col(held), code), F.lit(False))
    unconfirmed = (_col(risk) == "HIGH") & ~F.coalesce(_col(confirmed), F.lit(False))
    return (F.when(unconfirmed, F.lit("CONFIRMATION_REQUIRED"))
            .when(missing, F.lit("PERMISSION_DENIED")))


def prompt_leak(answer: Column | str) -> Column:
    """The answer, or the fixed refusal when it shows an internal phrase."""
    c = _col(answer)
    leaked = F.lit(False)
    for marker in C.LEAK_MARKERS:
        leaked = leaked | F.coalesce(c.contains(marker), F.lit(False))
    return F.when(leaked, F.lit(C.LEAK_REFUSAL)).otherwise(c)


def args_hash(json: Column | str) -> Column:
    return F.sha2(F.coalesce(_col(json), F.lit("{}")), 256)


def args_summary(json: Column | str) -> Column:
    c = _col(json)
    order = F.get_json_object(c, "$.orderId")
    keys = F.array_join(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")), ", ")
    return F.when(has_text(order), F.concat(F.lit("orderId="), order)).otherwise(
        F.concat(F.lit("keys=["), keys, F.lit("]")))


def reply_intent(message: Column | str) -> Column:
    """CANCEL, CONFIRM or OTHER; cancel words win."""
    text = F.lower(F.coalesce(_col(message), F.lit("")))

    def any_of(words):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit

    return (F.when(any_of(C.CANCEL_WORDS), F.lit("CANCEL"))
            .when(any_of(C.CONFIRM_WORDS), F.lit("CONFIRM")).otherwise(F.lit("OTHER")))


def refund_eligibility(logistics_status: Column | str) -> Column:
    return F.when(_col(logistics_status) == "SHIPPED", F.lit("REJECTED")).otherwise(
        F.lit("WAITING_CONFIRMATION"))


def conversation_summary(tool: Column | str, json: Column | str) -> Column:
    """The summary that a conversation keeps of its last tool result."""
    name, c = _col(tool), _col(json)

    def field(key, missing):
        return F.coalesce(F.get_json_object(c, f"$.{key}"), F.lit(missing))

    def state(missing):
        return F.concat(F.lit("orderId="), field("orderId", missing), F.lit(", status="), field("status", missing))

    order = F.concat(state(C.MISSING), F.lit(", amount="), field("amount", ""))
    return F.when(name == "query_order", order).otherwise(state(""))


def result_summary(tool: Column | str, json: Column | str) -> Column:
    """One-line summary of a tool result."""
    name, c = _col(tool), _col(json)

    def field(key):
        return F.coalesce(F.get_json_object(c, f"$.{key}"), F.lit(""))

    order = F.concat(F.lit("orderId="), field("orderId"), F.lit(",status="), field("status"),
                     F.lit(",amount="), field("amount"))
    sources = F.coalesce(F.json_array_length(F.get_json_object(c, "$.sources")), F.lit(0))
    search = F.concat(F.lit("answerable="), field("answerable"), F.lit(",retrievedCount="),
                      field("retrievedCount"), F.lit(",sourceCount="), sources.cast("string"))
    other = F.concat(F.lit("type="), name, F.lit(",stringLength="), F.length(c).cast("string"))
    return (F.when(c.isNull(), F.lit("null")).when(name == "query_order", order)
            .when(name == "search_knowledge_base", search).otherwise(other))


def classify_error(code: Column | str) -> Column:
    """True when a failed ingest attempt with this code may be retried."""
    return F.coalesce(_col(code).isin(*C.RETRYABLE_CODES), F.lit(False))


def error_code_norm(code: Column | str) -> Column:
    c = _col(code)
    return (F.when(~has_text(c), F.lit("TOOL_EXECUTION_FAILED"))
            .when(c == "TOOL_NOT_FOUND", F.lit("UNKNOWN_TOOL"))
            .when(c == "ORDER_NOT_FOUND", F.lit("BUSINESS_REJECTED")).otherwise(c))


def state_text(conversation: Column | str, user: Column | str, order: Column | str,
               confirmation: Column | str, last_tool: Column | str, last_summary: Column | str,
               allowed_tools: Column | str) -> Column:
    """``key=value`` lines of a conversation's state, blank fields left out, capped."""

    def line(key, value):
        c = _col(value)
        return F.when(has_text(c), F.concat(F.lit(f"{key}="), c))

    lines = F.concat_ws(
        "\n",
        F.lit("conversation_state:"),
        F.concat(F.lit("conversationId="), _col(conversation)),
        F.concat(F.lit("userId="), _col(user)),
        line("currentOrderId", order),
        line("pendingConfirmationId", confirmation),
        line("lastToolName", last_tool),
        line("lastToolResultSummary", last_summary),
        F.concat(F.lit("allowedTools=["), F.array_join(_col(allowed_tools), ", "), F.lit("]")),
        F.lit(f"instruction={C.STATE_INSTRUCTION}\n"))
    return F.substring(lines, 1, C.MAX_STATE_CHARS)
