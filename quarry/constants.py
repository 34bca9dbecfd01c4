"""Names, limits, phrases and formats that results must match exactly."""

# visibility, status, modality
PRIVATE, DEPARTMENT, TENANT, PUBLIC, CUSTOM = "PRIVATE", "DEPARTMENT", "TENANT", "PUBLIC", "CUSTOM"
ACTIVE, READY, DELETED, PROCESSING = "ACTIVE", "READY", "DELETED", "PROCESSING"
TEXT, IMAGE = "TEXT", "IMAGE"

# chunking
CHUNK_SIZE, CHUNK_OVERLAP = 600, 100
SEMANTIC_THRESHOLD = 0.6
HEADING_LABEL, HEADING_SEPARATOR = "标题：", " > "
IMAGE_LABEL, PAGE_FORMAT = "[图片] ", " 第%d页"
MAX_CONTEXT_SOURCE_CHARS = 8000

# retrieval
TOP_K, RECALL_TOP_K, SCORE_THRESHOLD, RRF_K = 3, 50, 0.3, 60
BM25_K1, BM25_B = 1.5, 0.75
MAX_CONTEXT_CHARS, MAX_CONTEXT_TOKENS, PROMPT_OVERHEAD_CHARS = 3000, 1200, 120
MAX_INPUT_CHARS = 2000
PREVIEW_CHARS, SNIPPET_CHARS, CONTEXT_CHARS, SUMMARY_CHARS = 100, 220, 500, 260

# cost
COST_PER_THOUSAND_TOKENS = 0.001
CACHE_READ_WEIGHT = 0.2
CACHEABLE_PREFIX_TOKENS = 1024
CHAT_MAX_INPUT_TOKENS, AGENT_MAX_INPUT_TOKENS = 1500, 4000
USER_DAILY_TOKENS, TENANT_DAILY_TOKENS = 100_000, 1_000_000
CALLS_PER_MINUTE, CALLS_PER_DAY, CALL_DAY_ZONE = 60, 500, "Asia/Shanghai"

# alerts
MAX_LLM_ERROR_RATE, MAX_NO_ANSWER_RATE = 0.2, 0.3
MAX_STEPS_ALERT, MAX_TOKENS_ALERT = 5, 100_000

# agent runs
MAX_STEPS, MAX_LLM_CALLS, MAX_DURATION_MS, MAX_REPEATED_CALLS = 3, 4, 10_000, 1
MAX_STATE_CHARS = 1000
CONFIRMATION_TTL_SECONDS = 300
MAX_RECENT_DECISIONS, DEFAULT_RECENT_DECISIONS = 200, 50

# conversations
HISTORY_TURNS, SUMMARY_THRESHOLD, CHAT_MESSAGES = 5, 10, 12
USER_LABEL, ASSISTANT_LABEL = "用户：", "助手："

# ingest tasks
MAX_RETRY, RETRY_BASE_SECONDS, RETRY_MAX_SECONDS, LOCK_TIMEOUT_SECONDS = 3, 5, 300, 300
RETRYABLE_CODES = ("TIMEOUT", "HTTP_ERROR", "EMPTY_RESPONSE_BODY", "EMPTY_OUTPUT", "CLIENT_ERROR",
                   "NETWORK_ERROR", "INGEST_EXECUTION_FAILED")

# tools
INTENTS = ("chat", "rag_query", "order_query")
TOOL_PERMISSIONS = {
    "query_order": "order:query",
    "cancel_order": "order:cancel",
    "search_knowledge_base": "knowledge:search",
}
FORBIDDEN_ARGS = ("userId", "tenantId", "topK", "scoreThreshold", "role", "roleId", "roleIds",
                  "departmentId", "departmentIds", "visibility")
FORBIDDEN_SEARCH_ARGS = ("userId", "tenantId", "role", "roleId", "roleIds", "departmentId",
                         "departmentIds", "visibility", "scoreThreshold")
LEAK_MARKERS = ("你是一个企业客服 Agent", "工具选择规则", "当前用户可用工具", "后端当前暴露给你的工具",
                "你必须只返回 JSON", "system prompt")
MISSING = "null"
LEAK_REFUSAL = "抱歉，当前回答包含不可展示的内部指令内容，请换一种问法重试。"
CANCEL_WORDS = ("取消", "不要", "算了", "no")
CONFIRM_WORDS = ("确认", "同意", "提交", "yes", "ok")
STATE_INSTRUCTION = ("When the user says this order, it, or current order, use currentOrderId if "
                     "present. Tool arguments still must be valid.")

# refund workflow
WORKFLOW_EDGES = (
    ("INIT", "NEED_ORDER_ID"),
    ("INIT", "ORDER_READY"),
    ("NEED_ORDER_ID", "ORDER_READY"),
    ("ORDER_READY", "ORDER_QUERIED"),
    ("ORDER_READY", "FAILED"),
    ("ORDER_QUERIED", "POLICY_CHECKED"),
    ("ORDER_QUERIED", "FAILED"),
    ("POLICY_CHECKED", "REJECTED"),
    ("POLICY_CHECKED", "WAITING_CONFIRMATION"),
    ("WAITING_CONFIRMATION", "CANCELLED"),
    ("WAITING_CONFIRMATION", "SUBMITTED"),
    ("SUBMITTED", "DONE"),
)
TERMINAL_STATES = ("DONE", "REJECTED", "CANCELLED", "FAILED")
