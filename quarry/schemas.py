"""Schemas of the tables, as DDL."""

_ACL = ("tenant_id string, owner_id string, department_id string, visibility string, "
        "allowed_user_ids array<string>, allowed_role_ids array<string>")

DOCUMENT = (f"document_id string, filename string, content_type string, size bigint, "
            f"created_at timestamp, {_ACL}, status string, current_version int, "
            "permission_level int")
CHUNK = ("chunk_id string, document_id string, filename string, content string, "
         f"content_hash string, chunk_index int, {_ACL}, status string, document_status string, "
         "version int, permission_level int, parent_id string, modality string, image_ref string, "
         "created_at timestamp, embedding array<double>")
PARENT = (f"parent_id string, document_id string, content string, {_ACL}, version int, "
          "permission_level int")
PRINCIPAL = ("tenant_id string, user_id string, department_ids array<string>, "
             "role_ids array<string>, permission_level int")
USAGE = ("request_id string, tenant_id string, user_id string, interface_name string, "
         "model string, prompt_tokens int, completion_tokens int, total_tokens int, "
         "cached_tokens int, estimated_cost decimal(18,6), latency_ms bigint, success boolean, "
         "created_at timestamp")
EVAL_CASE = ("caseId string, question string, expectedAnswer string, "
             "expectedSourceChunkIds array<string>, expectedSourceDocumentIds array<string>, "
             "tenantId string, userId string, tags array<string>")
QUESTION = "question string, expectedKeys array<string>, expectedPhrase string"
FOLLOW_UP = "turn1 string, turn2 string, expectedKeys array<string>"
EVAL_SAMPLE = ("mode string, case_id string, question string, contexts array<string>, "
               "answer string, reference string, expected_keys array<string>, "
               "retrieved_keys array<string>, doc_hit boolean")
TOOL_POLICY = ("tool_name string, enabled boolean, shadow_only boolean, auto_execute boolean, "
               "requires_confirmation boolean, max_calls_per_request int, "
               "allowed_tenant_ids array<string>, allowed_role_ids array<string>")
INGEST_TASK = ("task_id string, document_id string, document_version int, status string, "
               "current_step string, retry_count int, max_retry int, next_retry_at timestamp, "
               "locked_by string, locked_at timestamp, error_code string, error_message string, "
               "created_at timestamp, updated_at timestamp")
AGENT_STEP = ("request_id string, conversation_id string, step_index int, action_type string, "
              "tool_name string, arguments_summary string, success boolean, error_code string, "
              "elapsed_ms bigint, stop_reason string, created_at timestamp")
TURN = ("user_id string, conversation_id string, seq bigint, user_message string, "
        "assistant_message string")
