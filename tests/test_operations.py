"""Usage, limits, agents, corpus tables, history and evaluation against plain Python."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.operators import agents as G
from quarry.operators import corpus as O
from quarry.operators import evaluate as V
from quarry.operators import history as H
from quarry.operators import usage as S
from quarry.operators.skew import block_of, halo, running, salted_join

START = datetime(2024, 1, 1)
USAGE = ("request_id string, tenant_id string, user_id string, interface_name string, model string, "
         "prompt_tokens int, completion_tokens int, total_tokens int, cached_tokens int, "
         "estimated_cost double, latency_ms long, success boolean, created_at timestamp")


def test_usage_bill(spark):
    rows = [("r1", "t1", "u", "INTENT", "m", 1, 2, 3, 1, 0.03, 5, True, START),
            ("r2", "t1", "u", "INTENT", "m", 2, 4, 6, 0, 0.06, 5, True, START + timedelta(hours=1)),
            ("r3", "t2", "u", "RAG", "m", 7, 1, 8, 0, 0.08, 5, True, START + timedelta(hours=2))]
    usage = spark.createDataFrame(rows, USAGE).withColumn(
        "estimated_cost", F.col("estimated_cost").cast("decimal(18,6)"))
    bill = {r["interface_name"]: r for r in S.usage_summary(usage).collect()}
    assert (bill["INTENT"]["calls"], bill["INTENT"]["total_tokens"]) == (2, 9)
    assert bill["INTENT"]["cached_tokens"] == 1
    assert math.isclose(bill["INTENT"]["estimated_cost"], 0.09)
    assert [r["interface_name"] for r in S.usage_summary(usage, "t2").collect()] == ["RAG"]
    edge = S.usage_summary(usage, None, START + timedelta(hours=1), START + timedelta(hours=2))
    assert sum(r["calls"] for r in edge.collect()) == 2
    total = S.usage_totals(usage).filter("level = 3").first()
    assert (total["calls"], total["total_tokens"]) == (3, 17)


def test_running_equals_a_plain_window(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else rng.choice(["hot"] * 5 + ["a", "b"]), i,
             rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = running(df, ["k"], ["at"], block_of("at", 7), n=("row_number", None), s=("sum", "v"),
                  b=("before", "v"), last=("last", "v"), lag=("lag", "v"), lead=("lead", "v"))
    w = Window.partitionBy("k").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce("v", F.lit(0))
    want = df.select("*", F.row_number().over(w).cast("long").alias("n"), F.sum(filled).over(so_far)
                     .alias("s"), (F.sum(filled).over(so_far) - filled).alias("b"),
                     F.last("v", True).over(so_far).alias("last"), F.lag("v").over(w).alias("lag"),
                     F.lead("v").over(w).alias("lead"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(
        map(tuple, want.collect()), key=lambda r: r[1])


def test_halo_keeps_every_row_once(spark):
    rows = spark.range(1, 101).withColumnRenamed("id", "position")
    blocks = halo(rows, "position", 3, 10).collect()
    assert sorted(r["position"] for r in blocks if not r["__halo"]) == list(range(1, 101))
    heads = {(r["__block"], r["position"]) for r in blocks if r["__halo"]}
    assert {(1, 8), (1, 9), (1, 10)} <= heads


def test_salted_join_equals_join(spark):
    big = spark.range(300).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_join(big, small, ["k"], "id", how).collect()
        b = big.join(small, "k", how).select(*salted_join(big, small, ["k"], "id", how).columns)
        assert sorted(map(str, a)) == sorted(map(str, b.collect()))


def quota_loop(rows, user_quota, tenant_quota):
    users, tenants, out = {}, {}, {}
    for call, tenant, user, ts, need, charge in sorted(rows, key=lambda r: (r[3], r[0])):
        u, t = (tenant, user, ts.date()), (tenant, ts.date())
        fits = (users.get(u, 0) + need <= user_quota and tenants.get(t, 0) + need <= tenant_quota)
        if fits:
            users[u] = users.get(u, 0) + charge
            tenants[t] = tenants.get(t, 0) + charge
        out[call] = fits
    return out


def quota_rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tenant = rng.choice(["t0"] * 3 + ["t1", "t2"])
        need = rng.choice([5, 40, 90, 200])
        rows.append((f"c{i:04}", tenant, f"{tenant}-u{rng.randrange(5)}",
                     START + timedelta(seconds=rng.randrange(2 * 86400)), need,
                     rng.choice([0, need, need // 2, need + 30])))
    return rows


CALLS = "call_id string, tenant_id string, user_id string, ts timestamp, need long, charge long"


def test_quota_equals_the_loop(spark):
    for seed, rounds in ((1, 2), (2, 0)):
        rows = quota_rows(seed)
        got = S.token_quota(spark.createDataFrame(rows, CALLS), 900, 2500, rounds=rounds).collect()
        assert {r["call_id"]: r["admitted"] for r in got} == quota_loop(rows, 900, 2500)
        spent = {}
        for r in got:
            if r["admitted"]:
                key = (r["tenant_id"], r["ts"].date())
                spent[key] = spent.get(key, 0) + 1
        assert spent


def test_percentiles_by_nearest_rank(spark):
    rng = random.Random(9)
    values = {"hot": [rng.randrange(50) for _ in range(301)], "one": [7], "two": [1, 2],
              "wide": [rng.randrange(10 ** 6) for _ in range(200)]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    got = {r["k"]: r for r in S.latency_percentiles(rows, ["k"], "v").collect()}
    for k, vs in values.items():
        ordered = sorted(vs)
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            index = min(len(vs) - 1, math.floor(q * (len(vs) - 1) + 0.5))
            assert got[k][name] == ordered[index], (k, name)
        assert got[k]["n"] == len(vs)


def test_limits(spark):
    rows = [(f"c{i}", "u", "chat", START + timedelta(seconds=i)) for i in range(62)]
    rows += [(f"d{i}", None, "chat", START + timedelta(seconds=i)) for i in range(2)]
    calls = spark.createDataFrame(rows, "call_id string, user_id string, interface_name string, ts timestamp")
    verdicts = S.rate_limit(calls, 59).collect()
    assert [r["call_id"] for r in verdicts if r["rejected"]] == ["c59"]
    capped = S.daily_call_cap(calls, 10).filter("admitted").count()
    assert capped == 10
    late = spark.createDataFrame([("x", "u", "chat", datetime(2024, 1, 1, 16, 0))], calls.schema)
    assert str(S.daily_call_cap(late).first()["day"]) == "2024-01-02"


def test_policies(spark):
    calls = spark.createDataFrame(
        [("r", f"c{i}", tool, args, "t1", ["r9"], START + timedelta(seconds=i))
         for i, (tool, args) in enumerate([("a", "{}"), ("a", "{}"), ("a", "{1}"), ("b", None),
                                           ("b", "{}"), ("c", "{}"), ("d", "{}"), ("e", "{}")])],
        "request_id string, call_id string, tool_name string, arguments string, tenant_id string, "
        "role_ids array<string>, ts timestamp")
    policy = spark.createDataFrame(
        [("a", True, False, True, False, 2, [], []), ("b", False, False, True, False, 0, [], []),
         ("c", True, True, True, True, 0, [], []), ("d", True, False, False, False, 0, ["t1"], []),
         ("e", True, False, True, False, 0, [], ["r1"])],
        "tool_name string, enabled boolean, shadow_only boolean, auto_execute boolean, "
        "requires_confirmation boolean, max_calls_per_request int, "
        "allowed_tenant_ids array<string>, allowed_role_ids array<string>")
    got = {r["call_id"]: (r["decision"], r["reason"]) for r in G.tool_rollout(calls, policy).collect()}
    assert got == {
        "c0": ("ALLOW", None), "c1": ("ALLOW", None),
        "c2": ("MAX_CALLS_EXCEEDED", "MAX_CALLS_PER_REQUEST_EXCEEDED"),
        "c3": ("BLOCKED", "TOOL_DISABLED"), "c4": ("BLOCKED", "TOOL_DISABLED"),
        "c5": ("SHADOW_ONLY", "SHADOW_ONLY"),
        "c6": ("CONFIRMATION_REQUIRED", "AUTO_EXECUTE_DISABLED"),
        "c7": ("BLOCKED", "ROLE_NOT_ALLOWED")}
    again = {r["call_id"]: r["duplicate_code"] for r in G.repeated_tool_calls(calls).collect()}
    assert [c for c, code in again.items() if code] == ["c1"] or set(
        c for c, code in again.items() if code) == {"c1", "c4"}


def test_stop_reasons(spark):
    ddl = ("request_id string, step_index int, action_type string, success boolean, "
           "error_code string, elapsed_ms long")
    rows = []
    for name, steps in {
        "final": [("MODEL_CALL", True, None, 5), ("FINAL_ANSWER", True, None, 0)],
        "steps": [("MODEL_CALL", True, None, 5)] * 4,
        "late": [("MODEL_CALL", True, None, 10_001), ("TOOL_CALL", True, None, 0)],
        "failed": [("MODEL_CALL", True, None, 1), ("TOOL_RESULT", False, None, 1)],
        "open": [("MODEL_CALL", True, None, 1)],
    }.items():
        rows += [(name, i + 1, *s) for i, s in enumerate(steps)]
    got = {r["request_id"]: (r["stop_reason"], r["stopped_at"])
           for r in G.stop_reason(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"final": ("FINAL_ANSWER", 2), "steps": ("AGENT_MAX_STEPS_EXCEEDED", 4),
                   "late": ("AGENT_TIMEOUT", 2), "failed": ("TOOL_EXECUTION_FAILED", 2),
                   "open": (None, None)}


def test_workflow_sessions(spark):
    states = ["ORDER_READY", "ORDER_READY", "ORDER_QUERIED", "POLICY_CHECKED", "REJECTED",
              "NEED_ORDER_ID", "DONE"]
    rows = [("w", i, START + timedelta(minutes=40 * i), s, "e") for i, s in enumerate(states)]
    moves = G.workflow_transitions(spark.createDataFrame(
        rows, "workflow_id string, event_id long, ts timestamp, state string, event string"))
    got = [(r["from_state"], r["to_state"], r["session_no"], r["legal"])
           for r in moves.orderBy("event_id").collect()]
    assert got == [("INIT", "ORDER_READY", 1, True), ("ORDER_READY", "ORDER_QUERIED", 1, True),
                   ("ORDER_QUERIED", "POLICY_CHECKED", 1, True),
                   ("POLICY_CHECKED", "REJECTED", 1, True), ("INIT", "NEED_ORDER_ID", 2, True),
                   ("NEED_ORDER_ID", "DONE", 2, False)]


def test_alerts_are_strict(spark):
    ddl = ("api_requests long, api_errors long, llm_calls long, llm_errors long, total_tokens long, "
           "no_answers long, max_steps long, tool_failures long")
    rows = spark.createDataFrame([(0, 0, 10, 2, 100_000, 5, 5, 0), (10, 0, 10, 3, 100_001, 4, 6, 0)], ddl)
    fired = G.alert_rows(rows.select("*", *G.metric_rates())).collect()
    assert [r["alert"] for r in fired] == ["LLM_ERROR_RATE", "RAG_NO_ANSWER_RATE",
                                           "AGENT_MAX_STEPS", "TOKEN_USAGE"]


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), (" ", 1, "x")], "id string, seq int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 5, "y"), ("c", 1, "y"), ("c", 2, "z")], old.schema)
    rows = {r["id"]: r["v"] for r in O.upsert_latest(old, new, "id", "seq").collect()}
    assert rows == {"a": "y", "b": "y", "c": "z"}
    steps = [("d", i, START + timedelta(hours=i), k, 3 + i) for i, k in enumerate(
        ["UPLOAD", "UPDATE", "DELETE"])]
    history = O.document_history(spark.createDataFrame(
        steps, "document_id string, mutation_id int, ts timestamp, kind string, chunks long"))
    got = [(r["version"], r["status"], r["deactivated_chunks"], r["new_chunks"])
           for r in history.orderBy("mutation_id").collect()]
    assert got == [(1, "DELETED", 0, 3), (2, "DELETED", 3, 4), (2, "DELETED", 4, 0)]


def test_retries(spark):
    codes = ["TIMEOUT", "HTTP_ERROR", "TIMEOUT"]
    rows = [("k", i, START + timedelta(seconds=i), c) for i, c in enumerate(codes)]
    rows += [("n", 0, START, "DOCUMENT_EMPTY_FILE")]
    got = [(r["delay_seconds"], r["next_status"]) for r in O.retry_schedule(spark.createDataFrame(
        rows, "task_id string, attempt_id int, ts timestamp, error_code string")).orderBy(
        "task_id", "attempt_id").collect()]
    assert got == [(5, "RETRYING"), (10, "RETRYING"), (None, "FAILED"), (None, "FAILED")]


def test_compression_follows_the_simulation(spark):
    turns = spark.createDataFrame([("u", "c", i) for i in range(1, 60)],
                                  "user_id string, conversation_id string, seq long")
    for keep, threshold in ((5, 10), (2, 4), (3, 3), (1, 1)):
        kept, want = 0, []
        for _ in range(59):
            kept += 1
            done = kept > threshold
            kept = keep if done else kept
            want.append((kept, done))
        rows = H.compression_schedule(turns, keep, threshold, block=7).orderBy("seq").collect()
        assert [(r["retained"], r["compressed"]) for r in rows] == want


def test_history_isolates_conversations(spark):
    turns = spark.createDataFrame(
        [("u1", "c", i, f"q{i}", f"a{i}") for i in range(6)] + [("u2", " c ", 0, "other", ""),
                                                                  ("u1", " ", 0, "lost", "x")],
        "user_id string, conversation_id string, seq long, user_message string, assistant_message string")
    rows = {(r["user_id"], r["seq"]): r["history"] for r in H.history_at_turn(turns, 2, 3).collect()}
    assert rows[("u1", 0)] == "" and rows[("u2", 0)] == "" and len(rows) == 7
    assert rows[("u1", 4)] == "用户：q2\n助手：a2\n用户：q3\n助手：a3\n"
    assert {r["seq"] for r in H.recent_turns(turns, 2).filter("user_id = 'u1'").collect()} == {4, 5}


def test_entities_are_carried(spark):
    rows = [("u", "c", 0, "USER", "hello", None), ("u", "c", 1, "USER", "order ORD7 please", None),
            ("u", "c", 2, "TOOL", '{"orderId":"B-1"}', False), ("u", "c", 3, "OTHER", "x_1", None),
            ("u", "c", 4, "TOOL", '{"orderId":"B-2"}', True), ("u", "d", 5, "USER", "hi", None)]
    got = H.carry_entity(spark.createDataFrame(
        rows, "user_id string, conversation_id string, seq long, kind string, text string, "
        "success boolean"), block=2).orderBy("seq").collect()
    assert [r["current_order_id"] for r in got] == [None, "ORD7", "ORD7", "ORD7", "B-2", None]


def test_retrieval_metrics(spark):
    cases = spark.createDataFrame(
        [("chunks", ["c1", "c2", " ", "c9"], ["f1"]), ("late", ["c3"], []), ("files", [], ["f.md"]),
         ("none", [], []), ("miss", ["zz"], [])],
        "case_id string, expected_chunk_ids array<string>, expected_document_ids array<string>")
    results = spark.createDataFrame(
        [(c, i + 1, f"c{i + 1}", f"d{i}", "f.md" if i else "g.md")
         for c in ("chunks", "late", "files", "none") for i in range(3)],
        "case_id string, rank int, chunk_id string, document_id string, filename string")
    got = {r["case_id"]: r for r in V.retrieval_metrics(cases, results).collect()}
    assert math.isclose(got["chunks"]["recall"], 2 / 3) and got["chunks"]["mrr"] == 1.0
    assert math.isclose(got["late"]["mrr"], 1 / 3)
    files = got["files"]
    assert (files["recall"], files["mrr"], files["hit_chunk_ids"]) == (1.0, 0.5, ["c2", "c3"])
    for name in ("none", "miss"):
        assert (got[name]["hit"], got[name]["recall"], got[name]["mrr"]) == (False, 0.0, 0.0)
    empty = V.eval_summary(spark.createDataFrame(
        [], "hit boolean, recall double, mrr double, latency_ms long, prompt_tokens long, "
        "completion_tokens long, total_tokens long")).first()
    assert (empty["cases"], empty["hit_rate"], empty["total_tokens"]) == (0, 0.0, 0)


def test_phrase_match(spark):
    rows = [("年假 5 天", "5 天，年假", True), ("abc", "", True), (" ", "x", False),
            ("Refund OK", "refund", True), ("no", "a，b", False)]
    df = spark.createDataFrame(rows, "answer string, expected string, want boolean")
    assert df.filter(V.phrase_match("answer", "expected") != F.col("want")).count() == 0
