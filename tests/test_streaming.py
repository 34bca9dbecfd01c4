"""Streams against their batch twins, on files in a temporary folder."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_operations import CALLS, quota_loop, quota_rows

from quarry.operators import agents as G
from quarry.operators.models import hash_embedder
from quarry.session import work_path
from quarry.sources import files as S
from quarry.streaming import state as T
from quarry.streaming import windows as W
from quarry.streaming.ingest import latest_chunks, latest_manifest, latest_parents, stream_ingest
from quarry.streaming.run import read_parquet_stream, run_available, state_settings

START = datetime(2024, 1, 1)


def stream_of(spark, *batches, ddl):
    """One file per batch, read one file per trigger in the order written."""
    folder = work_path(spark, "input")
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return read_parquet_stream(spark, folder, "*.parquet", files_per_trigger=1)


def test_quota_stream_equals_the_loop(spark):
    rows = sorted(quota_rows(3, 200), key=lambda r: (r[3], r[0]))
    with state_settings(spark):
        calls = stream_of(spark, rows[:120], rows[120:], ddl=CALLS)
        got = run_available(T.stream_quota(calls, 900, 2500, watermark="3 days"), "out").collect()
    assert {r["call_id"]: r["admitted"] for r in got} == quota_loop(rows, 900, 2500)


def test_tasks_time_out_and_retry(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", 1, at(0), "START", None), ("b", 2, at(1), "START", None),
            ("b", 3, at(2), "FAILURE", "TIMEOUT"), ("b", 4, at(9), "START", None),
            ("b", 5, at(10), "SUCCESS", None), ("c", 6, at(3), "FAILURE", "DOCUMENT_EMPTY_FILE")]
    later = [("z", 9, at(4000), "START", None)]
    with state_settings(spark):
        events = stream_of(spark, rows, later, ddl="task_id string, attempt_id long, ts timestamp, "
                           "kind string, error_code string")
        got = run_available(T.stream_ingest_tasks(events), "out").collect()
    steps = {}
    for r in sorted(got, key=lambda r: r["at_ms"]):
        steps.setdefault(r["task_id"], []).append((r["status"], r["error_code"], r["delay_seconds"]))
    assert steps["a"] == [("RUNNING", None, None), ("RETRYING", "INGEST_LOCK_TIMEOUT", 0)]
    assert steps["b"] == [("RUNNING", None, None), ("RETRYING", "TIMEOUT", 5),
                          ("RUNNING", None, None), ("SUCCESS", None, None)]
    assert steps["c"] == [("FAILED", "DOCUMENT_EMPTY_FILE", None)]


def test_history_keeps_turns_when_a_summary_fails(spark):
    rows = [("u", "c", i, f"q{i}", None) for i in range(1, 9)]

    def summary(old, lines):
        if len(lines) < 4:
            raise ValueError("model down")
        return f"{len(lines)} turns"

    with state_settings(spark):
        turns = stream_of(spark, rows[:5], rows[5:], ddl="user_id string, conversation_id string, "
                          "seq long, user_message string, assistant_message string")
        got = run_available(T.stream_history(turns, summary, keep=2, threshold=4), "out").collect()
    got = sorted(got, key=lambda r: r["seq"])
    assert [r["retained"] for r in got] == [1, 2, 3, 4, 5, 2, 3, 4]
    assert [r["compressed"] for r in got] == [False] * 5 + [True, False, False]
    assert got[-1]["summary"] == "4 turns"


def test_confirmations_stream(spark):
    at = lambda s: START + timedelta(seconds=s)
    asked = [("ok", "u", at(0)), ("late", "u", at(0)), ("other", "u", at(0)), ("none", "u", at(0)),
             ("far", "u", at(9000)), ("end", "u", at(99000))]
    answered = [("ok", "u", at(300)), ("late", "u", at(301)), ("other", "v", at(5)),
                ("ok", "v", at(1)), ("ok", "u", at(2)), ("late", "v", at(400)),
                ("far", "u", at(9001)), ("end", "u", at(99000))]
    with state_settings(spark):
        created = stream_of(spark, asked, ddl="confirmation_id string, user_id string, created_at timestamp")
        confirmed = stream_of(spark, answered,
                              ddl="confirmation_id string, user_id string, confirmed_at timestamp")
        rows = run_available(W.stream_confirmations(created, confirmed), "out").collect()
    assert len(rows) == 5  # one outcome each; "end" is still open
    logs = (spark.createDataFrame(asked, "confirmation_id string, user_id string, created_at timestamp"),
            spark.createDataFrame(answered, "confirmation_id string, user_id string, confirmed_at timestamp"))
    now = G.confirmations(*logs, as_of=F.lit(at(99001)))
    assert {(r["confirmation_id"], r["outcome"]) for r in now.collect()} == {
        *((r["confirmation_id"], r["outcome"]) for r in rows), ("end", "EXECUTED")}
    early = G.confirmations(*logs, as_of=F.lit(at(200)))
    assert {r["confirmation_id"] for r in early.filter("outcome = 'PENDING'").collect()} == {
        "late", "other", "none"}
    assert {r["confirmation_id"]: r["outcome"] for r in rows} == {
        "ok": "EXECUTED", "late": "EXPIRED", "other": "USER_MISMATCH", "none": "EXPIRED",
        "far": "EXECUTED"}


def test_ingest_is_idempotent_and_drops_stale_versions(spark):
    ddl = "document_id string, version int, content string, strategy string"
    first = [("d1", 1, "one two three", "FIXED"), ("d2", 1, "# h\nbody", "MARKDOWN")]
    second = [("d1", 1, "one two three", "FIXED"), ("d1", 2, "new text", "FIXED")]
    docs = stream_of(spark, first, second, ddl=ddl)
    target = work_path(spark, "corpus")
    stream_ingest(docs, target, hash_embedder(8), "m").awaitTermination()
    everything = latest_chunks(spark, target).collect()
    assert len(everything) == 3 and all(len(r["embedding"]) == 8 for r in everything)
    registry = spark.createDataFrame([("d1", 2), ("d2", 1)], "document_id string, version int")
    current = latest_chunks(spark, target, registry).collect()
    assert sorted(r["content"] for r in current) == ["new text", "标题：h\nbody"]


def test_files_are_read_and_routed(spark, tmp_path):
    (tmp_path / "a b.md").write_text("# 标题\n正文", encoding="utf-8")
    (tmp_path / "c.txt").write_text("plain", encoding="utf-8")
    (tmp_path / "d.exe").write_text("no", encoding="utf-8")
    rows = {r["filename"]: r for r in S.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b.md", "c.txt"}
    assert rows["a b.md"]["content"] == "# 标题\n正文" and rows["c.txt"]["content_type"] == "text/plain"
    (tmp_path / "cases.json").write_text(
        '[{"question": "q", "expectedKeys": ["a", "b"], "expectedPhrase": null}]', encoding="utf-8")
    from quarry.schemas import QUESTION

    assert S.read_eval_cases(spark, str(tmp_path / "cases.json"), QUESTION).first()[
        "expectedKeys"] == ["a", "b"]


def test_ingest_again_clears_a_version_and_goes_on(spark):
    ddl = "document_id string, version int, content string, strategy string"
    first = [("d", 1, "One is here. Two is here.", "SEMANTIC"), ("e", 1, "kept", "FIXED")]
    second = [("d", 1, "changed", "FIXED")]
    docs = stream_of(spark, first, second, ddl=ddl)
    target = work_path(spark, "corpus")
    for _ in range(2):  # the second run finds its checkpoint and adds nothing
        stream_ingest(docs, target, hash_embedder(8), "m").awaitTermination()
    got = latest_chunks(spark, target).collect()
    assert sorted((r["document_id"], r["content"]) for r in got) == [("d", "changed"), ("e", "kept")]


INGEST = ("document_id string, version int, content string, strategy string, kind string, at int, filename string, "
          "content_type string, images array<struct<page:int,bytes:binary>>")


def _sent(document, version, content, at=1, kind=None, images=None, strategy="FIXED"):
    return (document, version, content, strategy, kind, at, "f.png", None, images)


def test_manifest_decides_what_is_read(spark):
    first = [_sent(d, 1, f"text of {d}") for d in ("emptied", "deleted", "gone", "twice", "stale", "kept")] + [
        _sent("gone", 2, "second"), _sent("empty", 1, None), _sent("md", 1, "# h\nbody", strategy="MARKDOWN")]
    second = [_sent("emptied", 1, " "), _sent("deleted", 1, None, kind="delete"), _sent("gone", None, None, 5, "DELETE"),
              _sent("gone", 3, "after", 6), _sent("gone", 4, "before", 4),
              _sent("twice", 1, "later", 9), _sent("twice", 1, "zzz earlier", 8), _sent("twice", 1, "later", 9),
              _sent("stale", 1, "stale again"), _sent("stale", 2, "current"),
              _sent("img", 1, None, images=[(2, b"x"), (0, b"y"), (1, None)]), _sent("md", 1, "flat", strategy="MARKDOWN")]
    docs = stream_of(spark, first, second, ddl=INGEST)
    target = work_path(spark, "corpus")
    current = spark.createDataFrame([(d, v) for d, v in [
        *((r[0], r[1]) for r in first), ("gone", 3), ("gone", 4), ("stale", 2), ("img", 1)] if (d, v) != ("stale", 1)],
        "document_id string, version int")
    stream_ingest(docs, target, hash_embedder(8), "m", order="at", registry=lambda: current).awaitTermination()
    state = {(r.document_id, r.version): (r.state, r.error_code, r.chunks) for r in latest_manifest(spark, target).collect()}
    assert state == {
        ("emptied", 1): ("FAILED", "DOCUMENT_EMPTY_FILE", 0), ("deleted", 1): ("DELETED", None, 0),
        ("gone", 1): ("DELETED", None, 0), ("gone", 2): ("DELETED", None, 0), ("gone", 3): ("READY", None, 1),
        ("gone", 4): ("DELETED", None, 0), ("twice", 1): ("READY", None, 1),
        ("stale", 1): ("CANCELED", "DOCUMENT_VERSION_STALE", 0), ("stale", 2): ("READY", None, 1),
        ("kept", 1): ("READY", None, 1), ("empty", 1): ("FAILED", "DOCUMENT_EMPTY_FILE", 0),
        ("img", 1): ("READY", None, 2), ("md", 1): ("READY", None, 1)}
    rows = latest_chunks(spark, target).collect()
    assert sorted((r.document_id, r.chunk_index, r.content, r.modality) for r in rows) == [
        ("gone", 0, "after", "TEXT"), ("img", 0, "[图片] f.png 第2页", "IMAGE"), ("img", 1, "[图片] f.png", "IMAGE"),
        ("kept", 0, "text of kept", "TEXT"), ("md", 0, "flat", "TEXT"), ("stale", 0, "current", "TEXT"),
        ("twice", 0, "later", "TEXT")]
    assert all(len(r.embedding) == 8 for r in rows)
    assert [r.content for r in latest_parents(spark, target).filter("document_id = 'md'").collect()] == ["flat"]


def test_versions_that_turn_stale_while_a_batch_runs_are_canceled(spark):
    docs = stream_of(spark, [_sent("a", 1, "one"), _sent("b", 1, "two")], ddl=INGEST)
    target = work_path(spark, "corpus")
    answers = [[("a", 1), ("b", 1)], [("a", 2), ("b", 1)]]
    stream_ingest(docs, target, hash_embedder(8), "m", registry=lambda: spark.createDataFrame(
        answers.pop(0), "document_id string, version int")).awaitTermination()
    assert [r.document_id for r in latest_chunks(spark, target).collect()] == ["b"]
    assert latest_manifest(spark, target).filter("document_id = 'a'").first().state == "CANCELED"


def test_prefixes_and_pictures_are_embedded_by_their_own_functions(spark):
    seen = spark.sparkContext.accumulator(0)
    docs = stream_of(spark, [_sent("a", 1, "body", images=[(1, b"picture")])], ddl=INGEST)
    target = work_path(spark, "corpus")

    def texts(batch):
        return [[float(t.startswith("about ") and t.endswith("\nbody"))] for t in batch]

    def pictures(batch):
        seen.add(len(batch))
        return [[2.0 if t.startswith("data:image/png;base64,") else 0.0] for t in batch]

    stream_ingest(docs, target, texts, "m", prefix_fn=lambda p: "about it", image_fn=pictures).awaitTermination()
    rows = {r.modality: r for r in latest_chunks(spark, target).collect()}
    assert (rows["TEXT"].content, rows["TEXT"].embedding) == ("body", [1.0])
    assert rows["IMAGE"].embedding == [2.0] and rows["IMAGE"].content_hash == rows["IMAGE"].image_ref
    assert seen.value >= 1


def test_a_batch_makes_its_chunks_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def prefix(prompt):
        calls.add(1)
        return "about it"

    docs = stream_of(spark, [_sent("d", 1, "one", images=[(1, b"x")]), _sent("e", 1, "two")], ddl=INGEST)
    target = work_path(spark, "corpus")
    stream_ingest(docs, target, hash_embedder(8), "m", prefix_fn=prefix).awaitTermination()
    assert len(latest_chunks(spark, target).collect()) == 3
    assert calls.value == 2  # of two TEXT chunks


def closed(spark, build, batches, closing, ddl):
    """What ``build`` makes of the batches in that order, after rows far ahead closed what waits."""
    from quarry.streaming.run import run_closed

    folder = work_path(spark, "input")
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    stream = read_parquet_stream(spark, folder, "*.parquet", files_per_trigger=1)
    with state_settings(spark):
        return run_closed(build(stream), "out", lambda: spark.createDataFrame(closing, ddl).coalesce(1).write.mode(
            "append").parquet(folder)).collect()


def test_quota_in_order_of_events_whatever_the_order_of_arrival(spark):
    import random

    rows = quota_rows(5, 400)
    random.Random(1).shuffle(rows)
    far = [("far", "zz", "zz-u", START + timedelta(days=40), 1, 1)]
    got = closed(spark, lambda calls: T.stream_quota(calls, 900, 2500, watermark="5 days", by=T.EVENT),
                 [rows[:150], rows[150:160], rows[160:]], far, CALLS)
    assert {r["call_id"]: r["admitted"] for r in got} == quota_loop(rows, 900, 2500)


def test_locks_run_out_between_events_that_come_late(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", 1, at(0), "START", None), ("a", 2, at(400), "START", None), ("a", 3, at(500), "SUCCESS", None),
            ("b", 4, at(10), "START", None), ("b", 5, at(310), "FAILURE", "TIMEOUT"), ("c", 6, at(20), "START", None)]
    ddl = "task_id string, attempt_id long, ts timestamp, kind string, error_code string"
    got = closed(spark, lambda e: T.stream_ingest_tasks(e, watermark="1 hour", by=T.EVENT),
                 [rows[2:3] + rows[4:5], rows[1:2] + rows[3:4], rows[:1] + rows[5:]], [("z", 9, at(90000), "START", None)], ddl)
    steps = {}
    for r in sorted(got, key=lambda r: (r["at_ms"], r["error_code"] != "INGEST_LOCK_TIMEOUT")):
        second = (r["at_ms"] - int(START.timestamp()) * 1000) // 1000 % 86400
        steps.setdefault(r["task_id"], []).append((second, r["status"], r["error_code"]))
    lost = "INGEST_LOCK_TIMEOUT"
    offset = steps["a"][0][0]
    assert {k: [(s - offset, *rest) for s, *rest in v] for k, v in steps.items()} == {
        "a": [(0, "RUNNING", None), (300, "RETRYING", lost), (400, "RUNNING", None), (500, "SUCCESS", None)],
        "b": [(10, "RUNNING", None), (310, "RETRYING", lost), (310, "RETRYING", "TIMEOUT")],
        "c": [(20, "RUNNING", None), (320, "RETRYING", lost)]}


def test_turns_wait_for_earlier_ones(spark):
    ddl = "user_id string, conversation_id string, seq long, user_message string, assistant_message string"
    turn = lambda i, c="c": ("u", c, i, f"q{i}", None)
    with state_settings(spark):
        turns = stream_of(spark, [turn(5), turn(3), turn(1)], [turn(2), turn(2)], [turn(4), turn(9, "gap"), turn(8, "gap")],
                          [turn(7, "gap"), turn(10, "gap")], ddl=ddl)
        got = run_available(T.stream_history(turns, lambda old, lines: f"{old or ''}|{','.join(x[-2:] for x in lines)}",
                                             keep=2, threshold=4, patience=3), "out").collect()
    of = {c: sorted((r.seq, r.retained) for r in got if r.conversation_id == c) for c in ("c", "gap")}
    assert of["c"] == [(1, 1), (2, 2), (2, 3), (3, 4), (4, 2), (5, 3)]
    assert of["gap"] == [(7, 1), (8, 2), (9, 3), (10, 4)]


def test_rows_of_a_key_wait_in_blocks(spark, monkeypatch):
    import pandas as pd

    class State(dict):
        containsKey = dict.__contains__
        getValue = dict.get
        updateValue = dict.__setitem__
        removeKey = dict.pop

    class Handle:
        timers = set()

        def getMapState(self, *_):
            return State()

        def getValueState(self, *_):
            return None

        def registerTimer(self, at):
            self.timers.add(at)

    monkeypatch.setattr(T, "BLOCK_ROWS", 10)
    policy = T._Workflow(frozenset(), T.EVENT)
    handle = Handle()
    policy.init(handle)
    times = [7 * i % 100 for i in range(100)]
    minutes = pd.DataFrame({"ts_us": [t * 60_000_000 for t in times], "event_id": range(100), "state": "x", "event": "e"})
    assert list(policy.handleInputRows(("k",), iter([minutes[:37], minutes[37:]]), None)) == []
    assert handle.timers == {(i + 1) * T.SLICE_MS for i in range(10)}
    assert max(len(__import__("pickle").loads(v[0])["ts_us"]) for v in policy.waiting.values()) <= 10
    frames = list(policy._slices(5 * T.SLICE_MS))
    assert [len(f) for f in frames] == [10] * 5
    assert [t // 60_000_000 for f in frames for t in f["ts_us"]] == list(range(50))
    assert sorted(k[0] for k in policy.blocks) == [5, 6, 7, 8, 9]


def test_a_table_that_is_a_folder_of_files_is_read(spark):
    folder = work_path(spark, "tables")
    spark.range(10).repartition(3).write.parquet(f"{folder}/one.parquet")
    spark.range(100, 105).write.parquet(f"{folder}/other.parquet")
    got = run_available(read_parquet_stream(spark, folder, "one.parquet"), "out").collect()
    assert sorted(r["id"] for r in got) == list(range(10))


def test_loose_rows_of_a_key_take_one_value_and_one_timer(monkeypatch):
    import pandas as pd

    class State(dict):
        writes = 0
        containsKey = dict.__contains__
        getValue = dict.get
        removeKey = dict.pop

        def updateValue(self, key, value):
            self[key] = value
            self.writes += 1

    class Handle:
        def __init__(self):
            self.timers = []

        def getMapState(self, *_):
            return State()

        def getValueState(self, *_):
            return None

        def registerTimer(self, at):
            self.timers.append(at)

    def policy_of(handle):
        policy = T._Workflow(frozenset(), T.EVENT)
        policy.init(handle)
        return policy

    def minutes(*times):
        return pd.DataFrame({"ts_us": [t * 60_000_000 for t in times], "event_id": times, "state": "x", "event": "e"})

    handle = Handle()
    policy = policy_of(handle)
    list(policy.handleInputRows(("k",), iter([minutes(95, 15, 55)]), None))
    list(policy.handleInputRows(("k",), iter([minutes(25, 35)]), None))
    assert (policy.waiting.writes, len(policy.blocks), handle.timers) == (2, 0, [2 * T.SLICE_MS])
    assert [list(f["event_id"]) for f in policy._slices(4 * T.SLICE_MS)] == [[15, 25, 35]]
    assert handle.timers == [2 * T.SLICE_MS, 6 * T.SLICE_MS]
    assert [list(f["event_id"]) for f in policy._slices(10 * T.SLICE_MS)] == [[55, 95]]
    assert not policy.waiting

    # loose rows and rows in slices come in one order
    monkeypatch.setattr(T, "BLOCK_ROWS", 4)
    policy = policy_of(Handle())
    for some in ((95, 15, 55), (25, 11), (5, 12, 56), (96,)):
        list(policy.handleInputRows(("k",), iter([minutes(*some)]), None))
    got = [e for upto in (2, 6, 9) for f in policy._slices(upto * T.SLICE_MS) for e in f["event_id"]]
    assert got == [5, 11, 12, 15, 25, 55, 56]
    assert [e for f in policy._slices(None) for e in f["event_id"]] == [95, 96]
    assert not policy.waiting and not policy.blocks


def test_a_conversation_takes_two_state_calls_a_batch():
    import pandas as pd

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

    policy = T._History(2, 4, lambda old, lines: f"{old or ''}+{len(lines)}", 0, 64)
    policy.init(Handle())

    def seen(*turns):
        frame = pd.DataFrame({"seq": turns, "line": [f"l{i}" for i in turns]})
        return [tuple(r) for f in policy.handleInputRows(("u", "c"), iter([frame]), None) for r in f[["seq", "retained"]].values]

    assert seen(5, 3, 1) == []
    assert seen(2, 4) == []
    assert seen(0, 6) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 2), (5, 3), (6, 4)]
    assert policy.memory.calls == 6


def task_loop(rows, lock_ms=300_000, most=3):
    """The changes of tasks whose attempts (task, attempt, ts, kind, code) come in order."""
    tasks, out = {}, []
    for task, _, ts, kind, code in sorted(rows, key=lambda r: (r[2], r[1])):
        status, tries, locked = tasks.get(task, ("PENDING", 0, None))
        at = round(ts.timestamp() * 1000)
        if locked is not None and locked + lock_ms <= at:
            out.append((task, locked + lock_ms, "RETRYING", tries, "INGEST_LOCK_TIMEOUT"))
            status, locked = "RETRYING", None
        told, seen = True, None
        if kind == "START":
            told = status in ("PENDING", "RETRYING")
            status, locked = ("RUNNING", at) if told else (status, locked)
        elif kind == "FAILURE":
            tries, locked, seen = tries + (code == "TIMEOUT"), None, code
            status = "RETRYING" if code == "TIMEOUT" and tries < most else "FAILED"
        else:
            status, locked = "SUCCESS", None
        tasks[task] = (status, tries, locked)
        out += [(task, at, status, tries, seen)] * told
    return out + [(task, locked + lock_ms, "RETRYING", tries, "INGEST_LOCK_TIMEOUT")
                  for task, (_, tries, locked) in tasks.items() if locked is not None]


def test_tasks_of_a_cell_are_told_apart(spark, monkeypatch):
    """Many tasks to a key of the state, more rows than wait in one value, and a task without a name."""
    import random

    monkeypatch.setattr(T, "CELL_ROWS", 60)
    monkeypatch.setattr(T, "BLOCK_ROWS", 25)
    draw = random.Random(3)
    rows = [(draw.choice([None, *(f"k{i}" for i in range(40))]), i, START + timedelta(seconds=draw.randrange(20_000)),
             draw.choice(["START", "START", "SUCCESS", "FAILURE"]), draw.choice(["TIMEOUT", "DOCUMENT_EMPTY_FILE"]))
            for i in range(600)]
    ddl = "task_id string, attempt_id long, ts timestamp, kind string, error_code string"
    far = [("z", 10_000, START + timedelta(days=40), "SUCCESS", None)]
    key = lambda r: tuple((x is not None, x) for x in r)
    for cells, order, batches in ((1, T.EVENT, [rows[:200], rows[200:210], rows[210:]]), (3, T.ARRIVAL, [sorted(rows, key=lambda r: r[2])])):
        got = closed(spark, lambda e: T.stream_ingest_tasks(e, watermark="5 days", by=order, cells=cells), batches, far, ddl)
        got = [tuple(r)[:5] for r in got if r.task_id != "z"]
        assert sorted(got, key=key) == sorted(task_loop(rows), key=key)


def test_a_cell_costs_one_read_and_one_write_for_all_its_tasks():
    import pandas as pd

    class State:
        calls, value = [], None

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        timers, state = [], State()

        def getMapState(self, *_):
            return {}

        def getValueState(self, *_):
            return self.state

        def registerTimer(self, at):
            self.timers.append(at)

    policy, n = T._Task(3, 300, T.ARRIVAL), 1000
    policy.init(Handle())
    for kind in ("START", "FAILURE", "START"):
        frame = pd.DataFrame({"task_id": [f"k{i}" for i in range(n)], "attempt_id": range(n), "ts_us": [1_000_000 + i * 1000 for i in range(n)],
                              "kind": kind, "error_code": "TIMEOUT"})
        assert sum(map(len, policy.fold((0,), iter([frame]), None))) == n
    assert Handle.state.calls == ["update", "get", "update", "get", "update"] and Handle.timers == [301_000]
    assert [len(f) for f in policy.fold((0,), iter(()), 301_499)] == [500]
    assert Handle.timers == [301_000, 301_500]
