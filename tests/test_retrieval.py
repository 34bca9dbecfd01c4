"""Access rules, scoring, fusion and context against plain Python."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import access as A
from quarry.operators import context as X
from quarry.operators import dense as D
from quarry.operators import fusion as R
from quarry.operators import ivf as V
from quarry.operators import lexical as L
from quarry.session import work_path

ACL = ("tenant_id string, owner_id string, department_id string, visibility string, "
       "allowed_user_ids array<string>, allowed_role_ids array<string>")
PRINCIPAL = "tenant_id string, user_id string, department_ids array<string>, role_ids array<string>"


def random_acl(rng):
    return (f"t{rng.randrange(2)}", f"u{rng.randrange(6)}",
            rng.choice([None, "d0", "d1", "d2"]),
            rng.choice(["PRIVATE", "DEPARTMENT", "TENANT", "PUBLIC", "CUSTOM", "CUSTOM", "OTHER"]),
            rng.choice([None, [], ["u1"], ["u2", "u3"]]), rng.choice([None, ["r0"], ["r1", "r2"]]))


def may_see(chunk, who):
    tenant, owner, dept, visibility, users, roles = chunk
    if tenant != who[0]:
        return False
    return {"PRIVATE": owner == who[1], "DEPARTMENT": dept in who[2], "TENANT": True,
            "PUBLIC": True, "CUSTOM": who[1] in (users or []) or bool(
                set(roles or []) & set(who[3]))}.get(visibility, False)


def world(seed=1, chunks=300, people=12):
    rng = random.Random(seed)
    rows = [(f"c{i:03}", *random_acl(rng)) for i in range(chunks)]
    # a third of all chunks share one access class
    rows += [(f"h{i:03}", "t0", "u0", None, "PUBLIC", None, None) for i in range(chunks // 2)]
    who = [(f"t{i % 2}", f"u{i}", rng.sample(["d0", "d1", "d2"], rng.randrange(3)),
            rng.sample(["r0", "r1", "r2"], rng.randrange(3))) for i in range(people)]
    return rows, who


def test_visible_to_equals_the_rule(spark):
    rows, who = world()
    chunks = spark.createDataFrame(rows, f"chunk_id string, {ACL}")
    people = spark.createDataFrame(who, PRINCIPAL)
    found = A.visible_to(chunks, people).select("principal_id", "chunk_id").collect()
    want = {(w[1], r[0]) for w in who for r in rows if may_see(r[1:], w)}
    assert len(found) == len(want) and {tuple(f) for f in found} == want
    one = who[3]
    kept = chunks.filter(A.can_access(one[0], one[1], one[2], one[3])).collect()
    assert {r["chunk_id"] for r in kept} == {c for u, c in want if u == one[1]}


def test_visible_pairs_in_small_blocks_keep_copies_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(A, "PRINCIPAL_BLOCK", 3)
    monkeypatch.setattr(A, "CHUNK_BLOCK", 2)
    rows, who = world(4, 120, 30)
    rows += [rows[0], rows[-1], rows[-1], (None, *rows[-1][1:])]
    who += [("t0", None, ["d1"], []), ("t0", None, ["d0"], []), ("t1", "u2", ["d0", "d1", "d2"], [])]
    found = A.visible_to(spark.createDataFrame(rows, f"chunk_id string, {ACL}"), spark.createDataFrame(who, PRINCIPAL))
    assert found.columns == ["chunk_id", *(f.split()[0] for f in ACL.split(", ")), "principal_id"]
    got = Counter((r["principal_id"], r["chunk_id"], r["visibility"]) for r in found.collect())
    assert got == Counter((w[1], r[0], r[4]) for w in who for r in rows if may_see(r[1:], w))


def test_visible_pairs_of_many_chunks_are_small_when_written(spark):
    """Two bytes a pair before: the ids of 40,000 chunks came over and over, too far apart for compression."""
    import glob

    chunks = spark.range(40_000).selectExpr("concat('c', id) AS chunk_id", "'t0' AS tenant_id", "'u1' AS owner_id", "'d1' AS department_id",
                                         "'TENANT' AS visibility", "array('u1') AS allowed_user_ids", "array('r1') AS allowed_role_ids")
    people = spark.range(300).selectExpr("'t0' AS tenant_id", "concat('u', id) AS user_id", "array('d1') AS department_ids",
                                            "array('r1') AS role_ids")
    path = work_path(spark, "visible")
    A.visible_to(chunks, people).select("principal_id", "chunk_id", "visibility").write.parquet(path)
    assert spark.read.parquet(path).count() == 300 * 40_000
    assert sum(map(os.path.getsize, glob.glob(path.removeprefix("file://") + "/*.parquet"))) < 0.6 * 300 * 40_000


def test_tokens_do_not_mix_tenants(spark):
    chunks = spark.createDataFrame(
        [("c", "a:b", "c", None, "PRIVATE", None, None)], f"chunk_id string, {ACL}")
    people = spark.createDataFrame([("a", "b:c", [], [])], PRINCIPAL)
    assert A.visible_to(chunks, people).count() == 0


def test_live_and_current(spark):
    chunks = spark.createDataFrame(
        [("a", "d1", 2, "ACTIVE", "READY"), ("b", "d1", 1, "ACTIVE", "READY"),
         ("c", "d2", 1, "DELETED", "READY"), ("d", "d2", 1, None, None),
         ("e", "d3", 1, "ACTIVE", "PROCESSING")],
        "chunk_id string, document_id string, version int, status string, document_status string")
    docs = spark.createDataFrame([("d1", "READY", 2), ("d2", "READY", 1), ("d3", "FAILED", 1)],
                                 "document_id string, status string, current_version int")
    live = A.keep_current(A.filter_live(chunks), A.current_versions(docs))
    assert {r["chunk_id"] for r in live.collect()} == {"a", "d"}
    assert A.keep_current(chunks, A.current_versions(docs.filter("false"))).count() == 0


def dense_world(spark, n=400, q=7, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim))
    vectors[10] = vectors[11]  # an exact tie
    rows, who = world(seed, chunks=n)
    chunks = [(r[0], [float(x) for x in v], *r[1:]) for r, v in zip(rows, vectors)]
    chunks += [("zero", [0.0] * dim, "t0", "u0", None, "PUBLIC", None, None),
               ("short", [1.0], "t0", "u0", None, "PUBLIC", None, None),
               ("none", None, "t0", "u0", None, "PUBLIC", None, None)]
    queries = [(f"q{i}", [float(x) for x in rng.normal(size=dim)], *who[i]) for i in range(q)]
    return (spark.createDataFrame(chunks, f"chunk_id string, embedding array<double>, {ACL}"),
            spark.createDataFrame(queries, f"query_id string, embedding array<double>, {PRINCIPAL}"),
            chunks[:n], queries)


def brute_force(chunks, queries, k):
    out = set()
    for q in queries:
        scored = []
        for c in chunks:
            if may_see(c[2:], q[2:]):
                a, b = np.array(q[1]), np.array(c[1])
                score = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12)
                scored.append((-score, c[0]))
        out |= {(q[0], c, r + 1) for r, (_, c) in enumerate(sorted(scored)[:k])}
    return out


def test_dense_topk_equals_brute_force(spark):
    chunks, queries, plain, asked = dense_world(spark)
    vectors = queries.select("query_id", "embedding", A.principal_tokens().alias("tokens"))
    want = brute_force(plain, asked, 5)
    for block in (2048, 3):  # one block, and several
        best = D.dense_topk(vectors, chunks.repartition(5), 5, query_block=block)
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in best.collect()} == want
    bad = {r["chunk_id"]: r["reason"] for r in D.dense_rejects(chunks, 8).collect()}
    assert bad == {"zero": "ZERO_NORM", "short": "DIMENSION", "none": "NO_VECTOR"}


def test_threshold_comes_after_topk(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])],
                                   "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [r["chunk_id"] for r in D.dense_topk(queries, chunks, 2, 0.5).collect()] == ["a"]
    below = D.dense_topk(queries, chunks, 2, 0.5, include_below=True).orderBy("rank").collect()
    assert [(r["chunk_id"], r["included"], r["debug_info"]) for r in below] == [
        ("a", True, "score >= threshold"), ("b", False, "score < threshold")]
    with pytest.raises(ValueError):
        D.dense_topk(queries, chunks, 0)
    with pytest.raises(ValueError):
        D.dense_topk(queries, chunks, 1, threshold=2)


def test_ann_recall(spark):
    chunks, queries, plain, asked = dense_world(spark)
    vectors = queries.select("query_id", "embedding", A.principal_tokens().alias("tokens"))
    assigned, centres = D.build_ivf(chunks, 8)
    all_cells = D.ann_topk(vectors, assigned, centres, 5, nprobe=8).collect()
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in all_cells} == brute_force(
        plain, asked, 5)
    some = D.ann_topk(vectors, assigned, centres, 5, nprobe=6).collect()
    exact = {(q, c) for q, c, _ in brute_force(plain, asked, 5)}
    assert len({(r["query_id"], r["chunk_id"]) for r in some} & exact) >= 0.8 * len(exact)


def test_stored_ivf(spark):
    chunks, queries, plain, asked = dense_world(spark)
    vectors = queries.select("query_id", "embedding", A.principal_tokens().alias("tokens"))
    path = work_path(spark, "ivf")
    V.write_ivf(chunks, path, 8, rows_per_file=20)
    stored, centres = V.read_ivf(spark, path)
    hits = V.ivf_topk(vectors, stored, centres, 5, nprobe=8).collect()
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in hits} == brute_force(plain, asked, 5)
    for nprobe in (1, 3):
        assigned = stored.drop("code", "scale", "bound", "same")
        want = D.ann_topk(vectors, assigned, centres, 5, nprobe=nprobe).collect()
        got = V.ivf_topk(vectors, stored, centres, 5, nprobe=nprobe, query_block=4).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want}
    exact = {(q, c) for q, c, _ in brute_force(plain, asked, 5)}

    def recall(nprobe):
        found = V.ivf_topk(vectors, stored, centres, 5, nprobe).collect()
        return len({(r["query_id"], r["chunk_id"]) for r in found} & exact) / len(exact)

    enough = V.probes_for(vectors, stored, centres, 5, 0.9)
    assert recall(enough) >= 0.9 and (enough == 1 or recall(enough - 1) < 0.9)
    assert V.probes_for(vectors.filter("false"), stored, centres, 5) == 8
    plan = V.in_cells(stored, {1, 2})._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and "IN (1,2)" in plan


def test_stored_ivf_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03}", [1.0, 2.0, 3.0]) for i in range(300)]  # copies
    rows += [(f"d{i:03}", [1.0, 2.0, 3.0 + i * 1e-7]) for i in range(100)]  # codes can't tell them apart
    rows += [(f"e{i:03}", [float(x) for x in rng.normal(size=3)]) for i in range(100)]
    rows += [("f1", None), ("f2", [0.0, 0.0, 0.0]), ("f3", [1.0, None, 2.0]), ("f4", [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame(
        [("copy", [1.0, 2.0, 3.0]), ("near", [1.0, 2.0, 3.1]), ("far", [-3.0, 1.0, 0.5]), ("none", None),
         ("short", [1.0]), ("zero", [0.0, 0.0, 0.0])], "query_id string, embedding array<double>")
    path = work_path(spark, "ivf")
    V.write_ivf(chunks, path, 3)
    stored, centres = V.read_ivf(spark, path)
    for k in (1, 7, 450):
        exact = D.dense_topk(asked.filter("query_id IN ('copy', 'near', 'far')"), chunks.filter(
            "size(embedding) = 3"), k).drop("included", "debug_info").collect()
        got = V.ivf_topk(asked, stored, centres, k, nprobe=3).collect()
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got} == {
            (r["query_id"], r["chunk_id"], r["rank"]) for r in exact}
    nobody = V.ivf_topk(asked.filter("false"), stored, centres, 3, nprobe=2)
    assert nobody.count() == 0
    with pytest.raises(ValueError):
        V.write_ivf(chunks.filter("false"), work_path(spark, "ivf"), 3)


def bm25(texts, query):
    docs = {c: t.lower().split() for c, t in texts.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    scores = {}
    for c, words in docs.items():
        tf = Counter(words)
        scores[c] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5
                        / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / avg))
                        for w in set(query.lower().split()) if tf[w])
    return sorted(((-round(s, 9), c) for c, s in scores.items() if s > 0))


def test_bm25_statistics_follow_the_caller(spark):
    rng = random.Random(5)
    rows, who = world(2, chunks=120, people=4)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    texts = {r[0]: " ".join(rng.choices(words, k=rng.randrange(3, 30))) for r in rows}
    chunks = spark.createDataFrame([(r[0], texts[r[0]], *r[1:]) for r in rows],
                                   f"chunk_id string, content string, {ACL}")
    people = spark.createDataFrame(who, PRINCIPAL)
    asked = {f"q{i}": ("the w1 w2 w3 w4 w1", w) for i, w in enumerate(who)}
    queries = spark.createDataFrame(
        [(q, t, *w) for q, (t, w) in asked.items()], f"query_id string, text string, {PRINCIPAL}"
    ).select("query_id", "text", A.permission_signature().alias("signature"))
    best = L.bm25_topk(queries, chunks, 6, principals=people).collect()
    for q, (text, w) in asked.items():
        seen = {r[0]: texts[r[0]] for r in rows if may_see(r[1:], w)}
        want = [c for _, c in bm25(seen, text)[:6]] if seen else []
        got = [r["chunk_id"] for r in sorted(
            (r for r in best if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == want
    whole = L.bm25_topk(queries.drop("signature"), chunks, 6).filter("query_id = 'q0'")
    assert [r["chunk_id"] for r in whole.orderBy("rank").collect()] == [
        c for _, c in bm25(texts, "the w1 w2 w3 w4")[:6]]
    shared = L.bm25_topk(queries, chunks, 500, principals=people, scope="global").collect()
    assert {(r["query_id"], r["chunk_id"]) for r in shared} == {
        (r["query_id"], r["chunk_id"])
        for r in L.bm25_topk(queries, chunks, 500, principals=people).collect()}


def test_a_kept_index_scores_as_the_chunks_do(spark):
    rng = random.Random(11)
    rows, who = world(4, chunks=90, people=5)
    words = ["the"] * 20 + [f"w{i}" for i in range(30)]
    texts = {r[0]: " ".join(rng.choices(words, k=rng.randrange(0, 20))) for r in rows}
    chunks = spark.createDataFrame([(r[0], texts[r[0]], *r[1:]) for r in rows],
                                   f"chunk_id string, content string, {ACL}")
    path = work_path(spark, "index")
    L.write_index(chunks, path, buckets=7)
    index = L.read_index(spark, path)
    people = spark.createDataFrame(who, PRINCIPAL)
    queries = spark.createDataFrame(
        [(f"q{i}", "the w1 w2 missing", *w) for i, w in enumerate(who)],
        f"query_id string, text string, {PRINCIPAL}").select(
        "query_id", "text", A.permission_signature().alias("signature"))
    for options in ({"principals": people}, {"principals": people, "scope": "global"}, {}):
        asked = queries if options else queries.drop("signature")
        here, kept = (sorted(L.bm25_topk(asked, x, 8, **options).select(
            "query_id", "rank", "chunk_id", F.round("score", 8)).collect()) for x in (chunks, index))
        assert here == kept and here
    few = index.of_terms(spark.createDataFrame([("w1",)], "term string"))
    assert few.postings.select("term").distinct().count() < index.postings.select(
        "term").distinct().count()
    plan = few.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_an_index_of_nothing_and_queries_of_nothing(spark):
    ddl = f"chunk_id string, content string, {ACL}"
    path = work_path(spark, "index")
    L.write_index(spark.createDataFrame([], ddl), path)
    asked = spark.createDataFrame([("q", "a b"), ("null", None)], "query_id string, text string")
    some = spark.createDataFrame([("c", None), ("d", "")], "chunk_id string, content string")
    for chunks in (L.read_index(spark, path), spark.createDataFrame([], ddl), some):
        assert L.bm25_topk(asked, chunks, 3).count() == 0
        assert L.bm25_topk(asked.limit(0), chunks, 3).count() == 0


def test_search_checks_a_kept_index_against_the_chunks_of_today(spark):
    acl = ("t", "u", None, "TENANT", None, None)
    rows = [("a", "x", "d1", 1, "ACTIVE", "red fox", [1.0, 0.0], *acl),
            ("b", "x", "d2", 1, "ACTIVE", "red red fox", [0.9, 0.1], *acl),
            ("c", "x", "d3", 1, "ACTIVE", "red", [0.8, 0.2], *acl)]
    ddl = ("chunk_id string, filename string, document_id string, version int, status string, "
           f"content string, embedding array<double>, {ACL}")
    path = work_path(spark, "index")
    L.write_index(spark.createDataFrame(rows, ddl), path)
    now = [rows[0], (*rows[1][:4], "DELETED", *rows[1][5:]), rows[2]]
    documents = spark.createDataFrame([("d1", "READY", 1), ("d2", "READY", 1), ("d3", "READY", 2)],
                                      "document_id string, status string, current_version int")
    queries = spark.createDataFrame([("q", "red fox", [1.0, 0.0], "t", "u", [], [])],
                                    f"query_id string, text string, embedding array<double>, {PRINCIPAL}")
    for index in (None, L.read_index(spark, path)):
        found = R.search(queries, spark.createDataFrame(now, ddl), R.HYBRID, index=index,
                         documents=documents).collect()
        assert [(r["chunk_id"], r["rank"]) for r in found] == [("a", 1)]


def test_stale_chunks_of_a_kept_index_take_no_places(spark):
    acl, hidden = ("t", "u", None, "TENANT", None, None), ("t2", "u", None, "TENANT", None, None)
    ddl = ("chunk_id string, filename string, document_id string, version int, status string, "
           f"content string, embedding array<double>, {ACL}")
    row = lambda name, doc, text, status="ACTIVE", who=acl: (
        name, "x", doc, 1, status, text, [1.0, 0.0], *who)
    stale = [(f"s{i}", ("old", "gone", "moved")[i % 3]) for i in range(30)]
    then = [row(n, n if kind == "old" else "d", "red red red fox") for n, kind in stale] + [
        row("a", "d", "red fox stands by the long green river"), row("b", "d", "a red hen stands by the river")]
    now = [row(n, n if kind == "old" else "d", "red red red fox", "DELETED" if kind == "gone" else "ACTIVE",
               hidden if kind == "moved" else acl) for n, kind in stale] + then[-2:]
    path = work_path(spark, "index")
    L.write_index(spark.createDataFrame(then, ddl), path)
    documents = spark.createDataFrame([("d", "READY", 1), *((n, "READY", 2) for n, kind in stale if kind == "old")],
                                      "document_id string, status string, current_version int")
    queries = spark.createDataFrame([("q", "red fox", [1.0, 0.0], "t", "u", [], [])],
                                    f"query_id string, text string, embedding array<double>, {PRINCIPAL}")
    for index in (None, L.read_index(spark, path)):
        found = R.search(queries, spark.createDataFrame(now, ddl), R.HYBRID, k=3, configured_k=3, recall_k=3,
                         index=index, documents=documents).orderBy("rank").collect()
        # in both lists, at the same places: 2 / 61 and 2 / 62
        assert [(r["chunk_id"], round(r["score"], 6)) for r in found] == [("a", 0.032787), ("b", 0.032258)]


def test_a_kept_index_follows_its_chunks(spark):
    rng = random.Random(12)
    rows, who = world(6, chunks=120, people=5)
    words = ["the"] * 15 + [f"w{i}" for i in range(25)]
    ddl = f"chunk_id string, content string, {ACL}"
    texts = {r[0]: " ".join(rng.choices(words, k=rng.randrange(0, 15))) for r in rows}
    now = [(r[0], texts[r[0]], *r[1:]) for r in rows]
    closed = lambda r: (*r[:2], "t9", "u9", None, "PRIVATE", None, None)
    gone = [(f"gone{i}", "the w1 w2 " * 9, *now[0][2:]) for i in range(20)]
    path = work_path(spark, "index")
    # chunks that were closed then, one third; others were not there; some are gone since
    L.write_index(spark.createDataFrame([closed(r) for r in now[:40]] + now[40:60] + gone, ddl), path, buckets=5)
    queries = spark.createDataFrame([(f"q{i}", "the w1 w2 missing", *w) for i, w in enumerate(who)],
                                    f"query_id string, text string, {PRINCIPAL}").select(
        "query_id", "text", A.permission_signature().alias("signature"))
    people, chunks = spark.createDataFrame(who, PRINCIPAL), spark.createDataFrame(now, ddl)
    best = lambda corpus, **options: sorted(L.bm25_topk(
        queries if options else queries.drop("signature"), corpus, 8, **options).select(
        "query_id", "rank", "chunk_id", F.round("score", 8)).collect())
    options = ({"principals": people}, {"principals": people, "scope": "global"}, {})
    want = [best(chunks, **o) for o in options]
    assert [best(L.read_index(spark, path).current(chunks), **o) for o in options] == want and all(want)
    for _ in range(2):  # the second one finds nothing to do
        L.append_index(chunks, path)
    index = L.read_index(spark, path)
    assert [best(index, **o) for o in options] == want
    assert index.state.count() == len(now) and index.current(chunks).state.filter("home < 0").count() == 0
    L.append_index(chunks.limit(0), path)
    assert best(L.read_index(spark, path)) == []


def test_bm25_exact_code(spark):
    chunks = spark.createDataFrame([("c1", "设备 A12345 退款"), ("c2", "设备 A12346 退款")],
                                   "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "A12345 退款"), ("blank", " ")],
                                    "query_id string, text string")
    best = L.bm25_topk(queries, chunks, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in best] == [("q", "c1"), ("q", "c2")]


def test_keyword_search_matches_substrings(spark):
    docs = spark.createDataFrame(
        [("1", "Refunds", "nothing", 1), ("2", "x", "prefunded 年假", 2), ("3", "fund", "fund", 3),
         ("4", "", "", 4)], "document_id string, title string, content string, created_at int")
    queries = spark.createDataFrame([("q", "FUND 年")], "query_id string, text string")
    best = L.keyword_title_topk(queries, docs).orderBy("rank").collect()
    assert [(r["document_id"], r["score"]) for r in best] == [("3", 4), ("1", 3), ("2", 2)]


def ranked(spark, name, *ids):
    return spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)],
                                 "query_id string, chunk_id string, rank int")


def test_rrf(spark):
    dense, words = ranked(spark, "d", "a", "b", "c"), ranked(spark, "w", "c", "d", "a")
    fused = R.rrf_fuse([dense, words], limit=4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in fused] == ["a", "c", "b", "d"]
    assert fused[0]["debug_info"] == "rrf score=0.0323" and fused[0]["included"]
    swapped = R.rrf_fuse([words, dense], limit=4).collect()
    assert {(r["chunk_id"], r["score"]) for r in swapped} == {
        (r["chunk_id"], r["score"]) for r in fused}


def test_rerank_keeps_fused_score(spark):
    rows = [("q", "text", f"c{i}", "hit" if i == 3 else "no", 1.0 - i / 10, i + 1, "rrf")
            for i in range(4)]
    candidates = spark.createDataFrame(rows, "query_id string, query string, chunk_id string, "
                                       "content string, score double, rank int, debug_info string")
    score = lambda q, t: [float(x == "hit") for x in t]
    by_rank = R.rerank(candidates, score, 2, order_by="rank").orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in by_rank] == [("c3", 0.7), ("c0", 1.0)]
    by_score = R.rerank(candidates, score, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in by_score] == ["c0", "c3"]

    def broken(q, t):
        raise RuntimeError("no scorer")

    kept = R.rerank(candidates, broken, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["debug_info"]) for r in kept] == [("c0", "rrf"), ("c1", "rrf")]


HITS = ("query_id string, chunk_id string, document_id string, filename string, content string, "
        "score double, rank int, parent_id string")


def test_parents_stand_in_once(spark):
    hits = spark.createDataFrame(
        [("q", "c1", "d", "f", "child 1", 0.9, 1, "p1"), ("q", "c2", "d", "f", "child 2", 0.8, 2, "p1"),
         ("q", "c3", "d", "f", "child 3", 0.7, 3, None)], HITS)
    parents = spark.createDataFrame([("p1", "whole section")], "parent_id string, content string")
    packed = X.pack_context(hits, parents)
    row = X.assemble_context(packed).first()
    assert row["source_chunk_ids"] == ["c1", "c3"]
    assert row["context"] == "[1]\n文件：f\n内容：whole section\n\n[2]\n文件：f\n内容：child 3\n\n"
    assert [r["preview"] for r in packed.orderBy("n").collect()] == ["child 1", "child 3"]
    flags = {r["chunk_id"]: r["in_context"] for r in X.debug_chunks(hits, packed).collect()}
    assert flags == {"c1": True, "c2": False, "c3": True}


def test_budgets_stop_at_the_first_overflow(spark):
    hits = spark.createDataFrame(
        [("q", "c1", "d", "f", "short", 0.95, 1, None), ("q", "c2", "d", "f", "x" * 400, 0.5, 2, None),
         ("q", "c3", "d", "f", "tiny", 0.3, 3, None)], HITS)
    assert [r["chunk_id"] for r in X.pack_context(hits, max_tokens=20).collect()] == ["c1"]
    assert [r["chunk_id"] for r in X.pack_context(hits, max_chars=60).collect()] == ["c1"]
    assert X.pack_context(hits).count() == 3
    queries = spark.createDataFrame([("q", "a"), ("other", "b")], "query_id string, text string")
    answers = X.answerability(queries, hits, X.pack_context(hits, max_chars=5),
                              X.context_budget("text")).collect()
    assert {r["query_id"]: r["reason"] for r in answers} == {
        "q": "NOTHING_PACKED", "other": "NO_HITS"}


def test_plans_trim_before_the_shuffle(spark):
    rows = spark.createDataFrame([("q", "c", 1.0)], "query_id string, chunk_id string, score double")
    from quarry.operators.skew import topk

    plan = topk(rows, ["query_id"], [F.desc("score")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("parts", [1, 8])
def test_rerank_fails_per_query(spark, parts):
    rows = [(q, q, f"{q}{i}", "bad" if q == "x" and i == 2 else str(i), 1.0 - i / 10, i + 1, "rrf")
            for q in "wxyz" for i in range(4)]
    candidates = spark.createDataFrame(rows, "query_id string, query string, chunk_id string, content string, "
                                       "score double, rank int, debug_info string").repartition(parts)

    def score(queries, texts):
        if "bad" in texts:
            raise RuntimeError("no scorer")
        return [None if t == "0" and q == "y" else float(t) for q, t in zip(queries, texts)]

    got = {}
    for r in R.rerank(candidates, score, 4, order_by="rank").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {"w": ["w3", "w2", "w1", "w0"], "x": ["x0", "x1", "x2", "x3"], "y": ["y3", "y2", "y1"],
                   "z": ["z3", "z2", "z1", "z0"]}


def test_missing_names_keep_their_place(spark):
    hits = spark.createDataFrame(
        [("q", "c1", "d", None, "a", 0.9, 1, "p9"), ("q", "c2", "d", "f", None, 0.8, 2, None),
         ("q", "c3", "d", "f", "x" * 500, 0.7, 3, None)], HITS)
    parents = spark.createDataFrame([("p1", "body")], "parent_id string, content string")
    packed = X.pack_context(hits, parents, max_chars=200).orderBy("n").collect()
    assert [r["section"] for r in packed] == ["[1]\n文件：null\n内容：a\n\n", "[2]\n文件：f\n内容：null\n\n"]
    assert all(r["truncated"] for r in packed)


def test_odd_queries_do_not_stop_the_batch(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0]), ("n", [None, 1.0])],
                                   "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [1.0, 0.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)],
                                    "query_id string, embedding array<double>")
    got = {(r["query_id"], r["chunk_id"]) for r in D.dense_topk(queries, chunks, 1).collect()}
    assert got == {("q", "a"), ("r", "c")}
    assert {r["query_id"] for r in D.query_rejects(queries).collect()} == {"zero", "none"}


def test_python_steps_get_texts_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from quarry.operators import lexical as L
    from quarry.operators.models import embed_incremental
    from quarry.session import BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"term": [str(batch.nbytes)], "chunk_id": ["c"], "acl_class": ["*"], "tf": pa.array([1], pa.int32()),
                 "dl": pa.array([1], pa.int32())})

    def limited(texts):
        assert sum(map(len, texts)) <= 2 * BATCH_BYTES
        return [[1.0]] * len(texts)

    texts = spark.range(2000).coalesce(1).selectExpr(
        "cast(id AS string) AS chunk_id", "concat(repeat('some words ', 500), id) AS content")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(L, "_count_terms", sizes)
    spark.conf.set(name, 1 << 30)
    postings = L.build_inverted_index(texts).postings.collect()
    assert max(int(r["term"]) for r in postings) <= 2 * BATCH_BYTES
    spark.conf.set(name, 1 << 30)
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    vectors, _ = embed_incremental(texts, cache, "m", limited, "content")
    assert vectors.count() == 2000
