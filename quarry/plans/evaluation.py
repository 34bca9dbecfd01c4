"""Queries for retrieval evaluation. Truth: the label of a vector, or the unrestricted best chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluate as V
from quarry.operators import fusion as R
from quarry.operators.dense import dense_topk
from quarry.operators.usage import latency_percentiles
from quarry.plans import bindings as B
from quarry.plans import retrieval as Q
from quarry.plans.registry import query

K = 10

# ---- per case -----------------------------------------------------------------------------------


def cases(spark, sf_dir):
    """One case per benchmark text. It expects its three best chunks over all documents: by chunk id
    for even items, by filename or document id for the others; every seventh expects nothing."""
    best = Q.global_bm25(spark, sf_dir, 3)
    docs = B.kb_docs(spark, sf_dir).select(
        F.concat(F.lit("c"), "document_id").alias("chunk_id"), "document_id", "filename")
    found = best.join(docs, "chunk_id").groupBy("query_id").agg(
        F.collect_list("chunk_id").alias("chunks"), F.collect_list(F.when(
            F.col("rank") == 1, F.col("filename")).otherwise(F.col("document_id"))).alias("docs"))
    n = F.substring("query_id", 2, 20).cast("long")
    empty = F.array().cast("array<string>")
    asked = B.text_queries(spark, sf_dir).select("query_id", "text")
    return asked.join(found, "query_id").select(
        F.col("query_id").alias("case_id"), F.col("text").alias("question"),
        F.when((n % 7 != 0) & (n % 2 == 0), F.col("chunks")).otherwise(empty)
        .alias("expected_chunk_ids"),
        F.when(n % 7 != 0, F.col("docs")).otherwise(empty).alias("expected_document_ids"))


_CASES = """SELECT query_id AS case_id, CASE WHEN n % 7 <> 0 AND n % 2 = 0 THEN chunks ELSE [] END AS chunks,
      CASE WHEN n % 7 <> 0 THEN docs ELSE [] END AS docs FROM (SELECT b.query_id,
        substring(b.query_id, 2)::BIGINT AS n, list(b.chunk_id) AS chunks,
        list(CASE WHEN b.rank = 1 THEN d.filename ELSE d.document_id END) AS docs
      FROM global_best b JOIN kb_docs d ON 'c' || d.document_id = b.chunk_id WHERE b.rank <= 3
      GROUP BY b.query_id)"""
_GLOBAL = {f"g_{n}": t for n, t in Q._GLOBAL.items()}
_GLOBAL = {n: t.replace("FROM postings", "FROM g_postings").replace("FROM sizes", "FROM g_sizes")
           for n, t in _GLOBAL.items()}
_GLOBAL_BEST = (Q._GLOBAL_SCORES.replace("FROM terms t", "FROM g_terms t")
                .replace("JOIN postings p", "JOIN g_postings p").replace("JOIN df ON", "JOIN g_df df ON")
                .replace("JOIN sizes z", "JOIN g_sizes z").replace(", total GROUP", ", g_total GROUP"))
_EVAL = {**Q.HYBRID, **_GLOBAL, "global_best": _GLOBAL_BEST, "cases": _CASES,
         "results": f"""SELECT f.query_id AS case_id, f.rank, f.chunk_id, c.document_id, c.filename
      FROM fused f JOIN live_chunks c ON c.chunk_id = f.chunk_id WHERE f.rank <= {K}""",
         "matched": """SELECT c.case_id, CASE WHEN len(chunks) > 0 THEN len(chunks) ELSE len(docs) END AS wanted,
      r.rank, r.chunk_id, CASE WHEN len(chunks) > 0 THEN CASE WHEN list_contains(chunks, r.chunk_id)
          THEN r.chunk_id END WHEN list_contains(docs, r.filename) THEN r.filename
        WHEN list_contains(docs, r.document_id) THEN r.document_id END AS token
      FROM cases c LEFT JOIN results r ON r.case_id = c.case_id""",
         "metrics": """SELECT case_id, count(token) > 0 AS hit, CASE WHEN any_value(wanted) > 0 THEN
        count(DISTINCT token) / any_value(wanted)::DOUBLE ELSE 0.0::DOUBLE END AS recall,
      coalesce(1.0::DOUBLE / min(CASE WHEN token IS NOT NULL THEN rank END), 0.0::DOUBLE) AS mrr,
      coalesce(string_agg(chunk_id, ',' ORDER BY rank) FILTER (token IS NOT NULL), '') AS hit_chunk_ids
      FROM matched GROUP BY case_id"""}
_VIEWS = "text_queries live_chunks kb_docs"


def results(spark, sf_dir, mode=R.HYBRID, k=K):
    best = Q.search(spark, sf_dir, mode, k=k, configured_k=k, threshold=-1.0)
    chunks = B.live_chunks(spark, sf_dir).select("chunk_id", "document_id", "filename", "label")
    return best.join(chunks, "chunk_id").withColumnRenamed("query_id", "case_id")


@query("retrieval_metrics", B.with_views(_VIEWS, """SELECT case_id, hit, round(recall, 6) AS recall,
    round(mrr, 6) AS mrr, hit_chunk_ids FROM metrics""", **_EVAL))
def retrieval_metrics(spark, sf_dir):
    rows = V.retrieval_metrics(cases(spark, sf_dir), results(spark, sf_dir))
    return rows.select("case_id", "hit", F.round("recall", 6).alias("recall"),
                       F.round("mrr", 6).alias("mrr"),
                       F.array_join("hit_chunk_ids", ",").alias("hit_chunk_ids"))


@query("eval_summary", B.with_views(_VIEWS, """SELECT count(*) AS cases, round(avg(hit::INT), 6) AS hit_rate,
      round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(length(text)), 6) AS avg_latency_ms,
      sum(length(text))::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens,
      sum(length(text))::BIGINT AS total_tokens
    FROM metrics JOIN text_queries ON query_id = case_id""", **_EVAL))
def eval_summary(spark, sf_dir):
    known = cases(spark, sf_dir)
    sizes = known.select("case_id", F.length("question").cast("long").alias("latency_ms"))
    rows = V.retrieval_metrics(known, results(spark, sf_dir)).join(sizes, "case_id")
    summary = V.eval_summary(
        rows.withColumn("prompt_tokens", F.col("latency_ms"))
        .withColumn("completion_tokens", F.lit(None).cast("long"))
        .withColumn("total_tokens", F.col("latency_ms")))
    return summary.withColumns({c: F.round(c, 6) for c in (
        "hit_rate", "recall", "mrr", "avg_latency_ms")})


@query("eval_errors", B.with_views(_VIEWS, """SELECT m.case_id, NOT failed AS success,
      CASE WHEN failed THEN false ELSE hit END AS hit,
      CASE WHEN failed THEN 0.0::DOUBLE ELSE round(recall, 6) END AS recall,
      CASE WHEN failed THEN 0.0::DOUBLE ELSE round(mrr, 6) END AS mrr,
      CASE WHEN failed THEN 'TIMEOUT' END AS error_code,
      CASE WHEN failed THEN left(text, 300) END AS error_message
    FROM metrics m JOIN (SELECT *, length(text) % 3 = 0 AS failed FROM text_queries) q
      ON q.query_id = m.case_id""", **_EVAL))
def eval_errors(spark, sf_dir):
    known = cases(spark, sf_dir)
    failed = known.filter(F.length("question") % 3 == 0).select(
        "case_id", F.lit("TIMEOUT").alias("error_code"), F.col("question").alias("error_message"))
    rows = V.eval_errors(known, V.retrieval_metrics(known, results(spark, sf_dir)), failed)
    return rows.withColumns({c: F.round(c, 6) for c in ("recall", "mrr")})


@query("sources_cover_expected", B.with_views(_VIEWS, """SELECT c.case_id, len(list_filter(docs, lambda d:
      NOT list_contains(coalesce(s.seen, []), d))) = 0 AS covered FROM cases c LEFT JOIN (
    SELECT case_id, list_concat(list(document_id), list(filename)) AS seen FROM results GROUP BY case_id) s
    ON s.case_id = c.case_id""", **_EVAL))
def sources_cover_expected(spark, sf_dir):
    return V.sources_cover_expected(cases(spark, sf_dir), results(spark, sf_dir))


@query("phrase_match", """SELECT conv_id, turn, CASE WHEN expected = '' THEN true
      WHEN contains(text, expected) THEN true ELSE len(list_filter(regexp_split_to_array(expected,
        '[,，。；;、\\s]+'), lambda p: length(p) >= 2 AND contains(lower(text), lower(p)))) > 0 END AS matched
    FROM (SELECT c.*, CASE WHEN turn % 4 = 3 THEN '' ELSE coalesce(b.text, 'zz，qq') END AS expected
      FROM conversations c LEFT JOIN benchmark b ON b.item_id = c.conv_id + 5 * c.turn)""")
def phrase_match(spark, sf_dir):
    asked = B.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    talk = B.table(spark, sf_dir, "conversations").withColumn(
        "item_id", F.col("conv_id") + 5 * F.col("turn"))
    expected = F.when(F.col("turn") % 4 == 3, "").otherwise(F.coalesce("item", F.lit("zz，qq")))
    return talk.join(asked, "item_id", "left").select(
        "conv_id", "turn", V.phrase_match("text", expected).alias("matched"))


# ---- per mode -----------------------------------------------------------------------------------

def label_cases(spark, sf_dir):
    queries = B.text_queries(spark, sf_dir)
    return queries.select(F.col("query_id").alias("case_id"), F.length("text").alias("size"),
                          F.array(F.col("label").cast("string")).alias("expected_keys"))


def keyed(rows):
    """Results with the label as key; a chunk without one is no label's chunk."""
    return rows.select("case_id", F.coalesce(F.col("label").cast("string"), F.lit("none"))
                       .alias("key"))


_KEYS = {m: f"""SELECT q.query_id AS case_id, length(q.text) AS size, q.label AS wanted, r.chunk_id,
      coalesce(r.label = q.label, false) AS relevant FROM text_queries q LEFT JOIN (
        SELECT s.query_id, s.chunk_id, c.label FROM {source} s JOIN live_chunks c USING (chunk_id)
        WHERE s.rank <= {K}) r ON r.query_id = q.query_id"""
         for m, source in (("vector_keys", "dense"), ("hybrid_keys", "fused"))}
_PER_CASE = """SELECT case_id, count(*) FILTER (relevant) AS relevant, count(chunk_id) AS returned,
      CASE WHEN count(chunk_id) > 0 THEN count(*) FILTER (relevant) / count(chunk_id)::DOUBLE ELSE 0 END
        AS relevance, bool_or(relevant) AS doc_hit, any_value(size) AS size FROM {} GROUP BY case_id"""
_MODES = {**Q.HYBRID, **_KEYS, "vector_cases": _PER_CASE.format("vector_keys"),
          "hybrid_cases": _PER_CASE.format("hybrid_keys")}
_LABEL_VIEWS = "text_queries live_chunks"


@query("relevance_at_k", B.with_views(_LABEL_VIEWS, """SELECT case_id, relevant, returned,
    round(relevance, 6) AS relevance, doc_hit FROM hybrid_cases""", **_MODES))
def relevance_at_k(spark, sf_dir):
    rows = V.relevance_at_k(label_cases(spark, sf_dir), keyed(results(spark, sf_dir)))
    return rows.withColumn("relevance", F.round("relevance", 6))


@query("paired_lift", B.with_views(_LABEL_VIEWS, """SELECT count(*) AS cases,
      count(*) FILTER (h.doc_hit) AS base_hits, count(*) FILTER (v.doc_hit) AS treated_hits,
      round(avg(h.doc_hit::INT), 6) AS base_rate, round(avg(v.doc_hit::INT), 6) AS treated_rate,
      round(avg(v.doc_hit::INT) - avg(h.doc_hit::INT), 6) AS lift
    FROM hybrid_cases h JOIN vector_cases v ON v.case_id = h.case_id""", **_MODES))
def paired_lift(spark, sf_dir):
    known = label_cases(spark, sf_dir)
    hit = {m: V.relevance_at_k(known, keyed(results(spark, sf_dir, m))).withColumnRenamed(
        "doc_hit", "hit") for m in (R.VECTOR, R.HYBRID)}
    row = V.paired_lift(hit[R.HYBRID], hit[R.VECTOR])
    return row.withColumns({c: F.round(c, 6) for c in ("base_rate", "treated_rate", "lift")})


_QUESTIONS = """SELECT 'vector' AS mode, case_id, doc_hit, relevance, relevant > 1 AS phrase_hit,
      size AS retrieval_ms, size * 3 + relevant AS total_ms FROM vector_cases UNION ALL
    SELECT 'hybrid', case_id, doc_hit, relevance, relevant > 1, size, size * 3 + relevant FROM hybrid_cases"""


def sql_rank(q: float, value: str) -> str:
    """Nearest rank on index round(q * (n - 1)), half up."""
    return f"list_sort(list({value}))[least(count(*) - 1, floor({q} * (count(*) - 1) + 0.5))::INT + 1]"


@query("compare_modes", B.with_views(_LABEL_VIEWS, f"""SELECT mode, count(*) AS questions,
      count(*) FILTER (doc_hit) AS hits, round(avg(doc_hit::INT), 6) AS hit_rate,
      round(avg(relevance), 6) AS relevance, round(avg(phrase_hit::INT), 6) AS phrase_rate,
      {sql_rank(0.5, 'retrieval_ms')}::BIGINT AS retrieval_p50, {sql_rank(0.5, 'total_ms')}::BIGINT AS total_p50,
      {sql_rank(0.95, 'total_ms')}::BIGINT AS total_p95 FROM questions GROUP BY mode""",
    **_MODES, questions=_QUESTIONS))
def compare_modes(spark, sf_dir):
    known = label_cases(spark, sf_dir)
    parts = []
    for mode in (R.VECTOR, R.HYBRID):
        rows = V.relevance_at_k(known, keyed(results(spark, sf_dir, mode)))
        parts.append(rows.join(known.select("case_id", "size"), "case_id").select(
            F.lit(mode.lower()).alias("mode"), "case_id", "doc_hit", "relevance",
            (F.col("relevant") > 1).alias("phrase_hit"),
            F.col("size").cast("long").alias("retrieval_ms"),
            (F.col("size") * 3 + F.col("relevant")).alias("total_ms")))
    rows = V.compare_modes(parts[0].unionByName(parts[1]))
    return rows.withColumns({c: F.round(c, 6) for c in ("hit_rate", "relevance", "phrase_rate")})


@query("dense_label_hit_rate", B.with_views("dense_queries live_chunks", """SELECT q.label, count(*) AS returned,
      count(*) FILTER (b.label = q.label) AS relevant FROM best b JOIN dense_queries q USING (query_id)
    WHERE b.rank <= 20 GROUP BY q.label""", best=Q._DENSE_ACL))
def dense_label_hit_rate(spark, sf_dir):
    best = dense_topk(Q.dense_inputs(spark, sf_dir), B.live_chunks(spark, sf_dir), 20)
    truth = B.dense_queries(spark, sf_dir).select("query_id", "label")
    seen = B.live_chunks(spark, sf_dir).select("chunk_id", F.col("label").alias("found"))
    return best.join(seen, "chunk_id").join(truth, "query_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col("found") == F.col("label")).alias("relevant"))


@query("latency_percentiles", B.with_views("usage", f"""SELECT interface_name, count(*) AS n,
      round(avg(latency_ms), 6) AS avg, {sql_rank(0.5, 'latency_ms')} AS p50,
      {sql_rank(0.95, 'latency_ms')} AS p95 FROM usage GROUP BY interface_name"""))
def latency(spark, sf_dir):
    rows = latency_percentiles(B.usage(spark, sf_dir), ["interface_name"], "latency_ms")
    return rows.withColumn("avg", F.round("avg", 6))


@query("export_eval_samples", B.with_views(_LABEL_VIEWS, f"""SELECT 'hybrid' AS mode, q.query_id AS case_id,
      sha256(string_agg(r.content, '|' ORDER BY r.rank)) AS contexts, 'c' || substring(q.query_id, 2) AS expected,
      coalesce(string_agg(r.chunk_id, ',' ORDER BY r.rank), '') AS retrieved,
      bool_or(r.chunk_id = 'c' || substring(q.query_id, 2)) AS doc_hit
    FROM text_queries q JOIN (SELECT f.query_id, f.chunk_id, f.rank, c.content FROM fused f JOIN live_chunks c
      USING (chunk_id) WHERE f.rank <= {K} AND c.content <> '') r ON r.query_id = q.query_id
    GROUP BY q.query_id""", **Q.HYBRID))
def export_eval_samples(spark, sf_dir):
    from quarry.session import work_path
    from quarry.sources.tables import export_samples, read_samples

    rows = Q.search(spark, sf_dir, R.HYBRID, k=K, configured_k=K).join(
        B.live_chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    asked = B.text_queries(spark, sf_dir).select("query_id", F.col("text").alias("question"))
    samples = rows.join(asked, "query_id").select(
        F.lit("hybrid").alias("mode"), F.col("query_id").alias("case_id"), "question", "rank",
        "content", F.col("chunk_id").alias("key"), F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("string").alias("reference"),
        F.array(F.concat(F.lit("c"), F.substring("query_id", 2, 20))).alias("expected_keys"))
    path = work_path(spark, "samples")
    export_samples(samples, path)
    return read_samples(spark, path).select(
        "mode", "case_id", F.sha2(F.array_join("contexts", "|"), 256).alias("contexts"),
        F.array_join("expected_keys", ",").alias("expected"),
        F.array_join("retrieved_keys", ",").alias("retrieved"), "doc_hit")
