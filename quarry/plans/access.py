"""Queries for filters and access rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators import access as A
from quarry.operators.dense import dense_topk
from quarry.plans import bindings as B
from quarry.plans.registry import query


def sql_access(c: str, p: str) -> str:
    """Access rule between a chunk row and a principal row."""
    return f"""({c}.tenant_id = {p}.tenant_id AND CASE {c}.visibility
      WHEN 'PRIVATE' THEN {c}.owner_id = {p}.user_id
      WHEN 'DEPARTMENT' THEN list_contains({p}.department_ids, {c}.department_id)
      WHEN 'TENANT' THEN true WHEN 'PUBLIC' THEN true
      WHEN 'CUSTOM' THEN list_contains({c}.allowed_user_ids, {p}.user_id)
        OR list_has_any({c}.allowed_role_ids, {p}.role_ids) ELSE false END)"""


@query("filter_live", B.with_views("kb_chunks", """SELECT chunk_id, tenant_id, visibility, version
    FROM kb_chunks WHERE tenant_id = 't1' AND status = 'ACTIVE' AND document_status = 'READY'
      AND version = 2 AND visibility = 'PUBLIC'"""))
def filter_live(spark, sf_dir):
    return A.filter_live(B.kb_chunks(spark, sf_dir), tenant_id="t1", version=2,
                         visibility="PUBLIC").select("chunk_id", "tenant_id", "visibility",
                                                     "version")


@query("current_versions", B.with_views("live_chunks",
                                        "SELECT chunk_id, document_id, version FROM live_chunks"))
def current_versions(spark, sf_dir):
    return B.live_chunks(spark, sf_dir).select("chunk_id", "document_id", "version")


@query("visible_to", B.with_views("live_chunks users", f"""SELECT u.user_id AS principal_id, c.chunk_id,
    c.visibility FROM live_chunks c JOIN users u ON {sql_access('c', 'u')}"""))
def visible_to(spark, sf_dir):
    chunks = B.live_chunks(spark, sf_dir).drop("content", "embedding")
    return A.visible_to(chunks, B.users(spark, sf_dir), columns=["chunk_id", "visibility"]).select(
        "principal_id", "chunk_id", "visibility")


@query("can_access_one", B.with_views("live_chunks", f"""SELECT c.chunk_id, c.visibility FROM live_chunks c,
    (SELECT 't0' AS tenant_id, 'u3' AS user_id, ['d3', 'd6'] AS department_ids, ['r3'] AS role_ids) p
    WHERE {sql_access('c', 'p')}"""))
def can_access_one(spark, sf_dir):
    allowed = A.can_access("t0", "u3", ["d3", "d6"], ["r3"])
    return B.live_chunks(spark, sf_dir).filter(allowed).select("chunk_id", "visibility")


_SIGNATURE = """sha256(tenant_id || '|' || user_id || '|' || array_to_string(list_sort(department_ids), ',')
    || '|' || array_to_string(list_sort(role_ids), ','))"""


@query("permission_signature", B.with_views("users", f"""SELECT user_id, {_SIGNATURE} AS signature
    FROM users"""))
def permission_signature(spark, sf_dir):
    return B.users(spark, sf_dir).select("user_id", A.permission_signature().alias("signature"))


def _stale_results(spark, sf_dir):
    """Every chunk as a result of one principal, as an old cache would hold it."""
    chunks = B.kb_chunks(spark, sf_dir).drop("content", "embedding")
    number = F.substring("chunk_id", 2, 20).cast("long") % B.users(spark, sf_dir).count()
    return chunks.withColumn("principal_id", B.tag("u", number))


@query("recheck_access", B.with_views("kb_docs kb_chunks users", f"""SELECT c.chunk_id, u.user_id AS principal_id
    FROM kb_chunks c JOIN users u ON u.user_id = 'u' || substring(c.chunk_id, 2)::BIGINT % (SELECT count(*) FROM users)
      AND {sql_access('c', 'u')}
    JOIN kb_docs d ON d.document_id = c.document_id AND d.status = 'READY'
      AND d.current_version = c.version AND d.tenant_id = u.tenant_id
    WHERE c.status = 'ACTIVE' AND c.document_status = 'READY'"""))
def recheck_access(spark, sf_dir):
    return A.recheck_access(_stale_results(spark, sf_dir), B.kb_docs(spark, sf_dir),
                            B.users(spark, sf_dir)).select("chunk_id", "principal_id")


_SCORED = """SELECT q.query_id, 'c' || e.vec_id AS chunk_id,
      list_cosine_similarity(q.embedding, e.embedding::DOUBLE[]) AS score
    FROM dense_queries q, embeddings e"""


@query("apply_threshold", B.with_views("dense_queries", """SELECT query_id, chunk_id, round(score, 6) AS score,
      score >= 0.3 AS included, CASE WHEN score >= 0.3 THEN 'score >= threshold'
        ELSE 'score < threshold' END AS debug_info
    FROM scored QUALIFY row_number() OVER (PARTITION BY query_id
      ORDER BY round(score, 12) DESC, chunk_id) <= 40""", scored=_SCORED))
def apply_threshold(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    best = dense_topk(B.dense_queries(spark, sf_dir).select("query_id", "embedding"), vectors, 40,
                      include_below=True).select("query_id", "chunk_id", "score")
    return A.apply_threshold(best, 0.3, include_below=True).withColumn(
        "score", F.round("score", 6))


@query("allowed_tools", B.with_views("users tool_policy", """SELECT u.tenant_id, u.user_id, p.tool_name
    FROM users u JOIN (VALUES ('query_order', 'order:query'), ('cancel_order', 'order:cancel'),
      ('search_knowledge_base', 'knowledge:search')) AS t(tool_name, code)
      ON list_contains(u.permissions, t.code) JOIN tool_policy p ON p.tool_name = t.tool_name
    WHERE p.enabled AND (len(allowed_tenant_ids) = 0 OR list_contains(allowed_tenant_ids, u.tenant_id))
      AND (len(allowed_role_ids) = 0 OR list_has_any(allowed_role_ids, u.role_ids))"""))
def allowed_tools(spark, sf_dir):
    tools = spark.createDataFrame(list(C.TOOL_PERMISSIONS.items()),
                                  "tool_name string, permission_code string")
    return A.allowed_tools(B.users(spark, sf_dir), tools, B.tool_policy(spark))
