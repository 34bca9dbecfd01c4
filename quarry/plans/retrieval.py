"""Queries for scoring, fusion, search modes and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators import context as X
from quarry.operators import dense as D
from quarry.operators import fusion as R
from quarry.operators import ivf as V
from quarry.operators import lexical as L
from quarry.operators.access import permission_signature, principal_tokens
from quarry.functions.vectors import cosine
from quarry.plans import bindings as B
from quarry.plans.access import sql_access
from quarry.plans.registry import SQL, query
from quarry.plans.text import sql_tokens
from quarry.session import cut, work_path

# ---- SQL building blocks ------------------------------------------------------------------------

SEEN = f"""SELECT q.query_id, c.chunk_id FROM text_queries q JOIN live_chunks c
    ON {sql_access('c', 'q')}"""
TOKENS = """SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term
    FROM live_chunks"""
POSTINGS = "SELECT chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL"
SIZES = """SELECT c.chunk_id, len(regexp_extract_all(lower(c.content), '[a-z0-9]+')) AS dl
    FROM live_chunks c"""
TERMS = """SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
    FROM text_queries"""
STATS = """SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM seen JOIN sizes USING (chunk_id)
    GROUP BY query_id"""
FREQUENCY = """SELECT t.query_id, t.term, count(*) AS df FROM terms t JOIN postings p ON p.term = t.term
    JOIN seen s ON s.query_id = t.query_id AND s.chunk_id = p.chunk_id GROUP BY ALL"""
BM25 = """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT f.query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5)
      / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
    FROM frequency f JOIN stats USING (query_id) JOIN postings p ON p.term = f.term
    JOIN seen s ON s.query_id = f.query_id AND s.chunk_id = p.chunk_id
    JOIN sizes z ON z.chunk_id = p.chunk_id GROUP BY ALL)"""
DENSE = f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.embedding, c.embedding), 12) AS score
    FROM text_queries q JOIN live_chunks c ON c.embedding IS NOT NULL AND {sql_access('c', 'q')})"""
FUSED = """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, first_list, first_rank, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score,
      min(list) AS first_list, arg_min(rank, list) AS first_rank FROM (
        SELECT query_id, chunk_id, rank, 0 AS list FROM dense WHERE rank <= 50 UNION ALL
        SELECT query_id, chunk_id, rank, 1 FROM bm25 WHERE rank <= 50) GROUP BY ALL)"""
LEXICAL = {"seen": SEEN, "tokens": TOKENS, "postings": POSTINGS, "sizes": SIZES, "terms": TERMS,
           "stats": STATS, "frequency": FREQUENCY, "bm25": BM25}
HYBRID = {**LEXICAL, "dense": DENSE, "fused": FUSED}


# ---- dense --------------------------------------------------------------------------------------

def dense_inputs(spark, sf_dir):
    queries = B.dense_queries(spark, sf_dir)
    return queries.select("query_id", "embedding", principal_tokens().alias("tokens"))


_DENSE_ACL = f"""SELECT query_id, chunk_id, label, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, c.label, round(list_cosine_similarity(q.embedding, c.embedding), 12)
      AS score FROM dense_queries q JOIN live_chunks c ON c.embedding IS NOT NULL
      AND {sql_access('c', 'q')})"""


@query("dense_topk", B.with_views("dense_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 6) AS score, rank::INT AS rank FROM best WHERE rank <= 10 AND score >= 0.3""",
    best=_DENSE_ACL))
def dense_topk(spark, sf_dir):
    best = D.dense_topk(dense_inputs(spark, sf_dir), B.live_chunks(spark, sf_dir), 10, 0.3)
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("cosine", B.with_views("label_centroids", """SELECT vec_id, e.label,
    round(list_cosine_similarity(c.embedding, e.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings e JOIN label_centroids c ON c.label = e.label"""))
def cosine_to_centroid(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings")
    means = B.label_centroids(spark, sf_dir).withColumnRenamed("embedding", "mean")
    return vectors.join(means, "label").select(
        "vec_id", "label", F.round(cosine("mean", "embedding"), 6).alias("similarity"))


_BAD = """SELECT vec_id, CASE vec_id % 8 WHEN 0 THEN NULL WHEN 1 THEN embedding[1:60]::DOUBLE[]
      WHEN 2 THEN list_transform(embedding, lambda x: 0.0) WHEN 3 THEN list_concat(embedding[1:63]::DOUBLE[], [NULL])
      ELSE embedding::DOUBLE[] END AS e FROM embeddings"""


@query("dense_rejects", f"""SELECT 'c' || vec_id AS chunk_id, CASE WHEN e IS NULL THEN 'NO_VECTOR' WHEN len(e) <> 64
      THEN 'DIMENSION' WHEN len(list_filter(e, lambda x: x IS NULL)) > 0 THEN 'NULL_VALUE' ELSE 'ZERO_NORM' END AS reason
    FROM ({_BAD}) WHERE vec_id % 8 < 4""")
def dense_rejects(spark, sf_dir):
    """All vectors, half of them spoilt in four ways."""
    n, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    bad = (F.when(n % 8 == 1, F.slice(e, 1, 60)).when(n % 8 == 2, F.transform(e, lambda x: F.lit(0.0)))
           .when(n % 8 == 3, F.concat(F.slice(e, 1, 63), F.array(F.lit(None).cast("double"))))
           .when(n % 8 > 3, e))
    chunks = B.table(spark, sf_dir, "embeddings").select(B.tag("c", n).alias("chunk_id"), bad.alias("embedding"))
    return D.dense_rejects(chunks, 64)


@query("ann_topk_all_cells", B.with_views("dense_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 6) AS score, rank::INT AS rank FROM best WHERE rank <= 10""", best=_DENSE_ACL))
def ann_topk_all_cells(spark, sf_dir):
    """With every cell probed the index gives what the exact search gives."""
    chunks = B.live_chunks(spark, sf_dir).select(
        "chunk_id", "embedding", "tenant_id", "owner_id", "department_id", "visibility",
        "allowed_user_ids", "allowed_role_ids")
    assigned, centres = D.build_ivf(chunks, n_cells=16)
    best = D.ann_topk(dense_inputs(spark, sf_dir), assigned, centres, 10, nprobe=16)
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("ann_topk")
def ann_topk(spark, sf_dir):
    chunks = B.live_chunks(spark, sf_dir).select(
        "chunk_id", "embedding", "tenant_id", "owner_id", "department_id", "visibility",
        "allowed_user_ids", "allowed_role_ids")
    assigned, centres = D.build_ivf(chunks, n_cells=16)
    return D.ann_topk(dense_inputs(spark, sf_dir), assigned, centres, 10, nprobe=6)


_INDEXED = ("chunk_id", "embedding", "tenant_id", "owner_id", "department_id", "visibility",
            "allowed_user_ids", "allowed_role_ids")


def stored_ivf(spark, sf_dir, n_cells=16):
    path = work_path(spark, "ivf")
    V.write_ivf(B.live_chunks(spark, sf_dir).select(*_INDEXED), path, n_cells)
    return V.read_ivf(spark, path)


@query("ivf_stored_all_cells", B.with_views("dense_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 6) AS score, rank::INT AS rank FROM best WHERE rank <= 10""", best=_DENSE_ACL))
def ivf_stored_all_cells(spark, sf_dir):
    """Codes preselect and lose nothing: with every cell probed the stored index is exact."""
    best = V.ivf_topk(dense_inputs(spark, sf_dir), *stored_ivf(spark, sf_dir), 10, nprobe=16)
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("ivf_stored_recall", B.with_views("dense_queries live_chunks", """SELECT
      count(DISTINCT query_id) AS queries, count(*) AS exact_hits, true AS recall_of_0_9
    FROM best WHERE rank <= 10""", best=_DENSE_ACL))
def ivf_stored_recall(spark, sf_dir):
    """The stored index against the exact search of all chunks; the number of cells to probe is set on
    half of the queries, by hash."""
    asked = dense_inputs(spark, sf_dir)
    exact = D.dense_topk(asked, B.live_chunks(spark, sf_dir), 10).select("query_id", "chunk_id")
    stored, centres = stored_ivf(spark, sf_dir)
    sample = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0)
    near = V.ivf_topk(asked, stored, centres, 10, V.probes_for(sample, stored, centres, 10))
    hit = near.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("exact_hits"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("recall_of_0_9"))


# ---- lexical ------------------------------------------------------------------------------------

@query("inverted_index", """SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, max(tf)::INT AS max_tf FROM (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id,
      unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL)
    GROUP BY term""")
def inverted_index(spark, sf_dir):
    chunks = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return L.build_inverted_index(chunks).postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("max_tf"))


def lexical_inputs(spark, sf_dir):
    return B.text_queries(spark, sf_dir).select(
        "query_id", "text", permission_signature().alias("signature"))


@query("bm25_topk", B.with_views("text_queries live_chunks", """SELECT query_id, chunk_id,
    round(score, 6) AS score, rank::INT AS rank FROM bm25 WHERE rank <= 10""", **LEXICAL))
def bm25_topk(spark, sf_dir):
    best = L.bm25_topk(lexical_inputs(spark, sf_dir), B.live_chunks(spark, sf_dir), 10,
                       principals=B.text_queries(spark, sf_dir))
    return best.withColumn("score", F.round("score", 6))


_GLOBAL = {"sizes": """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl
      FROM documents""",
           "postings": """SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id,
      unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL""",
           "terms": """SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))
      AS term FROM benchmark""",
           "df": "SELECT term, count(*) AS df FROM postings GROUP BY term",
           "total": "SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes"}
_GLOBAL_SCORES = """SELECT 'b' || item_id AS query_id, 'c' || doc_id AS chunk_id, score,
      row_number() OVER (PARTITION BY item_id ORDER BY score DESC, 'c' || doc_id) AS rank FROM (
    SELECT t.item_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5)
      / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
    FROM terms t JOIN postings p ON p.term = t.term JOIN df ON df.term = t.term
    JOIN sizes z ON z.doc_id = p.doc_id, total GROUP BY ALL)"""


def global_bm25(spark, sf_dir, k):
    """Every benchmark text against every document."""
    chunks = B.table(spark, sf_dir, "documents").select(
        B.tag("c", F.col("doc_id")).alias("chunk_id"), F.col("text").alias("content"))
    asked = B.table(spark, sf_dir, "benchmark").select(
        B.tag("b", F.col("item_id")).alias("query_id"), "text")
    return L.bm25_topk(asked, chunks, k)


@query("bm25_topk_global", "WITH " + ", ".join(f"{n} AS ({t})" for n, t in _GLOBAL.items()) +
       f", best AS ({_GLOBAL_SCORES}) SELECT query_id, chunk_id, round(score, 6) AS score, "
       "rank::INT AS rank FROM best WHERE rank <= 5")
def bm25_topk_global(spark, sf_dir):
    return global_bm25(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query("keyword_title_topk", """WITH terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
      lower(text), '[\\p{L}\\p{Nd}]{2,}')) AS term FROM benchmark), docs AS (SELECT doc_id,
      lower(source || ' ' || split_part(text, '.', 1)) AS title, lower(text) AS body, text FROM documents),
    vocabulary AS (SELECT DISTINCT term FROM terms),
    hits AS (SELECT doc_id, term, CASE WHEN contains(title, term) THEN 3 ELSE 0 END
        + CASE WHEN contains(body, term) THEN 1 ELSE 0 END AS points FROM docs, vocabulary
      WHERE contains(body, term) OR contains(title, term)),
    scores AS (SELECT item_id, doc_id, sum(points)::BIGINT AS score FROM hits JOIN terms USING (term)
      GROUP BY ALL)
    SELECT 'b' || item_id AS query_id, doc_id::VARCHAR AS document_id, score, rank::INT AS rank,
      CASE WHEN length(text) > 220 THEN left(text, 220) || '...' ELSE text END AS snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank
      FROM scores) JOIN documents USING (doc_id) WHERE rank <= 3""")
def keyword_title_topk(spark, sf_dir):
    docs = B.kb_docs(spark, sf_dir).select(
        "document_id", "content", "created_at", F.concat(
            F.split("filename", "-")[0], F.lit(" "), F.split("content", "\\.")[0]).alias("title"))
    asked = B.table(spark, sf_dir, "benchmark").select(
        B.tag("b", F.col("item_id")).alias("query_id"), "text")
    return L.keyword_title_topk(asked, docs).select(
        "query_id", "document_id", "score", "rank", "snippet")


# ---- fusion and search modes --------------------------------------------------------------------

def search(spark, sf_dir, mode, **options):
    return R.search(B.text_queries(spark, sf_dir), B.live_chunks(spark, sf_dir), mode, **options)


@query("rrf_fuse", B.with_views("text_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 9) AS score, rank::INT AS rank FROM fused WHERE rank <= 20""", **HYBRID))
def rrf_fuse(spark, sf_dir):
    queries, chunks = B.text_queries(spark, sf_dir), B.live_chunks(spark, sf_dir)
    dense = D.dense_topk(queries.select("query_id", "embedding", principal_tokens().alias("tokens")),
                         chunks, 50, include_below=True)
    lexical = L.bm25_topk(lexical_inputs(spark, sf_dir), chunks, 50, principals=queries)
    return R.rrf_fuse([dense, lexical], limit=20).select(
        "query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("search_vector", B.with_views("text_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 6) AS score, rank::INT AS rank, 'score >= threshold' AS debug_info FROM dense
    WHERE rank <= 3 AND score >= 0.1""", dense=DENSE))
def search_vector(spark, sf_dir):
    return search(spark, sf_dir, R.VECTOR, threshold=0.1).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "debug_info")


@query("search_hybrid", B.with_views("text_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 9) AS score, rank::INT AS rank, true AS included,
      'rrf score=' || printf('%.4f', floor(score * 10000 + 0.5) / 10000) AS debug_info FROM fused WHERE rank <= 3""", **HYBRID))
def search_hybrid(spark, sf_dir):
    return search(spark, sf_dir, R.HYBRID).withColumn("score", F.round("score", 9))


@query("search_kept_index", SQL["search_hybrid"])
def search_kept_index(spark, sf_dir):
    """The hybrid search over raw chunks, deleted ones and old versions among them, and a kept index
    of two earlier states: two thirds of the documents, all of them open to their tenant, then another
    two thirds as they are."""
    chunks, path = B.kb_chunks(spark, sf_dir), work_path(spark, "index")
    third = F.pmod(F.xxhash64("document_id"), F.lit(3))
    L.write_index(chunks.filter(third != 0).withColumn("visibility", F.lit(C.TENANT)), path)
    L.append_index(chunks.filter(third != 1), path)
    found = R.search(B.text_queries(spark, sf_dir), chunks, R.HYBRID, index=L.read_index(spark, path),
                     documents=B.kb_docs(spark, sf_dir))
    return found.withColumn("score", F.round("score", 9))


_RERANKED = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS again
    FROM (SELECT f.*, (len(q.words) - len(list_filter(q.words, lambda w: NOT list_contains(d.words, w))))
        / len(q.words)::DOUBLE AS relevance FROM fused f
      JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words
        FROM text_queries) q USING (query_id)
      JOIN (SELECT chunk_id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS words
        FROM live_chunks) d USING (chunk_id) WHERE f.rank <= 50)"""


def _ascii_overlap(queries, texts):
    import re

    out = []
    for q, t in zip(queries, texts):
        words = set(re.findall("[a-z0-9]+", q.lower()))
        found = set(re.findall("[a-z0-9]+", t.lower()))
        out.append(len(words & found) / len(words) if words else 0.0)
    return out


@query("search_hybrid_rerank", B.with_views("text_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, again)::INT
        AS rank, true AS included, 'reranked' AS debug_info FROM reranked WHERE again <= 3""",
    **HYBRID, reranked=_RERANKED))
def search_hybrid_rerank(spark, sf_dir):
    return search(spark, sf_dir, R.HYBRID_RERANK, scorer=_ascii_overlap).withColumn(
        "score", F.round("score", 9))


@query("rerank", B.with_views("text_queries live_chunks", """SELECT query_id, chunk_id,
      round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, again)::INT
        AS rank FROM reranked WHERE again <= 5""", **HYBRID, reranked=_RERANKED))
def rerank(spark, sf_dir):
    fused = search(spark, sf_dir, R.HYBRID, k=50, configured_k=50)
    texts = B.live_chunks(spark, sf_dir).select("chunk_id", "content")
    asked = B.text_queries(spark, sf_dir).select("query_id", F.col("text").alias("query"))
    pairs = fused.join(texts, "chunk_id").join(asked, "query_id")
    return R.rerank(pairs, _ascii_overlap, 5).select(
        "query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


# ---- context ------------------------------------------------------------------------------------

HITS_K = 8


def hits(spark, sf_dir):
    """Hybrid results with their chunk's columns, k rows per query, written once for all readers."""
    best = search(spark, sf_dir, R.HYBRID, k=HITS_K, configured_k=HITS_K)
    chunks = B.live_chunks(spark, sf_dir).select(
        "chunk_id", "document_id", "filename", "content", "parent_id")
    return cut(best.join(chunks, "chunk_id"), "hits")


HITS = f"""SELECT f.query_id, f.chunk_id, f.score, f.rank, c.document_id, c.filename, c.content, c.parent_id
    FROM fused f JOIN live_chunks c ON c.chunk_id = f.chunk_id WHERE f.rank <= {HITS_K}"""


def sql_packed(rows: str, body: str) -> str:
    return f"""SELECT * FROM (SELECT *, sum(length(section)) OVER w AS used_chars,
        sum({sql_tokens('section')}) OVER w AS used_tokens FROM (
      SELECT *, '[' || n || ']' || chr(10) || '文件：' || filename || chr(10) || '内容：' || {body}
        || chr(10) || chr(10) AS section FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM {rows}))
      WINDOW w AS (PARTITION BY query_id ORDER BY n))
    WHERE used_chars <= 3000 AND used_tokens <= 1200"""


PACKED = sql_packed("hits", "content")
_ONCE = """SELECT h.*, p.content AS parent FROM hits h LEFT JOIN parents p ON p.parent_id = h.parent_id
    QUALIFY row_number() OVER (PARTITION BY query_id, coalesce('p' || h.parent_id, 'c' || chunk_id)
      ORDER BY score DESC, rank) = 1"""
_SHOWN = """SELECT query_id, n::INT AS n, chunk_id, sha256(section) AS section_hash,
    used_chars::BIGINT AS used_chars, used_tokens::BIGINT AS used_tokens, left(content, 100) AS preview
    FROM packed"""


def _shown(packed):
    return packed.select("query_id", "n", "chunk_id", F.sha2("section", 256).alias("section_hash"),
                         F.col("used_chars").cast("long"), F.col("used_tokens").cast("long"),
                         "preview")


@query("pack_context", B.with_views("text_queries live_chunks", _SHOWN, **HYBRID, hits=HITS, packed=PACKED))
def pack_context(spark, sf_dir):
    return _shown(X.pack_context(hits(spark, sf_dir)))


@query("pack_context_parents", B.with_views("text_queries live_chunks parents", _SHOWN, **HYBRID, hits=HITS,
                                            once=_ONCE, packed=sql_packed("once", "coalesce(parent, content)")))
def pack_context_parents(spark, sf_dir):
    return _shown(X.pack_context(hits(spark, sf_dir), B.parents(spark, sf_dir)))


@query("assemble_context", B.with_views("text_queries live_chunks", """SELECT query_id,
      sha256(string_agg(section, '' ORDER BY n)) AS context_hash,
      string_agg(chunk_id, ',' ORDER BY n) AS sources, sum(SECTION_TOKENS)::BIGINT AS context_tokens,
      max(used_chars)::BIGINT AS context_chars FROM packed GROUP BY query_id"""
    .replace("SECTION_TOKENS", sql_tokens("section")), **HYBRID, hits=HITS, packed=PACKED))
def assemble_context(spark, sf_dir):
    made = X.assemble_context(X.pack_context(hits(spark, sf_dir)))
    return made.select(
        "query_id", F.sha2("context", 256).alias("context_hash"),
        F.array_join("source_chunk_ids", ",").alias("sources"),
        F.col("context_tokens").cast("long"), F.col("context_chars").cast("long"))


@query("context_budget", """SELECT conv_id, turn, least(3000, greatest(0, 2000 - length(text) - 120))::INT
    AS budget FROM conversations""")
def context_budget(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.context_budget("text").alias("budget"))


@query("source_summary", B.with_views("text_queries live_chunks", """SELECT q.query_id,
      count(h.chunk_id) AS retrieved, count(DISTINCT h.document_id || '/' || h.chunk_id) AS sources,
      count(DISTINCT h.document_id) AS documents, count(h.chunk_id) > 0 AS answerable
    FROM text_queries q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY q.query_id""",
    **HYBRID, hits=HITS))
def source_summary(spark, sf_dir):
    return X.source_summary(B.text_queries(spark, sf_dir), hits(spark, sf_dir))


@query("answerability", B.with_views("text_queries live_chunks", """SELECT *, reason IS NULL AS answerable FROM (
    SELECT *, CASE WHEN hits = 0 THEN 'NO_HITS' WHEN budget <= 0 THEN 'NO_BUDGET'
      WHEN used = 0 THEN 'NOTHING_PACKED' END AS reason FROM (SELECT q.query_id, coalesce(h.n, 0) AS hits,
        coalesce(p.n, 0) AS used, least(3000, greatest(0, 400 - length(q.text) - 120))::INT AS budget
      FROM text_queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) h
        ON h.query_id = q.query_id LEFT JOIN (SELECT query_id, count(*) AS n FROM packed GROUP BY 1) p
        ON p.query_id = q.query_id))""",
    **HYBRID, hits=HITS, packed=PACKED))
def answerability(spark, sf_dir):
    found = hits(spark, sf_dir)
    return X.answerability(B.text_queries(spark, sf_dir), found, X.pack_context(found),
                           X.context_budget("text", max_input_chars=400))


@query("debug_chunks", B.with_views("text_queries live_chunks", """SELECT h.query_id, h.rank::INT AS rank, h.chunk_id,
      h.document_id, round(h.score, 9) AS score, p.chunk_id IS NOT NULL AS in_context,
      left(h.content, 100) AS preview FROM hits h LEFT JOIN packed p
      ON p.query_id = h.query_id AND p.chunk_id = h.chunk_id""", **HYBRID, hits=HITS, packed=PACKED))
def debug_chunks(spark, sf_dir):
    found = hits(spark, sf_dir)
    return X.debug_chunks(found, X.pack_context(found)).withColumn("score", F.round("score", 9))
