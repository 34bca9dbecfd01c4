"""Queries for operators around a model, with deterministic local functions in its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import models as M
from quarry.operators.history import history_at_turn
from quarry.plans import bindings as B
from quarry.plans.registry import query


@query("embed_incremental", """SELECT doc_id, sha256(text) AS text_hash, 32 AS dim FROM documents""")
def embed_incremental(spark, sf_dir):
    """Vectors of all documents, where the texts of every third are already in the cache."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    empty = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    _, first = M.embed_incremental(docs.filter("doc_id % 3 = 0"), empty, "hash-32",
                                   M.hash_embedder(32))
    rows, _ = M.embed_incremental(docs, first, "hash-32", M.hash_embedder(32))
    return rows.select("doc_id", "text_hash", F.size("embedding").alias("dim"))


@query("embed_incremental_new", """SELECT DISTINCT sha256(text) AS text_hash FROM documents
    WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)""")
def embed_incremental_new(spark, sf_dir):
    """Texts that still had to be embedded after every third document was."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    empty = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    _, first = M.embed_incremental(docs.filter("doc_id % 3 = 0"), empty, "hash-8",
                                   M.hash_embedder(8))
    _, added = M.embed_incremental(docs, first, "hash-8", M.hash_embedder(8))
    return added.select("text_hash")


def _first_words(prompt: str) -> str | None:
    """Stand-in for a rewriting model: the first four words, nothing for some, an error for others."""
    if len(prompt) % 5 == 0:
        return "  "
    if len(prompt) % 7 == 0:
        raise ValueError("model unavailable")
    return " ".join(prompt.split(" ")[:4])


@query("generate_or_fallback", """SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 OR length(text) % 7 = 0
    THEN text ELSE regexp_replace(array_to_string(string_split(text, ' ')[1:4], ' '),
      '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') END AS rewritten FROM conversations""")
def generate_or_fallback(spark, sf_dir):
    talk = B.table(spark, sf_dir, "conversations")
    return M.generate_or_fallback(talk, _first_words, "text", "rewritten", "text").select(
        "conv_id", "turn", "rewritten")


@query("rewrite_gate", """SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'NONE'
    WHEN turn > first THEN 'CONVERSATIONAL' ELSE 'SINGLE' END AS rewrite FROM (SELECT *,
      min(turn) FILTER (role <> 'system') OVER (PARTITION BY conv_id) AS first FROM conversations)""")
def rewrite_gate(spark, sf_dir):
    rows = history_at_turn(B.chat(spark, sf_dir), 20)
    gated = M.rewrite_gate(rows, True, True, question="content")
    return gated.select(F.col("conversation_id").cast("long").alias("conv_id"),
                        F.col("seq").alias("turn"), "rewrite")


@query("score_pairs", """SELECT d.doc_id, round((len(b.words) - len(list_filter(b.words, lambda w: NOT
      list_contains(d.words, w)))) / len(b.words)::DOUBLE, 6) AS relevance
    FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words FROM documents) d
    JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words FROM benchmark) b
      ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def score_pairs(spark, sf_dir):
    """Every document scored against one benchmark text."""
    n = B.table(spark, sf_dir, "benchmark").count()
    docs = B.table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % n)
    asked = B.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    pairs = docs.join(asked, "item_id").select("doc_id", "query", F.col("text").alias("content"))
    return M.score_pairs(pairs, _letters_overlap).select(
        "doc_id", F.round("relevance", 6).alias("relevance"))


def _letters_overlap(queries, texts):
    import re

    out = []
    for query_text, text in zip(queries, texts):
        words = set(re.findall("[a-z]+", query_text.lower()))
        out.append(len(words & set(re.findall("[a-z]+", text.lower()))) / len(words))
    return out
