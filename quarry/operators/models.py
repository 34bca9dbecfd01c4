"""Operators around a pluggable model: a plain Python function called on Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import has_text, sha256_hex, strip
from quarry.session import bounded, cut

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Generator = Callable[[str], str | None]
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def embed_incremental(texts: DataFrame, cache: DataFrame, model: str, fn: Embedder,
                      text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with ``embedding``, rows to add to the cache).

    ``cache`` has model, text_hash, embedding. Each distinct text that the cache lacks goes to the
    model once: the new vectors are written to the work folder, which both results read. Copies of a
    text collapse before they are shuffled, and AQE splits the join back when one hash is hot.
    """
    @F.pandas_udf("array<double>")
    def embed(batch: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in fn(batch.tolist())])

    name = model if model and model.strip() else "default"
    known = cache.filter(F.col("model") == name).select("text_hash", "embedding")
    hashed = bounded(texts).withColumn("text_hash", sha256_hex(text))
    # a text as key is aggregated by hashing; as a value beside its hash all rows would be sorted
    distinct = texts.select(F.coalesce(text, F.lit("")).alias("__text")).distinct()
    missing = distinct.withColumn("text_hash", sha256_hex("__text")).join(known, "text_hash", "left_anti")
    made = missing.select("text_hash", embed("__text").alias("embedding"))
    added = cut(made, "vectors")
    table = known.unionByName(added)
    rows = added.select(F.lit(name).alias("model"), "text_hash", "embedding")
    return hashed.join(table, "text_hash"), rows


def generate_or_fallback(df: DataFrame, fn: Generator, prompt_col: str, out_col: str,
                         fallback_col: str | None = None) -> DataFrame:
    """Adds generated text; a blank or null prompt, an error or a blank answer gives the fallback
    column (null without one). Only the prompt column travels to Python."""
    @F.pandas_udf("string")
    def generate(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: _answer(fn, p))

    answer = F.when(has_text(prompt_col), strip(generate(F.col(prompt_col))))
    fallback = F.col(fallback_col) if fallback_col else F.lit(None).cast("string")
    with_answer = bounded(df).withColumn("__answer", answer)
    chosen = F.when(has_text("__answer"), F.col("__answer")).otherwise(fallback)
    return with_answer.withColumn(out_col, chosen).drop("__answer")


def _answer(fn: Generator, prompt: str | None) -> str | None:
    if prompt is None or not prompt.strip():
        return None
    try:
        return fn(prompt)
    except Exception:  # a failing model call degrades this row only
        return None


def score_pairs(pairs: DataFrame, fn: Scorer, query: str = "query", text: str = "content",
                out_col: str = "relevance", group: str | None = None) -> DataFrame:
    """Adds the relevance of each (query, text) pair; null where scoring failed.

    With ``group`` (a query's id, whose candidates are bounded) the scorer is called once per group
    and fails or answers for all of it, however rows are partitioned. Without it each pair is scored
    for itself when a whole Arrow batch fails.
    """
    if group is not None:
        def score_group(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.assign(**{out_col: _scores(fn, rows[query].tolist(), rows[text].tolist()).to_numpy()})

        schema = T.StructType([*pairs.schema.fields, T.StructField(out_col, T.DoubleType())])
        return pairs.groupBy(group).applyInPandas(score_group, schema)

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        found = _scores(fn, queries.tolist(), texts.tolist())
        if found.isna().all():
            one_by_one = [_scores(fn, [q], [t]) for q, t in zip(queries, texts)]
            found = pd.concat(one_by_one, ignore_index=True) if one_by_one else found
        return found

    return bounded(pairs).withColumn(out_col, score(F.col(query), F.col(text)))


def _scores(fn: Scorer, queries: list, texts: list) -> pd.Series:
    try:
        return pd.Series([None if x is None else float(x) for x in fn(queries, texts)], dtype="float64")
    except Exception:  # without a score the caller keeps its own order
        return pd.Series([None] * len(queries), dtype="float64")


def rewrite_gate(df: DataFrame, enabled: bool, conversation_enabled: bool,
                 question: str = "question", conversation_id: str = "conversation_id",
                 history: str = "history") -> DataFrame:
    """Adds ``rewrite``: NONE, SINGLE or CONVERSATIONAL."""
    on, talk = F.lit(enabled), F.lit(conversation_enabled)
    with_history = talk & has_text(conversation_id) & has_text(history)
    mode = (F.when(~on | ~has_text(question), F.lit("NONE"))
            .when(with_history, F.lit("CONVERSATIONAL")).otherwise(F.lit("SINGLE")))
    return df.withColumn("rewrite", mode)


def conversational_prompt(question: str, history: str, summary: str | None = None) -> Column:
    """Prompt for a rewrite that sees earlier turns."""
    head = F.lit("")
    if summary is not None:
        head = F.when(has_text(summary), F.concat(
            F.lit("对话历史摘要：\n"), F.col(summary), F.lit("\n\n"))).otherwise(F.lit(""))
    turns = F.when(has_text(history), F.concat(
        F.lit("最近对话：\n"), F.col(history), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, turns, F.lit("当前追问："), F.col(question))


def hash_embedder(dim: int = 64) -> Embedder:
    """Deterministic local embedder: every word adds a sign to one coordinate."""
    def embed(texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            vector = np.zeros(dim)
            for word in re.findall(r"\w+", (text or "").lower()):
                code = zlib.crc32(word.encode())
                vector[code % dim] += 1.0 if code & 0x10000 else -1.0
            out.append(vector)
        return out

    return embed


def overlap_scorer() -> Scorer:
    """Deterministic local scorer: share of the query's words that the text has."""
    def score(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        out = []
        for query, text in zip(queries, texts):
            words = set(re.findall(r"\w+", (query or "").lower()))
            found = set(re.findall(r"\w+", (text or "").lower()))
            out.append(len(words & found) / len(words) if words else 0.0)
        return out

    return score
