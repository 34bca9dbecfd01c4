"""Retrieval evaluation over batches of cases. A case's rows are its top-k results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import has_text, limit_text, normalize_list, strip
from quarry.operators.usage import latency_percentiles
from quarry.session import cut


def retrieval_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: hit, recall, mrr and the hit chunk ids in rank order.

    ``cases``: case_id, expected_chunk_ids, expected_document_ids; ``results``: case_id, rank,
    chunk_id, document_id, filename. Chunk ids are compared when a case names any, else documents by
    filename and then by id; a case without expectations scores zero.
    """
    wanted = cases.select("case_id", normalize_list("expected_chunk_ids").alias("chunks"),
                          normalize_list("expected_document_ids").alias("documents"))
    by_chunk = F.when(F.array_contains("chunks", F.col("chunk_id")), F.col("chunk_id"))
    by_document = (F.when(F.array_contains("documents", F.col("filename")), F.col("filename"))
                   .when(F.array_contains("documents", F.col("document_id")),
                         F.col("document_id")))
    strict = F.size("chunks") > 0
    token = F.when(strict, by_chunk).otherwise(by_document)
    expected = F.when(strict, F.size("chunks")).otherwise(F.size("documents"))
    matched = (wanted.join(results, "case_id", "left").withColumn("__token", token)
               .withColumn("__expected", expected))
    hit = F.col("__token").isNotNull()
    ids = F.array_sort(F.collect_list(F.when(
        hit & F.col("chunk_id").isNotNull(), F.struct("rank", "chunk_id"))))
    per_case = matched.groupBy("case_id", "__expected").agg(
        F.count_if(hit).alias("__hits"), F.countDistinct("__token").alias("__distinct"),
        F.min(F.when(hit, F.col("rank"))).alias("__first"), ids.alias("__ids"))
    recall = F.when(F.col("__expected") > 0, F.col("__distinct") / F.col("__expected"))
    return per_case.select(
        "case_id", (F.col("__hits") > 0).alias("hit"),
        F.coalesce(recall, F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("__first"), F.lit(0.0)).alias("mrr"),
        F.transform("__ids", lambda s: s["chunk_id"]).alias("hit_chunk_ids"))


def eval_summary(case_metrics: DataFrame) -> DataFrame:
    """One row: case count, mean hit, recall, mrr and latency, token sums; zeros when empty.

    ``case_metrics``: hit, recall, mrr, latency_ms, prompt_tokens, completion_tokens, total_tokens.
    """
    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)

    return case_metrics.agg(
        F.count(F.lit(1)).alias("cases"), mean(F.col("hit").cast("double")).alias("hit_rate"),
        mean("recall").alias("recall"), mean("mrr").alias("mrr"),
        mean("latency_ms").alias("avg_latency_ms"),
        total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


def relevance_at_k(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: share of returned rows whose ``key`` is expected, and whether any is.

    ``cases``: case_id, expected_keys; ``results``: case_id, key.
    """
    found = F.coalesce(F.array_contains("expected_keys", F.col("key")), F.lit(False))
    joined = cases.select("case_id", "expected_keys").join(results, "case_id", "left")
    rows = F.count("key")
    return joined.withColumn("__found", found).groupBy("case_id").agg(
        F.count_if("__found").alias("relevant"), rows.alias("returned"),
        F.when(rows > 0, F.count_if("__found") / rows).otherwise(0.0).alias("relevance"),
        F.bool_or("__found").alias("doc_hit"))


def phrase_match(answer: Column | str, expected: Column | str) -> Column:
    """Does the answer hold the expected text, or one of its phrases of two or more characters?"""
    a = F.col(answer) if isinstance(answer, str) else answer
    e = F.col(expected) if isinstance(expected, str) else expected
    phrases = F.filter(F.transform(F.split(e, "[,，。；;、\\s]+"), strip),
                       lambda p: F.length(p) >= 2)
    lowered = F.lower(a)
    any_phrase = F.exists(phrases, lambda p: lowered.contains(F.lower(p)))
    return (F.when(~has_text(e), F.lit(True)).when(~has_text(a), F.lit(False))
            .otherwise(a.contains(e) | any_phrase))


def sources_cover_expected(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Per case: is every expected document among the cited ids or filenames?"""
    cited = sources.groupBy("case_id").agg(
        F.collect_set("document_id").alias("__ids"), F.collect_set("filename").alias("__names"))
    empty = F.array().cast("array<string>")
    seen = F.concat(F.coalesce("__ids", empty), F.coalesce("__names", empty))
    wanted = normalize_list("expected_document_ids")
    return (cases.select("case_id", wanted.alias("__wanted")).join(cited, "case_id", "left")
            .withColumn("__seen", seen)
            .select("case_id", (F.size(F.array_except("__wanted", "__seen")) == 0)
                    .alias("covered")))


def compare_modes(per_question: DataFrame) -> DataFrame:
    """Per mode: hit rate, mean relevance, phrase rate, hits, questions and latency percentiles.

    ``per_question``: mode, doc_hit, relevance, phrase_hit, retrieval_ms, total_ms. It is written
    once, as the rates and each percentile read it.
    """
    per_question = cut(per_question, "per-question")
    rates = per_question.groupBy("mode").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("doc_hit").alias("hits"),
        F.avg(F.col("doc_hit").cast("double")).alias("hit_rate"),
        F.avg("relevance").alias("relevance"),
        F.avg(F.col("phrase_hit").cast("double")).alias("phrase_rate"))
    retrieval = latency_percentiles(per_question, ["mode"], "retrieval_ms",
                                    {"retrieval_p50": 0.5}).drop("n", "avg")
    total = latency_percentiles(per_question, ["mode"], "total_ms",
                                {"total_p50": 0.5, "total_p95": 0.95}).drop("n", "avg")
    return rates.join(retrieval, "mode").join(total, "mode")


def paired_lift(base: DataFrame, treatment: DataFrame) -> DataFrame:
    """One row: hit rates of the same cases under two treatments, and their difference."""
    joined = base.select("case_id", F.col("hit").alias("__base")).join(
        treatment.select("case_id", F.col("hit").alias("__treated")), "case_id")
    rate = {c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
            for c in ("__base", "__treated")}
    return joined.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("__base").alias("base_hits"),
        F.count_if("__treated").alias("treated_hits"), rate["__base"].alias("base_rate"),
        rate["__treated"].alias("treated_rate"),
        (rate["__treated"] - rate["__base"]).alias("lift"))


def eval_errors(cases: DataFrame, metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """Every case once: its metrics, or zeros with the error code and a message of 300 characters.

    ``errors``: case_id, error_code, error_message.
    """
    failed = errors.select("case_id", "error_code",
                           limit_text("error_message", 300).alias("error_message"))
    joined = cases.select("case_id").join(failed, "case_id", "left").join(
        metrics.select("case_id", "hit", "recall", "mrr"), "case_id", "left")
    ok = F.col("error_code").isNull()
    return joined.select(
        "case_id", ok.alias("success"),
        F.coalesce(F.when(ok, F.col("hit")), F.lit(False)).alias("hit"),
        F.coalesce(F.when(ok, F.col("recall")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.when(ok, F.col("mrr")), F.lit(0.0)).alias("mrr"),
        "error_code", "error_message")
