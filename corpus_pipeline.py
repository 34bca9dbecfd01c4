"""The corpus pipeline: five operators of ``quarry.llm``, each over what the one before kept.

Every stage takes (spark, docs, sf_dir) and keeps the columns of ``documents``; the last gives one
row of encoding results per document. Stages add none of their columns to what they pass on, so
columns of the input may have any name besides. Empty tables pass through as empty tables; null and
empty texts are rejected by the first stage, which wants words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontaminate, quality_classifier, quality_rules, queries, simhash_similar
from quarry.llm.common import fold, free_name, read
from quarry.session import cut


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    kept = free_name(docs.columns, "__kept")
    order = quality_rules.cascade_order(quality_rules.estimate(docs))
    return quality_rules.cascade(docs, order, kept=kept).filter(F.col(kept)).select(*docs.columns)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It learns from the labelled documents of the
    whole table outside fold 1 of 3, not only from those that are left."""
    score = free_name(docs.columns, "__score")
    labels = read(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    model = quality_classifier.fit(read(spark, sf_dir, "documents"), labels)
    return quality_classifier.score(docs, model, out=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 in five-word shingles: that of the
    smallest doc_id. SimHash neighbours of the Gray index form groups; pairs between them that these miss are
    found by shared shingles, so no pair of that similarity is lost."""
    return simhash_similar.keep_one(docs, whole=True)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    tokenizer = byte_bpe.rank_tokenizer(byte_bpe.read_ranks(queries.vocabulary(queries.RANKS)))
    return queries.encoded_digests(docs.select("doc_id", "text"), tokenizer)


STAGES = [("quality rules", keep_by_rules), ("quality classifier", keep_by_classifier),
          ("simhash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_benchmark_leaks),
          ("byte-level bpe", encode)]

#: Neither the classifier, SimHash nor BPE can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
