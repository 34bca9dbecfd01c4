"""One query per operator over its whole table, and its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (byte_bpe, chat_format, decontaminate, exact_dedup, fill_in_middle, language_id, lm_scoring,
                        quality_classifier, quality_rules, simhash_dedup, spelling, sql, token_output, url_filter)
from quarry.llm.common import fold, read
from quarry.session import work_path

#: Vocabulary files, by name in the folder of public tokenizers.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 1 of 5."""
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 1
    model, counts = lm_scoring.learn(docs.filter(~held_out))
    scored = lm_scoring.score(docs, model, counts, [F.col("doc_id"), held_out])
    return scored.withColumnsRenamed({"c0": "doc_id", "c1": "held_out"})


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Simple-8b blocks in files, read back."""
    with open(vocabulary(TOKENIZER), encoding="utf-8") as file:
        tokenizer = file.read()
    path = work_path(spark, "token-blocks")
    token_output.write(read(spark, sf_dir, "documents"), tokenizer, path)
    return token_output.read_documents(spark, path, "ids_crc32 long", token_output.ids_crc32)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the rules over all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    order = quality_rules.cascade_order(quality_rules.estimate(docs))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_rules.cascade(docs, order, counts=counts).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *counts, failed.alias("base_failed"), "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_format.render(*chat_format.collapse(read(spark, sf_dir, "conversations")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by a rank file, decoded again, as digests."""
    tokenizer = byte_bpe.rank_tokenizer(byte_bpe.read_ranks(vocabulary(RANKS)))
    return encoded_digests(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(docs, tokenizer).drop("text"), tokenizer)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside fold 1 of 3."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    held_out = fold("doc_id", 3) == 1
    model = quality_classifier.fit(docs, labels.filter(~held_out))
    return quality_classifier.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash_dedup.components(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside fold 2 of 4."""
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    dictionaries = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    return decontaminate.pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: One word of a text in so many loses a letter, see ``spelling.word_counts``.
SLIP = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(read(spark, sf_dir, "documents"), slip=SLIP)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays."""
    return exact_dedup.mark(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut by lines and put back together, as digests."""
    made = fill_in_middle.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = fill_in_middle.restore(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(whole, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_token_output, op3_url_filter, op4_quality_rules, op5_chat_format,
                            op6_byte_bpe, op7_quality_classifier, op8_simhash_dedup, op9_language_id,
                            op10_decontaminate, op11_spelling_variants, op12_exact_dedup, op13_fill_in_middle)}
SQL: dict[str, str] = dict(sql.TWINS)
