"""Benchmark items inside documents, by a size-partitioned MinHash containment search.

An item is found in a document that holds at least ``CONTAINMENT`` of its word shingles. Items are
partitioned by their number of shingles, from u/2 to u. Of n shingles at most n - ceil(t n) may be
missing, so a document that holds the item holds one of any n - ceil(t n) + 1 of them; each partition
indexes the smallest hashes of its items, as many as its largest size u asks for. Documents, however
long, are looked up shingle by shingle, so a short item in a long text is not lost, and no item is.
Candidates are then verified: the shingles themselves, as text, are counted.

Words are runs of letters and digits of the lower-cased text. An item of fewer words than a shingle
is one shingle of all its words. Only DataFrame functions are used.

Defined cases: a null or empty document or item, or one without words, matches nothing. Repeated
rows (same key and text) give a pair once; rows that share a key and differ in text are told apart,
and their pairs merged by the greatest number found. Null keys are kept as such. Empty tables give no
pairs. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name
from quarry.session import cut

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows of an item table that are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _windows(words: str, size: int, make: Callable[[Column], Column], kind: str) -> Column:
    """``make(i)`` for every place i (from 0) where ``size`` words begin."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), make)).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_hashes(hashes: str, size: int) -> Column:
    """Hashes of all windows of ``size`` words, from the words' hashes."""
    return _windows(hashes, size, lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(size))), "bigint")


def shingle_texts(words: str, size: int) -> Column:
    return _windows(words, size, lambda i: F.concat_ws(" ", *(F.get(F.col(words), i + k) for k in range(size))), "string")


def _sizes(size: Column, shingle: int) -> Column:
    """Words of an item's shingles."""
    return F.least(size, F.lit(shingle))


def item_index(items: DataFrame, key: str = "item_id", text: str = "text", shingle: int = SHINGLE,
               containment: float = CONTAINMENT) -> DataFrame:
    """item, item_id, words, size (of a shingle), n (different shingles), signature (array of hashes)."""
    rows = items.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    rows = rows.distinct().withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    size = _sizes(F.size("words"), shingle)
    at = F.lit(None).cast("array<bigint>")
    texts = F.lit(None).cast("array<string>")
    for k in range(1, shingle + 1):
        at = F.when(size == k, F.array_distinct(shingle_hashes("hashes", k))).otherwise(at)
        texts = F.when(size == k, F.array_distinct(shingle_texts("words", k))).otherwise(texts)
    rows = rows.select(F.xxhash64("item_id", "words").alias("item"), "item_id", size.alias("size"),
                       at.alias("hashes"), texts.alias("shingles")).withColumn("n", F.size("shingles"))
    # the partition's largest size: one below the next power of two
    upper = F.pow(F.lit(2), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    smallest = (upper - F.ceil(upper * containment - 1e-9) + 1).cast("int")
    return rows.withColumn("signature", F.slice(F.array_sort("hashes"), 1, smallest))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
              item_key: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
              containment: float = CONTAINMENT) -> DataFrame:
    """doc (key and hash of the text), doc_id, item_id, n_shingles, n_found of every verified pair."""
    index = cut(item_index(items, item_key, item_text, shingle, containment), "leak-items")
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # 1 to shingle
    rows = docs.select(F.struct(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h")).alias("doc"),
                       F.col(text).alias("text"))

    # candidates: any of an item's smallest hashes
    signatures = index.select("item", F.explode("signature").alias("hash"))
    hashed = rows.select("doc", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    windows = F.concat(*(shingle_hashes("hashes", k) for k in sizes)) if sizes else F.array().cast("array<bigint>")
    met = hashed.select("doc", F.explode(windows).alias("hash")).join(_small(signatures), "hash")
    candidates = cut(met.select("doc", "item").distinct(), "leak-candidates")

    # verification over the texts of candidates
    read = rows.join(candidates.select("doc").distinct(), "doc", "left_semi").select("doc", words_of(F.col("text")).alias("words"))
    windows = F.concat(*(shingle_texts("words", k) for k in sizes)) if sizes else F.array().cast("array<string>")
    wanted = index.select("item", "item_id", "n", F.explode("shingles").alias("shingle"))
    found = (read.select("doc", F.explode(windows).alias("shingle")).join(_small(wanted), "shingle")
             .groupBy("doc", "item", "item_id", "n", "shingle").count()
             .groupBy("doc", "item", "item_id", "n").agg(F.count(F.lit(1)).alias("n_found")))
    return (found.join(candidates, ["doc", "item"], "left_semi")
            .filter(F.col("n_found") >= F.ceil(F.col("n") * containment - 1e-9))
            .select("doc", F.col("doc.doc_id").alias("doc_id"), "item_id",
                    F.col("n").cast("long").alias("n_shingles"), "n_found"))


def pairs(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found: one row per document and item."""
    best = F.max(F.struct("n_found", "n_shingles")).alias("b")
    return contained(docs, items, **options).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.n_shingles").alias("n_shingles"), F.col("b.n_found").alias("n_found"))


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    doc = free_name(docs.columns, "__doc")
    found = contained(docs, items, key=key, text=text, **options).select(F.col("doc").alias(doc)).distinct()
    marked = docs.withColumn(doc, F.struct(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h")))
    return marked.join(found, doc, "left_anti").select(*docs.columns)
