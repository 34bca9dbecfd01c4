"""Exact duplicates by two passes over Bloom filters, with DataFrame functions only.

The first pass reads the texts once and stores a digest per row. From the digests a Bloom filter of
64-bit words is filled: a digest has a word and four bits of it. Bits that two rows set, or one
digest twice, are found word by word; a digest whose four bits all are such may be repeated and goes
into the second filter. The second pass probes that filter, which is broadcast: rows that it does not
hold are unique and pass straight through, and only the others are shuffled, by their digest, and
grouped exactly. A false positive is shuffled for nothing; a repeated row is never missed.

The first filter has ``BITS_PER_ROW`` bits a row at any size and is never gathered: it is grouped by
word. The second is folded to at most ``FILTER_WORDS`` words (32 MB) before it is broadcast, so for
very many repeated texts it passes more rows than it must, with the same result.

Texts are equal when identical after lower-casing A-Z only; equality is that of their sha256.

Defined cases: null and empty texts are equal. Of equal texts the row with the largest key stays; a
null key is the smallest. Rows that share key and text are one document: they are marked alike, and
``keep_last`` returns one of them, the first by its unnormalised text. Empty tables give empty
results. ``mark`` returns its own columns and the key only; ``keep_last`` returns the input's columns,
whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name
from quarry.session import cut

BITS_PER_ROW = 16
#: 64-bit words of the second filter at most, and of one broadcast row of it.
FILTER_WORDS, BLOCK = 1 << 22, 64
#: Groups with more than this share of all rows are broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 1024


def digest(text: Column) -> Column:
    """sha256 of a text with A-Z lower-cased, in hex; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() does the same, and faster, where every character is one byte
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.sha2(lowered, 256)


def _place(code: Column, words: int) -> tuple[Column, Column]:
    """Word (of ``words``) and bits of a digest."""
    spread = F.xxhash64(code, F.lit(1))
    one = F.lit(1).cast("long")
    bits = F.lit(0).cast("long")
    for k in range(4):
        at = F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", one, at))
    return F.pmod(F.xxhash64(code), F.lit(words).cast("long")), bits


def second_filter(codes: DataFrame, code: str, rows: int, most: int = FILTER_WORDS) -> tuple[DataFrame, int]:
    """The filter of digests that may be repeated, as rows (block, bits: 64 words), and its words.

    ``rows`` is the number of rows of ``codes``; it sets the size of the first filter.
    """
    words = 1 << max(6, math.ceil(math.log2(max(rows, 1) * BITS_PER_ROW / 64)))
    word, bits = _place(F.col(code), words)
    # equal digests meet here, counted on the map side first, so a hot one is one row a task
    placed = codes.select(word.alias("word"), bits.alias("bits")).groupBy("word", "bits").agg(F.count(F.lit(1)).alias("n"))
    seen = placed.groupBy("word").agg(F.collect_list(F.struct("bits", "n")).alias("all"))
    zero = F.lit(0).cast("long")
    both = F.aggregate(
        "all", F.struct(zero.alias("once"), zero.alias("again")),
        lambda had, row: F.struct(
            had["once"].bitwiseOR(row["bits"]).alias("once"),
            had["again"].bitwiseOR(F.when(row["n"] > 1, row["bits"]).otherwise(had["once"].bitwiseAND(row["bits"])))
            .alias("again")))
    maybe = (seen.select("word", "all", both["again"].alias("again"))
             .select("word", F.explode(F.filter("all", lambda row: row["bits"].bitwiseAND(F.col("again")) == row["bits"])["bits"]).alias("bits")))
    folded = min(words, most)
    second = (maybe.groupBy(F.pmod("word", F.lit(folded).cast("long")).alias("word")).agg(F.bit_or("bits").alias("bits"))
              .groupBy(F.floor(F.col("word") / BLOCK).alias("block"))
              .agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(BLOCK).cast("long")).cast("int").alias("slot"), "bits"))).alias("set")))
    slots = F.sequence(F.lit(0), F.lit(BLOCK - 1))
    second = second.select("block", F.transform(slots, lambda i: F.coalesce(F.try_element_at("set", i), zero)).alias("bits"))
    return cut(second, "bloom-second"), folded


def maybe_repeated(rows: DataFrame, code: str, second: tuple[DataFrame, int], out: str) -> DataFrame:
    """``rows`` with ``out``: whether the second filter holds their digest. No shuffle."""
    blocks, words = second
    names = [free_name([*rows.columns, out], f"__{n}") for n in ("block", "bits")]
    word, bits = _place(F.col(code), words)
    found = F.get(F.col(names[1]), F.pmod(word, F.lit(BLOCK).cast("long")).cast("int")).bitwiseAND(bits) == bits
    # at most FILTER_WORDS / BLOCK rows of 64 words
    probed = rows.withColumn(names[0], F.floor(word / BLOCK)).join(
        F.broadcast(blocks.toDF(*names)), names[0], "left")
    return probed.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(out))


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    return cut(docs.select(F.col(key).alias("key"), digest(F.col(text)).alias("code")), "digests")


def _groups(maybe: DataFrame) -> DataFrame:
    return maybe.groupBy("code").agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("size"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = FILTER_WORDS) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row."""
    codes = _digests(docs, key, text)
    rows = codes.count()
    probed = maybe_repeated(codes, "code", second_filter(codes, "code", rows, most), "maybe")
    maybe = probed.filter("maybe").drop("maybe")
    groups = cut(_groups(maybe), "groups")
    hot = F.broadcast(groups.filter(F.col("size") > F.lit(rows * HOT_SHARE)))
    grouped = (maybe.join(hot, "code").unionByName(
        maybe.join(hot, "code", "left_anti").join(groups, "code")))
    once = probed.filter(~F.col("maybe")).select("code", "key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("size"))
    return once.unionByName(grouped).select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("key").eqNullSafe(F.col("keep")).alias("kept"), F.col("code").alias("text_sha256"))


def keep_last(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = FILTER_WORDS) -> DataFrame:
    """One row of each group of equal texts, that of the largest key, with all its columns. Rows that
    cannot be repeated are neither shuffled nor sorted."""
    code, flag, keep, rank = (free_name(docs.columns, f"__{n}") for n in ("code", "maybe", "keep", "rank"))
    codes = _digests(docs, key, text)
    second = second_filter(codes, "code", codes.count(), most)
    winners = _groups(maybe_repeated(codes, "code", second, "maybe").filter("maybe"))
    winners = winners.select(F.col("code").alias(code), F.col("keep").alias(keep))
    probed = maybe_repeated(docs.withColumn(code, digest(F.col(text))), code, second, flag)
    # the key is part of the join, so the rows of a hot text lie apart
    best = probed.filter(flag).join(winners, [probed[code] == winners[code], probed[key].eqNullSafe(winners[keep])], "left_semi")
    window = Window.partitionBy(code, key).orderBy(text)
    best = best.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1)
    return probed.filter(~F.col(flag)).select(*docs.columns).unionByName(best.select(*docs.columns))
