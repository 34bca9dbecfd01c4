"""SimHash near-duplicates by a hierarchical index in Gray order.

``with_fingerprint`` makes 64-bit fingerprints of word shingles. ``components`` links different
fingerprints that differ in at most ``max_bits`` bits and gives each fingerprint its connected group.

Search. Two fingerprints within d bits agree on at least one of d + 1 blocks of bits, so every
fingerprint goes to one bucket per block; the block is the pattern all of a bucket shares. Inside a
bucket fingerprints are sorted by Gray rank, where neighbours share most bits; runs of them become
leaves, runs of leaves inner nodes, and a node keeps the bits that all below it share (a mask and its
values), less those its parent has. A search adds up differences from the root down and leaves a
whole group once they exceed d, or once the group is known to be linked with the searcher. A bucket
of more than ``MOST`` fingerprints is dealt out again by blocks of its other bits, which loses no
pair. A task sends on a spanning forest of its links, not the links: at most one row per fingerprint.

Exact copies share a fingerprint and are one node. Groups over buckets are joined by star
contraction, each round stored in the shared folder.

Defined cases: a null or empty text, or one without words, has the fingerprint zero, which is linked
like any other. Fewer words than a shingle: the whole sequence is the shingle. Repeated rows belong
to one group; a null doc_id is never the smallest, and a group without any doc_id has the id null.
An empty table gives no rows. New columns must not clash with those there (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import filled, free_name, map_batches
from quarry.session import cut

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of a bucket that one task takes.
MOST = 1 << 17
#: Times a too large bucket is dealt out again; each time fixes a fifth of its open bits.
DEPTH = 4
FAN = 16
#: Searchers that go down the index together.
CHUNK = 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text in UTF-8: a bit is 1 if over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # of bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = min(shingle, len(words))
    begins, ends = (ends - sizes)[:len(words) - n + 1], ends[n - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), 1 << 15):
        hashes = [xxh64_intdigest(joined[a:b], seed)
                  for a, b in zip(begins[at:at + (1 << 15)].tolist(), ends[at:at + (1 << 15)].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint",
                     shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint (long, the 64 bits as signed) to every row."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} is there already")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), shingle) for x in filled(batch.column(place)).cast(pa.large_binary())],
                            np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [*batch.schema.names, out])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def submasks(mask: int, parts: int) -> list[int]:
    """``mask`` and one of ``parts`` even groups of the other bits each."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[low:high]) for low, high in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order under nodes of shared bits."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes))
        self.codes = codes[self.order]
        every, some = self.codes, self.codes
        self.masks, self.patterns = [np.full(len(codes), ALL)], [self.codes]
        while len(every) > FAN:
            edges = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, edges), np.bitwise_or.reduceat(some, edges)
            shared = ~(every ^ some)
            self.masks.append(shared)
            self.patterns.append(every & shared)

    def one_group(self, labels: np.ndarray) -> list[np.ndarray]:
        """For every node the label of all codes below it, -1 if they differ."""
        low = high = labels
        out = [labels]
        for level in self.masks[1:]:
            edges = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)
            out.append(np.where(low == high, low, -1))
        return out

    def links(self, first: int, last: int, max_bits: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a code in [first, last) and a later one within ``max_bits``, save those in one group."""
        groups = self.one_group(labels)
        top = len(self.masks) - 1
        who = np.repeat(np.arange(first, last), len(self.masks[top]))
        node = np.tile(np.arange(len(self.masks[top])), last - first)
        sums = np.zeros(len(who), np.int64)
        above = np.zeros(len(self.masks[top]), np.uint64)[node]
        for level in range(top, -1, -1):
            width = FAN ** level
            open_ = ((node + 1) * width > who + 1) & (groups[level][node] != labels[who])
            who, node, sums, above = who[open_], node[open_], sums[open_], above[open_]
            mask, pattern = self.masks[level][node], self.patterns[level][node]
            sums = sums + np.bitwise_count((self.codes[who] ^ pattern) & mask & ~above)
            near = sums <= max_bits
            who, node, sums, above = who[near], node[near], sums[near], mask[near]
            if level:
                n_below = len(self.masks[level - 1])
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                who, sums, above = (np.repeat(x, FAN) for x in (who, sums, above))
                real = child < n_below
                who, node, sums, above = who[real], child[real], sums[real], above[real]
        return who, node


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the place of the group's first code."""
    while len(a):
        of_a, of_b = labels[a], labels[b]
        apart = of_a != of_b
        if not apart.any():
            break
        a, b, of_a, of_b = a[apart], b[apart], of_a[apart], of_b[apart]
        least = np.minimum(of_a, of_b)
        np.minimum.at(labels, of_a, least)
        np.minimum.at(labels, of_b, least)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
    return labels


def forest(codes: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A star per group of linked codes: codes and the code of their group's centre."""
    if len(codes) < 2:
        return codes[:0], codes[:0]
    if len(codes) <= 64:
        a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= max_bits)
        labels = unite(np.arange(len(codes)), a[a < b], b[a < b])
    else:
        index = GrayIndex(codes)
        codes, labels = index.codes, np.arange(len(codes))
        for first in range(0, len(codes), CHUNK):
            labels = unite(labels, *index.links(first, min(first + CHUNK, len(codes)), max_bits, labels))
    linked = labels != np.arange(len(codes))
    return codes[linked], codes[labels[linked]]


def _bucketed(codes: DataFrame, max_bits: int) -> DataFrame:
    """fp, mask, bits: every fingerprint in the buckets where its links can be found."""
    parts = max_bits + 1
    masks = submasks(0, parts)
    rows = codes.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    for _ in range(DEPTH):
        large = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).drop("n")
        if large.isEmpty():
            break
        large = cut(large, "simhash-large")
        small = rows.join(large, ["mask", "bits"], "left_anti").select("fp", "mask", "bits")
        done = small if done is None else done.unionByName(small)
        # (mask, finer masks): as many rows as there are masks, whatever the data
        finer = codes.sparkSession.createDataFrame(
            [(signed(m), [signed(x) for x in submasks(m, parts)]) for m in masks], "mask long, finer array<long>")
        rows = (rows.join(large, ["mask", "bits"], "left_semi").join(F.broadcast(finer), "mask")
                .select("fp", F.explode("finer").alias("mask"))
                .withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))))
        masks = [x for m in masks for x in submasks(m, parts)]
    return rows if done is None else done.unionByName(rows)


def near_links(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links whose connected groups are those of all pairs of ``codes.fp`` (distinct, long)
    within ``max_bits``; at most one row per fingerprint and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def linked(whole: list[np.ndarray]) -> pa.RecordBatch:
            fp, mask, bits = whole
            edges = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]), [True]]))
            many = np.flatnonzero(np.diff(edges) > 1)
            found = [forest(fp[edges[i]:edges[i + 1]].view(np.uint64), max_bits) for i in many.tolist()]
            sides = [np.concatenate([f[k] for f in found]).view(np.int64) if found else fp[:0] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            same = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1])) if len(rows[0]) else []
            last = int(same[-1]) + 1 if len(same) else 0
            if last:
                yield linked([r[:last] for r in rows])
            held = [r[last:] for r in rows]
        if len(held[0]):
            yield linked(held)

    dealt = _bucketed(codes, max_bits).repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return map_batches(dealt.select("fp", "mask", "bits"), run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected group of links (a, b), by star contraction.

    Each round links every node's larger neighbours to its smallest one, then every node and its
    smaller neighbours to the smallest of them, until nothing changes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a != b").distinct(), "simhash-links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a != b").distinct(), "simhash-large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
                    .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "simhash-small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS,
               shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = cut(with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle)
               .drop("text"), "simhash-rows")
    return rows.join(_named(rows, max_bits), "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(rows: DataFrame, max_bits: int) -> DataFrame:
    """fp, component_id for each different fingerprint of rows (fp, doc_id)."""
    codes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-codes")
    groups = connected(near_links(codes.select("fp"), max_bits))
    rooted = codes.join(groups, codes.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS,
             shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one of each group kept: that of the smallest key."""
    row, fp = free_name(docs.columns, "__row"), free_name(docs.columns, "__fp")
    stored = cut(with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), text, fp, shingle), "simhash-docs")
    rows = stored.select(F.col(row).alias("r"), F.col(fp).alias("fp"), F.col(key).alias("doc_id"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("r"))
    codes = cut(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-codes")
    groups = connected(near_links(codes.select("fp"), max_bits))
    rooted = codes.join(groups, codes.fp == groups.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.r").alias(row))
    return stored.join(kept, row, "left_semi").select(*docs.columns)
