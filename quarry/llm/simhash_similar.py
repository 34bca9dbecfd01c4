"""SimHash near-duplicates by shingle similarity: candidates from the Gray index, then an exact check.

``keep_one`` keeps one row of each group of texts that are linked by a Jaccard similarity of
``SIMILARITY`` or more between their sets of five-word shingles.

Candidates. The fingerprint has 256 bits, from four mixes of each shingle's hash. Texts of similarity
0.8 differ in about 15 of 100 bits, too many for the blocks of ``simhash_dedup``. So a fingerprint
goes to ``TABLES`` buckets, each named by ``BUCKET_BITS`` of its bits. Inside a bucket pairs within
``RADIUS`` of the first 128 bits are candidates; a bucket over ``SMALL`` fingerprints is searched by
``simhash_dedup.GrayIndex`` with growing radius, which leaves whole groups that are linked already.
A bucket sends on a spanning forest of nearest candidates, so at most one row per fingerprint.
A bucket over ``MOST`` fingerprints is dealt out ``DEALS`` times by ``DEAL_BITS`` further bits each.

Check. The two texts of every candidate are compared by their sets of shingles, all of them; links
below ``SIMILARITY`` go. A link that goes may have stood in a forest for others that hold. So the
fingerprints joined to it by candidates are searched again for pairs between groups that are still
apart. Of a bucket those texts go on that have such a pair whose sketches leave the similarity
possible; their sets are compared where they meet, and the bucket sends a forest of the links that
hold. A pair is never a row, so rows do not grow with the square of a group. Afterwards the groups
are those of all candidates. So no group is formed without such links, while a few links can be
missed: the search finds a pair with a probability that the tests and the README measure against
brute force.

Every link. With ``every_link`` no pair of the similarity is lost. The search by fingerprints forms
groups as above; then pairs between different groups are found by prefixes, without chance. All
shingles have one order, frequent ones last. Two sets of the similarity share one of the first
n - ceil(similarity * n) + 1 shingles of each, at places that leave room for the overlap they need.
Texts that meet so go into one block, where all pairs of different groups are compared, by sketches
and then by whole sets. A list of texts of a shingle sends a forest, a block sends a forest. A block
over ``MOST`` texts is not compared whole: its texts meet again by their shared shingles or by pairs
of its parts, whichever needs fewer rows. The order comes from a sample; it changes the time, not the
links. Here a node is a set of shingles, not only a fingerprint.

A sketch has one bit for each class of shingle keys: whether the set has an odd number of them. Two
sets differ in at least as many shingles as their sketches differ in bits, so it rejects no link.

Defined cases: A-Z are lower-cased; words are those of ``simhash_dedup``. Fewer words than a shingle:
the whole sequence is the shingle. Null, empty and wordless texts are equal to one another and form
one group. Texts of equal fingerprints are one node and belong together. Of a group the smallest key
stays, null keys last, of equal ones the first row. An empty table gives no rows. Columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Powers, filled, free_name, gather, map_batches, mix, slices, token_keys
from quarry.llm.simhash_dedup import GrayIndex, connected, signed, unite
from quarry.session import cut

SHINGLE = 5
SIMILARITY = 0.8
LANES = 4
TABLES = 40
BUCKET_BITS = 16
#: Bits of the first two lanes, and of the first alone, in which a candidate may differ.
RADIUS = 28
LANE_RADII = (6, 17)
#: Bits of a sketch for each shingle of a text, at least; their number is a power of two.
SKETCH_BITS = 2
#: Words of sketches, and shingles of pairs, that are compared at once.
COMPARED = 1 << 20
#: Fingerprints of a bucket that are compared all at once, and those that one task takes.
SMALL = 256
MOST = 1 << 12
#: A larger one is dealt out again this many times, each time by so many further bits.
DEALS, DEAL_BITS = 3, 6
DEPTH = 6
#: Fingerprints that are dealt to buckets at once.
NODES_AT_ONCE = 1 << 12
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15
#: Share of the texts, and texts at least, that the order of shingles is taken from; shingles that
#: count as frequent, at most, and the bits of their keys that are looked at.
ORDER_SHARE, ORDER_ROWS = 0.25, 1 << 14
FREQUENT = 1 << 19
ORDER_KEY = np.uint64((1 << 44) - 1)
#: Pairs of texts that are looked at at once.
PAIRS = 1 << 17
#: Parts of all shingle keys; a task holds the prefixes of one.
PARTS = 1 << 12
#: Links that one task joins into groups; more are joined by star contraction.
LOCAL_LINKS = 1 << 20
_LANE_STEPS = mix(np.arange(1, LANES + 1, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(texts: pa.Array, powers: Powers, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as 64-bit keys, and the number of the text of each; in
    order of texts and keys. A text without words has none."""
    tokens, _, sizes = token_keys(texts, powers)
    sizes = sizes - 1  # without the end mark
    n = np.minimum(sizes, shingle)
    counts = np.where(sizes > 0, sizes - n + 1, 0)
    home = np.repeat(np.arange(len(texts)), counts)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    at = np.arange(len(home)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[home]
    keys = np.zeros(len(home), np.uint64)
    for i in range(shingle):
        inside = i < n[home]
        keys[inside] = mix(keys[inside] * _STEP + tokens[at[inside] + i])
    order = np.lexsort((keys, home))
    keys, home = keys[order], home[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (home[1:] != home[:-1])
    return keys[new], home[new]


def fingerprints(texts: pa.Array, powers: Powers, shingle: int = SHINGLE) -> np.ndarray:
    """Four lanes of 64 bits for each text; a bit is 1 if over half of the shingles' mixes have it."""
    return lanes_of(*shingle_keys(texts, powers, shingle), len(texts))


def lanes_of(keys: np.ndarray, home: np.ndarray, n: int) -> np.ndarray:
    """The lanes of ``n`` texts from their different shingles."""
    out = np.zeros((n, LANES), np.uint64)
    total = np.bincount(home, minlength=n)
    for lane in range(LANES):
        ones = np.zeros((n, 64), np.int64)
        for low in range(0, len(keys), COUNTED):
            part, whose = keys[low:low + COUNTED], home[low:low + COUNTED]
            bits = np.unpackbits(mix(part ^ _LANE_STEPS[lane]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            edges = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
            ones[whose[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        out[:, lane] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def set_similarities(keys: np.ndarray, begins: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray
                     ) -> np.ndarray:
    """The Jaccard similarity of the sets ``keys[begin : begin + size]`` of each pair; 1 for two empty ones."""
    both_sides = np.concatenate([a, b])
    home = np.repeat(np.tile(np.arange(len(a)), 2), sizes[both_sides])
    shingles = gather(keys, begins[both_sides], sizes[both_sides])
    order = np.lexsort((shingles, home))
    shingles, home = shingles[order], home[order]
    twice = np.flatnonzero((shingles[1:] == shingles[:-1]) & (home[1:] == home[:-1]))
    both = np.bincount(home[twice], minlength=len(a))
    either = sizes[a] + sizes[b] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def shingle_sets(texts: pa.Array, powers: Powers, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of all texts end to end, and the number of each text."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in slices(texts):
        part, home = shingle_keys(texts.slice(low, high - low), powers, shingle)
        keys.append(part)
        sizes.append(np.bincount(home, minlength=high - low))
    return np.concatenate(keys), np.concatenate(sizes)


def similarities(left: pa.Array, right: pa.Array, powers: Powers, shingle: int = SHINGLE) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of each pair of texts; 1 for two without words."""
    (a, of_a), (b, of_b) = shingle_sets(left, powers, shingle), shingle_sets(right, powers, shingle)
    sizes, place = np.concatenate([of_a, of_b]), np.arange(len(left))
    return set_similarities(np.concatenate([a, b]), np.cumsum(sizes) - sizes, sizes, place, place + len(left))


def sketches(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of sets as 64-bit words end to end, and the number of words of each (a power of two)."""
    words = 1 << np.ceil(np.log2(np.maximum(sizes * SKETCH_BITS / 64, 1))).astype(np.int64)
    begins, home = np.cumsum(words) - words, np.repeat(np.arange(len(sizes)), sizes)
    flat = np.zeros(int(words.sum()), np.uint64)
    place = begins[home] + ((keys >> np.uint64(6)).astype(np.int64) & (words[home] - 1))
    np.bitwise_xor.at(flat, place, np.uint64(1) << (keys & np.uint64(63)))
    return flat, words


def can_be_alike(flat: np.ndarray, words: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray,
                 similarity: float) -> np.ndarray:
    """For each pair of sets, by their sketches: false if they are surely less alike than ``similarity``."""
    most = (sizes[a] + sizes[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6  # shingles they may differ in
    out = np.abs(sizes[a] - sizes[b]) <= most
    begins, least = np.cumsum(words) - words, np.minimum(words[a], words[b])

    def folded(i: np.ndarray, width: int) -> np.ndarray:
        row = flat[begins[i][:, None] + np.arange(width)]
        for fold in range(1, int(words[i].max()) // width):  # a longer sketch is folded onto the shorter
            more = words[i] > fold * width
            row[more] ^= flat[begins[i[more]][:, None] + fold * width + np.arange(width)]
        return row

    for width in np.unique(least[out]).tolist():
        here = np.flatnonzero(out & (least == width))
        for low in range(0, len(here), max(COMPARED // width, 1)):
            part = here[low:low + max(COMPARED // width, 1)]
            differ = np.bitwise_count(folded(a[part], width) ^ folded(b[part], width)).sum(1, dtype=np.int64)
            out[part] = differ <= most[part]
    return out


def nearest_forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray
                   ) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels after linking all pairs, and the pairs of a forest of nearest ones: each group takes
    the pair of fewest bits that leaves it, until none does."""
    order = np.argsort(bits, kind="stable")
    a, b, chosen = a[order], b[order], []
    while True:
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return labels, chosen
        sides = np.concatenate([labels[a], labels[b]])
        place = np.tile(np.arange(len(a)), 2)
        by = np.lexsort((place, sides))
        firsts = by[np.concatenate([[True], sides[by][1:] != sides[by][:-1]])]
        taken = np.unique(place[firsts])
        chosen.append(np.stack([a[taken], b[taken]], 1))
        labels = unite(labels, a[taken], b[taken])


def near_pairs(first: np.ndarray, second: np.ndarray, labels: np.ndarray, radii: tuple[int, ...]
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and bits of the pairs within ``RADIUS`` bits whose labels differ, in steps, for codes in
    two lanes. Of more than ``SMALL`` codes those of a smaller radius in the first lane come first, and
    pairs too far apart there are found by the second. Labels may be changed in place between steps."""
    if len(first) <= SMALL:
        bits = np.bitwise_count(first[:, None] ^ first) + np.bitwise_count(second[:, None] ^ second)
        a, b = np.nonzero(np.triu((bits <= RADIUS) & (labels[:, None] != labels), 1))
        yield a, b, bits[a, b]
        return
    by_first = [(first, radius, min(2 * radius, RADIUS), False) for radius in radii]
    for lane, radius, most, rest in [*by_first, (second, RADIUS - radii[-1] - 1, RADIUS, True)]:
        index, at, step = GrayIndex(lane), 0, 16
        while at < len(lane):
            a, b = index.links(at, min(at + step, len(lane)), radius, labels[index.order])
            at += step
            step = max(step // 2, 1) if len(a) > 1 << 19 else min(step * 2, 64)
            a, b = index.order[a], index.order[b]
            of_first = np.bitwise_count(first[a] ^ first[b])
            bits = of_first + np.bitwise_count(second[a] ^ second[b])
            near = (bits <= most) & (of_first > radii[-1]) if rest else bits <= most
            yield a[near], b[near], bits[near]


def candidates(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places (n, 2) of a forest of nearest pairs within ``RADIUS`` bits, for codes in two lanes."""
    labels, found = np.arange(len(first)), [np.zeros((0, 2), np.int64)]
    for a, b, bits in near_pairs(first, second, labels, LANE_RADII):
        labels[:], more = nearest_forest(labels, a, b, bits)
        found += more
    return np.concatenate(found)


def possible(first: np.ndarray, second: np.ndarray, groups: np.ndarray, flat: np.ndarray, words: np.ndarray,
             sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Places with a pair within ``RADIUS`` bits between different groups that can be alike by sketches."""
    labels, found = np.unique(groups, return_inverse=True)[1], np.zeros(len(first), bool)
    for a, b, _ in near_pairs(first, second, labels, LANE_RADII[-1:]):
        can = can_be_alike(flat, words, sizes, a, b, similarity)
        found[a[can]] = found[b[can]] = True
    return np.flatnonzero(found)


def held(first: np.ndarray, second: np.ndarray, groups: np.ndarray, keys: np.ndarray, sizes: np.ndarray,
         similarity: float) -> np.ndarray:
    """Places (n, 2) of a forest of the pairs within ``RADIUS`` bits between different groups whose
    sets of shingles have the similarity."""
    _, firsts, of = np.unique(groups, return_index=True, return_inverse=True)
    labels = firsts[of]
    return _held(near_pairs(first, second, labels, LANE_RADII[-1:]), labels, keys, sizes, similarity)


def _held(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, keys: np.ndarray,
          sizes: np.ndarray, similarity: float) -> np.ndarray:
    """A forest of the ``pairs`` (places and bits) that have the similarity; ``labels`` are joined in place."""
    flat, words = sketches(keys, sizes)
    begins, found = np.cumsum(sizes) - sizes, [np.zeros((0, 2), np.int64)]
    for a, b, bits in pairs:
        can = np.flatnonzero(can_be_alike(flat, words, sizes, a, b, similarity))
        left = can[np.argsort(bits[can], kind="stable")]
        while len(left):
            now = left[:max(1, int(np.searchsorted(np.cumsum(sizes[a[left]] + sizes[b[left]]), COMPARED)))]
            alike = now[set_similarities(keys, begins, sizes, a[now], b[now]) >= similarity]
            labels[:], more = nearest_forest(labels, a[alike], b[alike], bits[alike])
            found += more
            left = left[len(now):]
            left = left[labels[a[left]] != labels[b[left]]]
    return np.concatenate(found)


def _bucket_bits(tables: int, bits: int, of: int, seed: int) -> np.ndarray:
    """``tables`` drawings of ``bits`` different places out of ``of``."""
    draw = np.random.default_rng(seed)
    return np.stack([draw.permutation(of)[:bits] for _ in range(tables)])


def _bucketed(nodes: DataFrame, *more: str) -> DataFrame:
    """bucket, node, f0, f1 and the columns ``more``: every node in the buckets where its candidates are."""
    drawn = _bucket_bits(TABLES, BUCKET_BITS, 64 * LANES, 1)
    worth = 1 << np.arange(BUCKET_BITS, dtype=np.int64)
    names = ["node", "f0", "f1", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, NODES_AT_ONCE):
                part = batch.slice(at, NODES_AT_ONCE)
                lanes = [part.column(i).to_numpy(zero_copy_only=False) for i in range(LANES)]
                bits = np.unpackbits(np.stack(lanes, 1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
                bucket = np.concatenate([bits[:, p] @ worth + (t << BUCKET_BITS) for t, p in enumerate(drawn)])
                each = pa.array(np.tile(np.arange(part.num_rows), TABLES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), *(part.column(part.schema.get_field_index(n)).take(each) for n in names)],
                    ["bucket", *names])

    lanes = [f"f{i}" for i in range(LANES)]
    schema = T.StructType([T.StructField("bucket", T.LongType()), *(nodes.schema[n] for n in names)])
    rows = map_batches(nodes.select(*lanes, "node", *more), run, schema)
    done = None
    for depth in range(DEPTH):
        large = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).drop("n"),
                    "similar-large")
        if large.isEmpty():
            break
        small = rows.join(large, "bucket", "left_anti")
        done = small if done is None else done.unionByName(small)
        masks = [signed(int(np.bitwise_or.reduce(np.uint64(1) << p.astype(np.uint64))))
                 for p in _bucket_bits(DEALS, DEAL_BITS, 64, 2 + depth)]
        rows = (cut(rows.join(large, "bucket", "left_semi"), "similar-dealt")
                .withColumn("mask", F.explode(F.array(*(F.lit(m) for m in masks))))
                .select(F.xxhash64("bucket", "mask", F.col("f0").bitwiseAND(F.col("mask"))).alias("bucket"), *names))
    return rows if done is None else done.unionByName(rows)


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[tuple[pa.Table, list[slice]]]:
    """Tables with all rows of their buckets, and where those of ``least`` rows or more stand; batches
    begin with the bucket and come in its order."""
    def table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[slice]]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        bucket = rows.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        return rows, [slice(edges[i], edges[i + 1]) for i in np.flatnonzero(np.diff(edges) >= least).tolist()]

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        if kept and kept[0].column(0)[0].as_py() != bucket[0]:
            yield table(kept)
            kept = []
        last = int(np.searchsorted(bucket, bucket[-1]))
        if last:
            yield table([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield table(kept)


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _lanes(rows: pa.Table, part: slice) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(n).to_numpy()[part].view(np.uint64) for n in ("f0", "f1"))


def _links(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])


def near_candidates(nodes: DataFrame) -> DataFrame:
    """a, b: candidate links between ``nodes`` (node, f0 to f3), each once: a forest of those of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in whole_buckets(batches):
            node = rows.column("node").to_numpy()
            yield _links([node[p][candidates(*_lanes(rows, p))] for p in parts])

    return map_batches(_in_buckets(_bucketed(nodes)), run, "a long, b long").distinct()


def crossing_links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE
                   ) -> DataFrame:
    """a, b: links between the groups of ``nodes`` (node, f0 to f3, group) that join what all pairs of
    a bucket join that lie in two groups and have the similarity; a forest of each bucket."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys, sizes = shingle_sets(filled(batch.column(1)).cast(pa.large_string()), powers, shingle)
            flat, words = sketches(keys, sizes)
            made = [x.astype("<u8").tobytes() for x in np.split(flat, np.cumsum(words))[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())],
                                             ["node", "size", "sketch"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in whole_buckets(batches):
            node, group, sizes = (rows.column(n).to_numpy() for n in ("node", "group", "size"))
            chosen = [np.zeros(0, np.int64)]
            for p in parts:
                made = rows.column("sketch")[p].to_pylist()
                flat, words = np.frombuffer(b"".join(made), "<u8"), np.array([len(x) // 8 for x in made])
                chosen.append(p.start + possible(*_lanes(rows, p), group[p], flat, words, sizes[p], similarity))
            at = np.concatenate(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("bucket").to_numpy()[at]), pa.array(node[at])],
                                             ["bucket", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, parts in whole_buckets(batches):
            node, group = (rows.column(n).to_numpy() for n in ("node", "group"))
            found = []
            for p in parts:
                sets = shingle_sets(filled(rows.column("text")[p]).cast(pa.large_string()), powers, shingle)
                found.append(node[p][held(*_lanes(rows, p), group[p], *sets, similarity)])
            yield _links(found)

    wanted = texts.join(nodes.select("node"), "node", "left_semi").select("node", "text")
    made = map_batches(wanted, sketch, "node long, size long, sketch binary")
    rows = _bucketed(cut(nodes.join(made, "node"), "similar-sketches"), "group", "size", "sketch")
    met = cut(map_batches(_in_buckets(rows), choose, "bucket long, node long"), "similar-met")
    full = met.join(nodes.select("node", "f0", "f1", "group"), "node").join(wanted, "node")
    return map_batches(_in_buckets(full.select("bucket", "node", "f0", "f1", "group", "text")), compare,
                       "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose ``texts`` (node, text) have at least the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            left, right = (filled(batch.column(i)).cast(pa.large_string()) for i in (2, 3))
            alike = similarities(left, right, powers, shingle) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(alike)) for i in (0, 1)], ["a", "b"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b"))
    return map_batches(both.select("a", "b", "left", "right"), run, "a long, b long")


def all_links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """a, b: links whose groups are those of all candidates of ``nodes`` (node, f0 to f3) that have the similarity."""
    tried = cut(near_candidates(nodes.withColumn("group", F.col("node"))), "similar-candidates")
    links = cut(confirmed(tried, texts, similarity, shingle), "similar-confirmed")
    failed = tried.join(links, ["a", "b"], "left_anti")
    if failed.isEmpty():
        return links
    # a pair hidden by a link that went lies in the same group of candidates; of two nodes all is known
    wide = cut(_grouped(nodes, connected(tried)), "similar-wide")
    more = wide.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("group")
    again = wide.join(failed.select(F.col("a").alias("node")), "node", "left_semi").join(more, "group", "left_semi")
    again = cut(wide.join(again, "group", "left_semi").drop("group"), "similar-again")
    apart = cut(_grouped(again, connected(links)), "similar-apart")
    return links.unionByName(cut(crossing_links(apart, texts, similarity, shingle), "similar-crossing"))


def _by_part(part: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    """bucket, entries: for each part, ``pack`` of the places of its entries."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(part) else order
    packed = [pack(at) for at in np.split(order, edges[1:])] if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array(part[order][edges]), pa.array(packed, pa.binary())], ["bucket", "entries"])


def frequent_shingles(docs: DataFrame, text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Keys (``ORDER_KEY`` bits) of the shingles that most texts of a sample have, the rarest first."""
    n = docs.count()
    sample = docs.select(text).sample(min(1.0, max(ORDER_SHARE, ORDER_ROWS / n)) if n else 1.0, seed=42)
    bits = PARTS.bit_length() - 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = shingle_sets(filled(batch.column(0)).cast(pa.large_string()), powers, shingle)[0] & ORDER_KEY
            rest = (keys >> np.uint64(bits)).astype("<u4")
            yield _by_part((keys % np.uint64(PARTS)).astype(np.int64), lambda at, rest=rest: rest[at].tobytes())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in whole_buckets(batches, 1):
            for p in parts:
                rest, n = np.unique(np.frombuffer(b"".join(rows.column(1)[p].to_pylist()), "<u4"), return_counts=True)
                keys = (rest[n > 1].astype(np.int64) << bits) + rows.column(0)[p.start].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[n > 1])], ["key", "n"])

    packed = map_batches(sample, pack, "bucket long, entries binary")
    several = cut(map_batches(_in_buckets(packed), tally, "key long, n long"), "similar-frequent")
    left, least = FREQUENT, 2
    for row in several.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("n")).collect():
        left -= row["keys"]
        if left < 0:
            least = row["n"] + 1
            break
    rows = several.filter(F.col("n") >= least).toArrow()
    keys, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    return keys[np.lexsort((keys, n))].astype(np.uint64)


def prefixes(keys: np.ndarray, home: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, similarity: float
             ) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the order of all shingles, end to end, and the number of each:
    two sets of the similarity share one. Shingles that are not ``frequent`` come first, by key."""
    if len(frequent):
        by_key = np.argsort(frequent)
        place = np.minimum(np.searchsorted(frequent, keys & ORDER_KEY, sorter=by_key), len(frequent) - 1)
        rank = np.where(frequent[by_key[place]] == keys & ORDER_KEY, by_key[place] + 1, 0)
        keys = keys[np.lexsort((keys, rank, home))]
    n = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1, 0)
    return gather(keys, np.cumsum(sizes) - sizes, n), n


def pairs_between(lists: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of one list and two groups, a bounded number at once."""
    if not len(lists):
        return
    order = np.lexsort((groups, lists))
    lists, groups = lists[order], groups[order]
    new = np.concatenate([[True], lists[1:] != lists[:-1]])
    turn = new | np.concatenate([[True], groups[1:] != groups[:-1]])

    def ends(begins: np.ndarray) -> np.ndarray:
        edges = np.append(np.flatnonzero(begins), len(lists))
        return edges[np.cumsum(begins)]

    after = ends(turn)
    counts = ends(new) - after  # rows of later groups of the list
    rows = np.flatnonzero(counts)
    upto = np.cumsum(counts[rows])
    low = 0
    while low < len(rows):
        base = upto[low] - counts[rows[low]]
        high = max(low + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        part, n = rows[low:high], counts[rows[low:high]]
        a = np.repeat(part, n)
        b = np.repeat(after[part] - (upto[low:high] - n - base), n) + np.arange(len(a))
        yield order[a], order[b]
        low = high


def can_overlap(sizes: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """For pairs that share a shingle at their ``places``: false if it cannot be the first they share."""
    of_a, of_b = sizes[a], sizes[b]
    least = similarity / (1 + similarity) * (of_a + of_b) - 1e-6
    return np.minimum(of_a - places[a], of_b - places[b]) >= least


def _listed(facts: DataFrame, schema: str, make: Callable[..., pa.RecordBatch]) -> DataFrame:
    """``make(shingle, node, group, size, place)`` over the prefixes of ``facts`` (node, group, size, prefix): all
    entries of a part of the shingle keys at once. Entries travel packed by part."""
    kinds = ("<u8", "<i8", "<i8", "<i4", "<i4")
    width = sum(np.dtype(k).itemsize for k in kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, group, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            made = batch.column(3).to_pylist()
            n = np.array([len(x) // 8 for x in made], np.int64)
            key, home = np.frombuffer(b"".join(made), "<u8"), np.repeat(np.arange(len(n)), n)
            place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            columns = (key, node[home], group[home], size[home], place)
            columns = [c.astype(k) for c, k in zip(columns, kinds)]
            yield _by_part((key % np.uint64(PARTS)).astype(np.int64),
                           lambda at, columns=columns: b"".join(c[at].tobytes() for c in columns))

    def unpack(rows: list[bytes]) -> list[np.ndarray]:
        columns: list[list[np.ndarray]] = [[] for _ in kinds]
        for data in rows:
            n, at = len(data) // width, 0
            for column, kind in zip(columns, kinds):
                column.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
        return [np.concatenate(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in whole_buckets(batches, 1):
            for p in parts:
                entries = unpack(rows.column(1)[p].to_pylist())
                yield make(*entries)

    packed = map_batches(facts.select("node", "group", "size", "prefix"), pack, "bucket long, entries binary")
    return map_batches(_in_buckets(packed), run, schema)


def _meeting(key: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float
             ) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs of entries that meet at a shingle and can be alike, and whether an entry's list is too
    long for that: all of such a list are taken to meet."""
    order = np.argsort(key, kind="stable")
    edges = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(edges) - 1
    n = np.bincount(of)
    long, some = n[of] > MOST, np.flatnonzero((n[of] > 1) & (n[of] <= MOST))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in pairs_between(of[some], group[some]):
            a, b = some[a], some[b]
            can = can_overlap(size, place, a, b, similarity)
            yield a[can], b[can]

    return pairs(), long


def prefix_links(facts: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join the ``facts`` (node, group, size, prefix) of different groups that meet; a forest
    of each part of the keys. What is not joined has not the similarity."""
    def make(key: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        names, of = np.unique(node, return_inverse=True)
        labels, found = np.arange(len(names)), []
        pairs, long = _meeting(key, group, size, place, similarity)
        if long.any():
            at = np.flatnonzero(long)
            at = at[np.argsort(key[at], kind="stable")]
            same = np.flatnonzero(key[at][1:] == key[at][:-1])
            labels, more = nearest_forest(labels, of[at[same]], of[at[same + 1]], np.zeros(len(same)))
            found += more
        for a, b in pairs:
            labels, more = nearest_forest(labels, of[a], of[b], np.zeros(len(a)))
            found += more
        return _links([names[f] for f in found])

    return _listed(facts, "a long, b long", make).distinct()


def prefix_members(facts: DataFrame, similarity: float) -> DataFrame:
    """bucket, node: a bucket for each shingle at which ``facts`` meet, with those that do; a list over
    ``MOST`` gets one for each pair of its parts."""
    def make(key: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        pairs, found = _meeting(key, group, size, place, similarity)
        lengths = dict(zip(*(x.tolist() for x in np.unique(key[found], return_counts=True))))
        at, buckets, long = [], [], np.flatnonzero(found)
        for shingle, n in lengths.items():
            members = long[key[long] == shingle]
            for bucket, who in _part_pairs(np.uint64(shingle), node[members], n):
                at.append(members[who])
                buckets.append(np.full(len(who), bucket, np.uint64))
        found[long] = False
        for a, b in pairs:
            found[a] = found[b] = True
        at.append(np.flatnonzero(found))
        buckets.append(key[at[-1]])
        at = np.concatenate(at)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), pa.array(node[at])],
                                          ["bucket", "node"])

    return _listed(facts, "bucket long, node long", make)


def _part_pairs(name: np.uint64, nodes: np.ndarray, n: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """Every pair of the parts of ``n`` nodes, of about half of ``MOST`` each: its bucket, and the places of its nodes."""
    count = -(-2 * n // MOST)
    part = (mix(nodes.view(np.uint64)) % np.uint64(count)).astype(np.int64)
    for p in range(count):
        for q in range(min(p + 1, count - 1), count):
            step = mix(np.array([p * count + q + 1], np.uint64))[0]
            yield mix(np.array([name ^ step], np.uint64))[0], np.flatnonzero((part == p) | (part == q))


def _groups(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected group of links (a, b); few links are joined in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
        a, b = np.concatenate(a), np.concatenate(b)
        names, of = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = unite(np.arange(len(names)), of[:len(a)], of[len(a):])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[labels])], ["node", "root"])

    if links.count() > LOCAL_LINKS:
        return connected(links)
    return cut(map_batches(links.select("a", "b").coalesce(1), run, "node long, root long"), "similar-groups")


def _blocked(facts: DataFrame, blocks: DataFrame, similarity: float) -> DataFrame:
    """bucket, node: where texts of one block are compared. ``blocks``: node, root."""
    count = F.count(F.lit(1)).alias("n")
    large = cut(blocks.groupBy("root").agg(count).filter(F.col("n") > MOST), "similar-large-blocks")
    whole = blocks.join(large, "root", "left_anti").select(F.col("root").alias("bucket"), "node")
    if large.isEmpty():
        return whole
    # a block's pairs of parts, or the lists of its shingles: whichever makes fewer rows
    inside = blocks.join(large, "root", "left_semi")
    members = cut(prefix_members(facts.join(inside.select("node"), "node", "left_semi"), similarity), "similar-members")
    listed = members.join(inside, "node").groupBy("root").agg(count)
    parts = F.ceil(2 * F.col("n") / MOST)
    by_parts = large.join(listed.withColumnRenamed("n", "rows"), "root", "left").filter(
        F.col("rows").isNotNull() & (F.col("rows") > F.col("n") * parts)).select("root", parts.cast("long").alias("parts"))
    by_parts = cut(by_parts, "similar-by-parts")
    dealt = inside.join(by_parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "node")
    by_list = members.join(inside.join(by_parts, "root", "left_anti").select("node"), "node", "left_semi")
    return whole.unionByName(dealt).unionByName(by_list.select("bucket", "node"))


def prefix_crossing(facts: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b: links that join all pairs of ``facts`` (node, group, size, prefix, sketch) of different groups that have
    the similarity; a forest of each block."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_buckets(batches):
            bucket, node, group, sizes = (rows.column(n).to_numpy() for n in ("bucket", "node", "group", "size"))
            made = rows.column("sketch").to_pylist()
            flat, words = np.frombuffer(b"".join(made), "<u8"), np.array([len(x) // 8 for x in made])
            found = np.zeros(len(node), bool)
            for a, b in pairs_between(bucket, group):
                can = can_be_alike(flat, words, sizes, a, b, similarity)
                found[a[can]] = found[b[can]] = True
            yield pa.RecordBatch.from_arrays([pa.array(bucket[found]), pa.array(node[found])], ["bucket", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, _ in whole_buckets(batches):
            bucket, node, group = (rows.column(n).to_numpy() for n in ("bucket", "node", "group"))
            keys, sizes = shingle_sets(filled(rows.column("text")).cast(pa.large_string()), powers, shingle)
            _, firsts, of = np.unique(np.stack([bucket, group], 1), axis=0, return_index=True, return_inverse=True)
            labels = firsts[of.ravel()]
            pairs = ((a, b, np.zeros(len(a))) for a, b in pairs_between(bucket, labels.copy()))
            yield _links([node[_held(pairs, labels, keys, sizes, similarity)]])

    blocks = _groups(cut(prefix_links(facts, similarity), "similar-prefix-links"))
    placed = _blocked(facts, blocks, similarity)
    rows = placed.join(facts.select("node", "group", "size", "sketch"), "node")
    met = cut(map_batches(_in_buckets(rows.select("bucket", "node", "group", "size", "sketch")), choose,
                          "bucket long, node long"), "similar-prefix-met")
    full = met.join(facts.select("node", "group"), "node").join(texts, "node")
    return map_batches(_in_buckets(full.select("bucket", "node", "group", "text")), compare, "a long, b long").distinct()


def every_link(nodes: DataFrame, facts: DataFrame, texts: DataFrame, similarity: float = SIMILARITY,
               shingle: int = SHINGLE) -> DataFrame:
    """a, b: links whose groups are those of all pairs of ``nodes`` (node, f0 to f3) that have the similarity.
    ``facts``: node, size, prefix, sketch."""
    tried = cut(near_candidates(nodes), "similar-candidates")
    links = cut(confirmed(tried, texts, similarity, shingle), "similar-confirmed")
    apart = cut(_grouped(nodes.select("node"), _groups(links)), "similar-apart")
    more = prefix_crossing(facts.join(apart, "node"), texts, similarity, shingle)
    return links.unionByName(cut(more, "similar-crossing"))


def _grouped(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``nodes`` with the smallest node of their group, or themselves, as ``group``."""
    return nodes.join(groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")


def with_fingerprints(docs: DataFrame, text: str, names: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Adds the four lanes under ``names`` (long, the bits as signed) to every row."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = filled(batch.column(place)).cast(pa.large_string())
            made = [fingerprints(texts[a:b], powers, shingle) for a, b in slices(texts)]
            made = np.concatenate(made) if made else np.zeros((0, LANES), np.uint64)
            lanes = [pa.array(np.ascontiguousarray(made[:, i]).view(np.int64)) for i in range(LANES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lanes], [*batch.schema.names, *names])

    fields = [T.StructField(n, T.LongType()) for n in names]
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *fields]))


def with_facts(docs: DataFrame, text: str, names: list[str], similarity: float = SIMILARITY, shingle: int = SHINGLE
               ) -> DataFrame:
    """Adds the four lanes, a digest of the set, its size, its prefix and its sketch under ``names`` to every row."""
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, shingle))

    def packed(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
        data, edges = flat.astype("<u8").tobytes(), (8 * np.concatenate([[0], np.cumsum(n)])).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, frequent = Powers(), shared.value
        for batch in batches:
            texts = filled(batch.column(place)).cast(pa.large_string())
            for low, high in slices(texts):
                keys, home = shingle_keys(texts.slice(low, high - low), powers, shingle)
                sizes = np.bincount(home, minlength=high - low)
                lanes = lanes_of(keys, home, high - low)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ _STEP))])
                ends = np.cumsum(sizes)
                made = [*(pa.array(np.ascontiguousarray(lanes[:, i]).view(np.int64)) for i in range(LANES)),
                        pa.array((sums[ends] - sums[ends - sizes]).view(np.int64)), pa.array(sizes, pa.int64()),
                        pa.array(packed(*prefixes(keys, home, sizes, frequent, similarity)), pa.binary()),
                        pa.array(packed(*sketches(keys, sizes)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *made],
                                                 [*batch.schema.names, *names])

    kinds = [*[T.LongType()] * (LANES + 2), T.BinaryType(), T.BinaryType()]
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
             shingle: int = SHINGLE, whole: bool = False) -> DataFrame:
    """The rows of ``docs`` with one of each group kept: that of the smallest key. With ``whole`` groups
    are those of every pair that has the similarity, else those of the pairs that fingerprints find."""
    row = free_name(docs.columns, "__row")
    made = [*(f"f{i}" for i in range(LANES)), *(["digest", "size", "prefix", "sketch"] if whole else [])]
    names = [free_name(docs.columns, f"__{n}") for n in made]
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    stored = cut(with_facts(numbered, text, names, similarity, shingle) if whole
                 else with_fingerprints(numbered, text, names, shingle), "similar-docs")
    known = stored.select(F.col(row).alias("node"), *(F.col(n).alias(m) for n, m in zip(names, made)))
    rows = stored.select(F.col(row).alias("r"), *(F.col(n).alias(m) for n, m in zip(names, made[:LANES + 1])), F.col(key).alias("key"))
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("r"))
    nodes = cut(rows.groupBy(*made[:LANES + 1]).agg(F.min(first).alias("first"))
                .withColumn("node", F.col("first.r")), "similar-nodes")
    texts = stored.select(F.col(row).alias("node"), F.col(text).alias("text"))
    lanes = nodes.drop("first", "digest")
    if whole:
        links = every_link(lanes, known.select("node", "size", "prefix", "sketch"), texts, similarity, shingle)
        groups = _groups(links)
    else:
        groups = connected(all_links(lanes, texts, similarity, shingle))
    rooted = _grouped(nodes, groups).select("first", F.col("group").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.r").alias(row))
    return stored.join(kept, row, "left_semi").select(*docs.columns)
