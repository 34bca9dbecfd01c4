"""Language-model scores from a log-frequency Bloom filter.

``learn`` counts words and word pairs of the training texts with Spark, quantises the logarithm of
their counts and puts one entry per n-gram and level into a Bloom filter. An n-gram's level is found
by asking for level 1, 2, ... until an answer is no. ``score`` reads smoothed probabilities from such
probes.

Size. Every word and every pair that occurs is held, at any size of the corpus (``FLOOR`` is unset),
12 bits for each of its levels, so the filter grows with the number of different n-grams. It consists of one part per
bucket of n-grams, made in tasks; parts are broadcast in shards of about ``SHARD_BYTES``. The driver
holds one shard at a time, and so does a task, which asks each shard in turn for the tokens of about
``GROUP_TOKENS``. Pairs are dealt to buckets by their first word, save those of the ``HOT`` most
frequent words, which are dealt by the pair.

Model: P(w | v) = MIX * (max(c(vw) - D, 0) / c(v) + left(v) * P(w)) + (1 - MIX) * P(w), with counts
from levels, left(v) the share of v's occurrences not held by its counted pairs, stored as levels of
its own, and P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)).

``base`` counts are exact: words with a relative frequency of 1 / ``EXACT`` or more are looked up in a
table of at most ``EXACT`` rows, the others (none of them frequent, so no hot key) are joined.

Defined cases: a null or empty text is one end mark. Without training texts N = V = 0, every token
has the probability 1 and scores are 0. Repeated rows are scored each; rows may share a doc_id or
have none (a null doc_id counts as the empty text in the fold). Columns of the input other than key
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BEGIN, END, Powers, distinct, filled, map_batches, mix, slices, token_keys
from quarry.session import cut

#: If set, n-grams with a relative frequency under 1 / FLOOR are left out of the filter, and words
#: among them share what probability is left.
FLOOR: int | None = None
#: Words whose exact counts go to all tasks, at most; those of the others are joined.
EXACT = 1 << 21
#: Words whose pairs are dealt one by one, at most.
HOT = 1 << 12
#: Bytes of the filter that are broadcast, and loaded by a task, together.
SHARD_BYTES = 8 << 20
#: Tokens that a task looks up together in each shard.
GROUP_TOKENS = 1 << 20
RATIO = 1.3
BITS_PER_ENTRY = 12
PROBES = 5
DISCOUNT = 0.75
MIX = 0.5
#: Tokens of a task that are counted before rows go to Spark.
CHUNK_TOKENS = 1 << 19

#: Kinds of entries: a word, a pair, and the occurrences of a word that its held pairs take up.
WORD, PAIR, TAKEN = mix(np.arange(3, dtype=np.uint64) + np.uint64(0x57))


def entry_keys(kind: np.uint64, word: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    keys = word.astype(np.uint64) + kind
    return mix(keys if before is None else keys ^ mix(before.astype(np.uint64) + kind))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys + np.uint64(0xB0C4E7)) % np.uint64(buckets)).astype(np.int32)


def pair_buckets(pairs: np.ndarray, before: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of pairs (entry keys): by the word before, or by the pair where that word is hot."""
    return bucket_of(np.where(held(hot, before)[0], pairs, before), buckets)


def levels(counts: np.ndarray, floor: float) -> np.ndarray:
    """Quantised logarithm of a count; 0 below the floor."""
    with np.errstate(divide="ignore"):
        level = 1 + np.floor(np.log(np.maximum(counts, 1e-300) / floor) / np.log(RATIO) + 1e-9)
    return np.maximum(level, 0).astype(np.int64)


def count_of(level: np.ndarray, floor: float) -> np.ndarray:
    """The middle of a level, 0 for none."""
    return np.where(level > 0, floor * RATIO ** (level - 0.5), 0.0)


@dataclass
class Filter:
    """A Bloom filter whose entries are (n-gram, level). The bits of an entry lie in one 64-bit word,
    so a question reads memory once."""

    bits: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, level: np.ndarray) -> Filter:
        words = max(1, -(-int(level.sum()) * BITS_PER_ENTRY // 64))
        bits = np.zeros(words, np.uint64)
        for step in range(1, int(level.max(initial=0)) + 1):
            spread, wanted = cls._hashes(keys[level >= step], step)
            np.bitwise_or.at(bits, (spread * np.uint64(words)) >> np.uint64(32), wanted)
        return cls(bits)

    @staticmethod
    def _hashes(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """32 bits that choose the word, and the bits in it."""
        code = mix(keys + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        wanted = np.uint64(1) << (code & np.uint64(63))
        for k in range(1, PROBES):
            wanted |= np.uint64(1) << ((code >> np.uint64(6 * k)) & np.uint64(63))
        return code >> np.uint64(32), wanted

    def level(self, keys: np.ndarray, begins: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """The last level before the first that is not there; with ``begins`` and ``sizes`` (words),
        each key is looked for in a part of its own."""
        found = np.zeros(len(keys), np.int16)
        if begins is None:
            begins, sizes = np.zeros(len(keys), np.uint64), np.full(len(keys), len(self.bits))
        begins, sizes = begins.astype(np.uint64), sizes.astype(np.uint64)
        # a bucket without n-grams has no part
        alive, step = np.flatnonzero(sizes), 1
        keys, begins, sizes = keys[alive], begins[alive], sizes[alive]
        while len(alive):
            spread, wanted = self._hashes(keys, step)
            hit = self.bits[begins + ((spread * sizes) >> np.uint64(32))] & wanted == wanted
            alive, keys, begins, sizes = alive[hit], keys[hit], begins[hit], sizes[hit]
            found[alive] = step
            step += 1
        return found


@dataclass
class Model:
    """Totals, the exact counts of frequent words, the hot words, and the shards of the filter."""

    n: int
    v: int
    floor: float
    rare: float  # probability of a word that is not held
    words: np.ndarray
    counts: np.ndarray
    buckets: int
    hot: np.ndarray
    hot_taken: np.ndarray
    shards: list  # broadcasts of (first bucket, where each bucket's part begins, words), by bucket
    firsts: list  # first bucket of each shard

    def level(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Levels of entries; one shard is loaded at a time."""
        found = np.zeros(len(keys), np.int16)
        of = np.searchsorted(np.array(self.firsts[1:], np.int64), bucket, "right")
        # 16 bits sort by counting
        order = np.argsort(of.astype(np.uint16) if len(self.shards) <= 1 << 16 else of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(self.shards) + 1))
        for number, shard in enumerate(self.shards):
            first, starts, bits = shard.value
            mine = order[edges[number]:edges[number + 1]]
            part = bucket[mine] - first
            found[mine] = Filter(bits).level(keys[mine], starts[part], starts[part + 1] - starts[part])
            if len(self.shards) > 1:
                del bits
                vars(shard).pop("_value", None)  # it is read from its file again
        return found


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token keys and the keys before them, about CHUNK_TOKENS at a time."""
    powers, held, n = Powers(), [], 0
    for batch in batches:
        texts = filled(batch.column(column))
        for low, high in slices(texts):
            tokens, before, _ = token_keys(texts.slice(low, high - low), powers)
            held.append((tokens, before))
            n += len(tokens)
            if n >= CHUNK_TOKENS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """word (key), n: every token of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _chunks(batches, 0):
            words, _, of = distinct(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(of))], ["word", "n"])

    return map_batches(texts.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_DEALT = "bucket int, befores binary, runs binary, words binary, times binary"
_PARTS = "bucket int, bits binary, hot array<struct<word: long, taken: double>>"


def _dealt(bucket: np.ndarray, before: np.ndarray | None, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: the words before, how many entries each has, words and counts. Words by
    themselves have no word before."""
    order = np.argsort(bucket, kind="stable") if before is None else np.lexsort((before, bucket))
    bucket, word, n = bucket[order], word[order], n[order].astype(np.uint32)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    befores = runs = [b""] * (len(edges) - 1)
    if before is not None:
        before = before[order]
        new = np.ones(len(before), bool)
        new[1:] = (before[1:] != before[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(before))).astype(np.uint32)
        cuts = np.searchsorted(first, edges)
        befores = [before[first[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
        runs = [size[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges[:-1]], pa.int32()), pa.array(befores, pa.binary()), pa.array(runs, pa.binary()),
         *(pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in (word, n))],
        ["bucket", "befores", "runs", "words", "times"])


def count_parts(texts: DataFrame, counts: DataFrame, hot: np.ndarray, buckets: int, floor: float,
                text: str = "text") -> DataFrame:
    """bucket, bits, hot (word, taken): the filter's part for each bucket, of all its words and pairs
    from ``floor`` on, and what the bucket's pairs take up of the hot words."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, before in _chunks(batches, 0):
            different, at, of = distinct(entry_keys(PAIR, tokens, before))
            yield _dealt(pair_buckets(different, before[at], shared.value, buckets), before[at], tokens[at], np.bincount(of))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # a level tells as much of a count above this
            yield _dealt(bucket_of(word.view(np.uint64), buckets), None, word, np.minimum(n, (1 << 32) - 1))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows, of = [], None
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != of and held_rows:
                    yield _part(of, held_rows, shared.value, floor)
                    held_rows = []
                of = bucket
                held_rows.append(row)
        if held_rows:
            yield _part(of, held_rows, shared.value, floor)

    dealt = map_batches(texts.select(text), pairs, _DEALT).unionByName(
        map_batches(counts.select("word", "n"), words, _DEALT))
    return map_batches(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket"), parts, _PARTS)


def _part(bucket: int, rows: list[list[bytes]], hot: np.ndarray, floor: float) -> pa.RecordBatch:
    def joined(column: int, kind: type, of_pairs: bool) -> np.ndarray:
        return np.frombuffer(b"".join([r[column] for r in rows if bool(r[0]) == of_pairs]), kind)

    word, n_word = joined(2, np.uint64, False), joined(3, np.uint32, False)
    before = np.repeat(joined(0, np.uint64, True), joined(1, np.uint32, True))
    pair, at, to = distinct(entry_keys(PAIR, joined(2, np.uint64, True), before))
    n_pair = np.bincount(to, weights=joined(3, np.uint32, True), minlength=len(pair))
    context, _, home = distinct(before[at])
    taken = np.bincount(home, weights=np.where(n_pair >= floor, n_pair - DISCOUNT, 0), minlength=len(context))
    is_hot = held(hot, context)[0]
    keys = np.concatenate([entry_keys(WORD, word), pair, entry_keys(TAKEN, context[~is_hot])])
    level = np.concatenate([levels(n_word, floor), levels(n_pair, floor), levels(taken[~is_hot], floor)])
    sums = [{"word": w, "taken": t} for w, t in zip(context[is_hot].view(np.int64).tolist(), taken[is_hot].tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([Filter.of(keys, level).bits.tobytes()], pa.binary()),
         pa.array([sums], pa.list_(pa.struct([("word", pa.int64()), ("taken", pa.float64())])))],
        ["bucket", "bits", "hot"])


def share_parts(parts: DataFrame, buckets: int) -> tuple[list, list[int]]:
    """The filter as broadcasts of about ``SHARD_BYTES``, and the first bucket of each; the driver
    holds one at a time."""
    sizes = np.zeros(buckets, np.int64)  # 64-bit words
    for r in parts.select("bucket", (F.octet_length("bits") / 8).cast("long").alias("size")).collect():
        sizes[r["bucket"]] = r["size"]
    upto, shards, firsts, first = np.concatenate([[0], np.cumsum(sizes)]), [], [], 0
    while first < buckets:
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + SHARD_BYTES // 8, "right")) - 1)
        rows = parts.filter(F.col("bucket").between(first, end - 1)).select("bucket", "bits").collect()
        bits = np.frombuffer(b"".join([bytes(r["bits"]) for r in sorted(rows, key=lambda r: r["bucket"])]), np.uint64)
        shards.append(parts.sparkSession.sparkContext.broadcast((first, upto[first:end + 1] - upto[first], bits)))
        vars(shards[-1]).pop("_value", None)  # the driver doesn't ask it
        firsts.append(first)
        first = end
    return shards, firsts


def held(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether keys are in a sorted array, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[place] == keys, place


def learn(training: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the exact counts of all words (word, n) as a stored table."""
    spark = training.sparkSession
    counts = cut(count_words(training, text), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    floor = max(n / FLOOR, 1.0) if FLOOR else 1.0
    # at most EXACT rows: their frequencies are over 1 / EXACT each and add up to one
    frequent = counts.filter(F.col("n") >= max(n / EXACT, floor)).toArrow()
    words = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, known = words[order], frequent["n"].to_numpy()[order].astype(np.int64)
    n_held, v_held = counts.filter(F.col("n") >= floor).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    rest = v - v_held + 1
    rare = (n - n_held + 0.5 * rest) / (n + 0.5 * (v + 1)) / rest if n else 1.0

    # the mark before a text stands once in each text, and is no word
    often = counts.filter(F.col("n") >= max(n / HOT, 1.0)).select("word").toArrow()["word"].to_numpy().view(np.uint64)
    hot = np.unique(np.append(often, BEGIN))
    buckets = max(8, min(512, n >> 15), n >> 21)
    parts = cut(count_parts(training, counts, hot, buckets, floor, text), "lm-parts")
    hot_taken = np.zeros(len(hot))
    for r in parts.select(F.explode("hot").alias("x")).groupBy("x.word").agg(F.sum("x.taken").alias("taken")).collect():
        hot_taken[held(hot, np.array([r["word"]], np.int64).view(np.uint64))[1]] = r["taken"]
    return Model(n, v, floor, rare, words, known, buckets, hot, hot_taken, *share_parts(parts, buckets)), counts


def log_probability(model: Model, words: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 P(token | token before) of the tokens ``words[at]``, from probes of the filter; ``first``
    marks the tokens that open a text. Each different word and pair is asked for once."""
    if not model.n or not len(at):
        return np.zeros(len(at))
    total = model.n + 0.5 * (model.v + 1)
    context = np.append(words, BEGIN)
    of = np.empty_like(at)
    of[1:] = at[:-1]
    of[first] = len(words)
    _, spot, to = distinct(of * len(words) + at)
    before = context[of[spot]]
    pairs = entry_keys(PAIR, words[at[spot]], before)
    # the mark before a text stands once in each text, as the end mark does
    singles = np.concatenate([words, np.where(context == BEGIN, END, context)])
    found = model.level(
        np.concatenate([entry_keys(WORD, singles), entry_keys(TAKEN, context), pairs]),
        np.concatenate([bucket_of(singles, model.buckets), bucket_of(context, model.buckets),
                        pair_buckets(pairs, before, model.hot, model.buckets)]))
    level, in_texts, in_pairs, found = np.split(found, np.cumsum([len(words), len(context), len(context)]))
    single = np.where(level > 0, (count_of(level, model.floor) + 0.5) / total, model.rare)
    n_before = count_of(in_texts, model.floor)
    is_hot, place = held(model.hot, context)
    in_pairs = np.where(is_hot, levels(model.hot_taken, model.floor)[place], in_pairs)
    taken = count_of(in_pairs, model.floor)
    share = np.where(n_before > 0, np.minimum(taken / np.maximum(n_before, 1e-300), 0.98), 0.0)
    # of each different pair
    single, n_before, share = single[at[spot]], n_before[of[spot]], share[of[spot]]
    n_pair = np.minimum(count_of(found, model.floor), n_before)
    direct = np.where(n_before > 0, np.maximum(n_pair - DISCOUNT, 0) / np.maximum(n_before, 1e-300), 0.0)
    # with no pair held at all, share is 0 and this is P(word) again
    return np.log10(np.minimum(MIX * (direct + (1 - share) * single) + (1 - MIX) * single, 1.0))[to]


def score(docs: DataFrame, model: Model, counts: DataFrame, carry: list[Column], text: str = "text") -> DataFrame:
    """The ``carry`` columns and n_tokens, n_known, train_tokens, base_score, score of every row.

    ``counts`` are the exact word counts that ``learn`` gave.
    """
    spark = docs.sparkSession
    plain, shards = replace(model, shards=[]), model.shards
    shared = spark.sparkContext.broadcast(vars(plain))
    names = [f"__carry{i}" for i in range(len(carry))]
    rows = docs.select(*(c.alias(n) for c, n in zip(carry, names)), F.monotonically_increasing_id().alias("__row"),
                       F.col(text).alias("__text"))
    heads = rows.drop("__text").schema
    n_head = len(heads)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in heads),
                        "n_tokens long, n_known long, base double, score double, rare array<struct<word: long, n: long>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, powers = Model(**shared.value | {"shards": shards}), Powers()
        total = model.n + 0.5 * (model.v + 1)
        base_of = np.log10((model.counts + 0.5) / total) if model.n else np.zeros(0)

        def scored(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            words, _, at = distinct(np.concatenate([g[1] for g in group]))
            every = log_probability(model, words, at, np.concatenate([g[2] == BEGIN for g in group]))
            is_known, place = held(model.words, words)
            base_of_word = np.where(is_known, base_of[place], 0.0) if len(base_of) else np.zeros(len(words))
            upto = 0
            for head, tokens, _, sizes in group:
                here, upto = slice(upto, upto + len(tokens)), upto + len(tokens)
                logs, known = every[here], is_known[at[here]]
                n_rows = len(sizes)
                home = np.repeat(np.arange(n_rows), sizes)
                of_text = lambda w: np.bincount(home, weights=w, minlength=n_rows)
                base = of_text(base_of_word[at[here]])
                # the others, counted per text
                pair, n = np.unique(home[~known] * len(words) + at[here][~known], return_counts=True)
                edges = np.searchsorted(pair, np.arange(n_rows + 1) * len(words))
                rare = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(words[pair % len(words)].view(np.int64)), pa.array(n, pa.int64())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(sizes, pa.int64()),
                     pa.array(of_text(known).astype(np.int64)), pa.array(base), pa.array(of_text(logs)), rare],
                    [*heads.names, "n_tokens", "n_known", "base", "score", "rare"])

        group, n_held = [], 0
        for batch in batches:
            texts = filled(batch.column(n_head))
            for low, high in slices(texts):
                group.append((batch.slice(low, high - low).columns[:n_head],
                              *token_keys(texts.slice(low, high - low), powers)))
                n_held += len(group[-1][1])
                if n_held >= GROUP_TOKENS:
                    yield from scored(group)
                    group, n_held = [], 0
        if group:
            yield from scored(group)

    first = cut(map_batches(rows, run, schema), "lm-first")
    for shard in shards:
        shard.unpersist()  # executors fetch it again if the model is used again
    total = model.n + 0.5 * (model.v + 1) if model.n else 1.0
    rare = first.select("__row", F.explode("rare").alias("x")).select("__row", "x.word", F.col("x.n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    log = F.log10((c + 0.5) / F.lit(total)) if model.n else F.lit(0.0)
    per_row = (rare.join(counts, "word", "left").groupBy("__row")
               .agg(F.sum(F.col("times") * log).alias("more"),
                    F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")))
    none = F.lit(0)
    return first.drop("rare").join(per_row, "__row", "left").select(
        *(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
