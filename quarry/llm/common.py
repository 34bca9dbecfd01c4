"""What the operators share: folds, texts as Arrow buffers, word keys, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import BATCH_BYTES, bounded  # noqa: F401

#: Words are maximal runs without these characters (space, tab, \n, \v, \f, \r).
WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"
#: Text of about this many bytes is worked on at once in a task; one longer text is worked on alone.
SLICE_BYTES = 1 << 19


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of about ``session.BATCH_BYTES`` (or one row) at most."""
    return bounded(rows).mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one array with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the bounds between them (one more than texts)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    if bounds is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset:]
    at = at.astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a row is never split."""
    bounds = text_bytes(texts)[1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
        yield begin, min(end, len(texts))
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the running polynomial below, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the polynomial's base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = []
            for base in (_BASE, _INVERSE):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


#: Spans of more symbols are hashed one by one: modulo 2**64 the polynomial below takes some regular
#: long spans for one another, whatever its base.
LONG_SPAN = 24


def span_keys(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit key for each span of ``values`` (random 64-bit numbers, one per symbol).

    Prefix sums of a polynomial give every short span's hash without a loop over spans: equal spans
    have equal keys wherever they stand. The few long spans are hashed whole.
    """
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    keys = (sums[ends] - sums[begins]) * down[begins]
    keys = mix(keys + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    long = np.flatnonzero(ends - begins > LONG_SPAN)
    if len(long):
        keys[long] = [xxhash.xxh3_64_intdigest(values[b:e]) for b, e in zip(begins[long].tolist(), ends[long].tolist())]
    return keys


_LOWERED = np.arange(256, dtype=np.uint64)
_LOWERED[65:91] += 32
#: A random number per byte; upper and lower case A-Z share one.
BYTE_VALUES = mix(_LOWERED + np.uint64(0x5851F42D4C957F2D))
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(WORD_BREAKS)] = True
#: Keys of the mark that ends a text and of the one before its first word.
END, BEGIN = mix(np.array([0xE4D, 0xBE61], np.uint64))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every word."""
    gap = IS_BREAK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    inside = ~gap
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    begins = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return begins, ends, np.searchsorted(bounds, begins, "right") - 1


def token_keys(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts (words with A-Z lower-cased, then one end each), the keys of
    the tokens before them, and the number of tokens of each text."""
    data, bounds = text_bytes(texts)
    begins, ends, home = word_spans(data, bounds)
    n_words = np.bincount(home, minlength=len(texts))
    tokens = np.empty(len(begins) + len(texts), np.uint64)
    last = np.cumsum(n_words + 1) - 1
    tokens[last] = END
    tokens[np.arange(len(begins)) + home] = span_keys(BYTE_VALUES[data], begins, ends, powers)
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    if len(texts):
        previous[np.concatenate([[0], last[:-1] + 1])] = BEGIN
    return tokens, previous, n_words + 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order of appearance, where each stands first, and each key's number."""
    import pandas as pd

    codes, different = pd.factorize(keys)
    first = np.empty(len(different), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return different, first, codes


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[b : b + n]`` end to end."""
    total = int(sizes.sum())
    shift = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(total)]
