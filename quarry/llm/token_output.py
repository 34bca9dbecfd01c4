"""Token ids in blocks of Simple-8b words.

A word has a 4-bit selector above 60 bits of data: the selector says how many ids of which width
follow. An id that needs more than 60 bits is an escape: the word holds its place in the block's
list of raw 64-bit values. A block holds whole documents and is one row of the files:

    shard int, block int        files are cut into shards by doc_id, blocks count within a shard
    start_in_shard long         ids of the shard before the block
    doc_ids array<long>         its documents, in order
    ends array<int>             ids of the block up to and with each document
    run_starts array<int>       ids before each run of 4,096 words: a reader can enter there
    words, escapes binary       little-endian 64-bit values

Rows are stored as Parquet: Spark commits them, and a lost executor's part is written again.

Order: ascending doc_id, null first; rows of one doc_id by a hash of their text. A document is never
split, so a task holds one block, which is as large as its longest document or ``BLOCK_IDS``. A null
or empty text has the end id alone. Strings of added tokens are those tokens, as in the library. Repeated rows are written each time. An empty table gives no
blocks and no documents. Other columns of the input are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import byte_bpe
from quarry.llm.common import filled, map_batches, slices

#: Ids in a word, and bits of each, by selector. 0 is the escape, 1 a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 0

BLOCK_IDS = 1 << 16
RUN_WORDS = 4096
#: Text bytes of a shard.
SHARD_BYTES = 64 << 20

BLOCKS = ("shard int, block int, start_in_shard long, doc_ids array<long>, ends array<int>, "
          "run_starts array<int>, words binary, escapes binary")


def _fits(values: np.ndarray) -> np.ndarray:
    """For every place the selector of the longest word that can begin there."""
    widths = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    widths = np.concatenate([widths, np.zeros(COUNTS.max(), np.uint8)])
    most = {1: widths}  # most[n]: the greatest width of n ids from a place on
    step = 1
    while step < COUNTS.max():
        most[2 * step] = widths_of = most[step].copy()
        np.maximum(widths_of[:-step], most[step][step:], out=widths_of[:-step])
        step *= 2
    chosen = np.full(len(values), ESCAPE, np.int8)
    for selector in range(len(COUNTS) - 1, 0, -1):  # a later, longer choice overwrites
        n = int(COUNTS[selector])
        half = 1 << (n.bit_length() - 1)
        widest = np.maximum(most[half][:len(values)], most[half][n - half:n - half + len(values)])
        chosen[widest <= BITS[selector]] = selector
    return chosen


def _chain(onward: np.ndarray) -> np.ndarray:
    """0, onward[0], onward[onward[0]], ... below the length; 32 steps at a time."""
    n = len(onward)
    jumps = [np.append(np.minimum(onward, n), n)]
    while len(jumps) < 6:
        jumps.append(jumps[-1][jumps[-1]])
    far, at, found = jumps.pop().tolist(), 0, []
    while at < n:
        found.append(at)
        at = far[at]
    starts = np.array(found, np.int64)
    for jump in reversed(jumps):
        starts = np.stack([starts, jump[starts]], 1).ravel()
    return starts[starts < n]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped values, and the number of values before each word."""
    values = values.astype(np.uint64)
    chosen = _fits(values)
    starts = _chain(np.arange(len(values)) + COUNTS[chosen])
    selectors = chosen[starts] if len(starts) else np.zeros(0, np.int8)
    padded = np.concatenate([values, np.zeros(COUNTS.max(), np.uint64)])
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        here = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            words[here] |= np.arange(len(here), dtype=np.uint64)
        elif BITS[selector]:
            each = np.arange(COUNTS[selector])
            data = padded[starts[here][:, None] + each] << (each * BITS[selector]).astype(np.uint64)
            words[here] |= np.bitwise_or.reduce(data, axis=1)
    return words, values[starts[selectors == ESCAPE]] if len(starts) else values, starts


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of the words, without a loop over words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    data = words & np.uint64((1 << 60) - 1)
    for selector in np.unique(selectors).tolist():
        here = selectors == selector
        if selector == ESCAPE:
            out[starts[here]] = escapes[data[here].astype(np.int64)]
        elif BITS[selector]:
            each = np.arange(COUNTS[selector])
            mask = np.uint64((1 << int(BITS[selector])) - 1)
            out[starts[here][:, None] + each] = (data[here][:, None] >> (each * BITS[selector]).astype(np.uint64)) & mask
    return out[:n]


def write(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 0, key: str = "doc_id",
          text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append ``end_id`` and write the blocks to ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(-(-size // shard_bytes) or 1, *order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast((byte_bpe.loaded(tokenizer_json, added=True), byte_bpe.character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.Encoder(*shared.value, added=True)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held, names, n_held = [], [], 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, escapes, starts = pack(ids)
            ends = np.cumsum([len(x) for x in held])
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([names], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())),
                pa.array([starts[::RUN_WORDS]], pa.list_(pa.int32())),
                pa.array([words.astype("<u8").tobytes()], pa.binary()),
                pa.array([escapes.astype("<u8").tobytes()], pa.binary())],
                ["shard", "block", "start_in_shard", "doc_ids", "ends", "run_starts", "words", "escapes"])

        for batch in batches:
            texts = filled(batch.column(1))
            for low, high in slices(texts, byte_bpe.TEXT_BYTES):
                flat, sizes = encoder(texts.slice(low, high - low).to_pylist())
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                for i, name in enumerate(batch.column(0).slice(low, high - low).to_pylist()):
                    held.append(np.append(flat[edges[i]:edges[i + 1]], np.int32(end_id)))
                    names.append(name)
                    n_held += len(held[-1])
                    if n_held >= BLOCK_IDS:
                        yield packed()
                        block, before = block + 1, before + n_held
                        held, names, n_held = [], [], 0
        if held:
            yield packed()

    map_batches(ordered, run, BLOCKS).write.mode("errorifexists").parquet(path)


def read_documents(spark: SparkSession, path: str, fields: str = "ids array<int>",
                   of_ids: Callable[[np.ndarray], tuple] | None = None) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, then
    ``fields``, which ``of_ids`` makes of the document's ids; the ids themselves unless told otherwise."""
    of_ids = of_ids or (lambda ids: (ids.astype(np.int32),))
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row per shard: bounded by the number of files
    totals = blocks.groupBy("shard").agg(F.sum(F.element_at("ends", -1).cast("long")).alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("shard_start"))
    placed = blocks.join(F.broadcast(starts), "shard").select(
        (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "doc_ids", "ends", "words", "escapes")
    schema = spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {fields}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, names, ends, words, escapes = (c[row].as_py() for c in batch.columns)
                ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"), ends[-1])
                edges = [0, *ends]
                rows = [(name, start + low, high - low, *of_ids(ids[low:high]))
                        for name, low, high in zip(names, edges, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return map_batches(placed, run, schema)


def ids_crc32(ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
