"""Quality by nearest-neighbour voting over latent-semantic vectors.

``fit`` takes a bounded sample of labelled texts, weighs hashed character pairs and triples by inverse document
frequency, and finds the leading singular directions. Its labelled vectors are broadcast
(MAX_LABELLED * DIMENSIONS floats at most, whatever the corpus); ``score`` computes, block by block,
the cosine of every document with every labelled vector and lets the nearest vote, each with its
similarity as weight.

Features are character pairs and triples of the whole text, since quality shows in how text is set
(signs, capitals, separators) rather than in its words, and how far the text repeats itself: the
shares of it made up by features that are once, twice, four times, ... as frequent as expected.

Defined cases: a null or empty text, or one whose features no labelled text has, has no neighbours
and gets the share of label 1 among the labelled rows. Without labelled rows every score is 0.5.
Ties of similarity go to the labelled row that comes first by key. Rows with a null label or key
teach nothing; several rows of one document teach as one each. Columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import filled, map_batches, mix, slices, text_bytes

#: Labelled rows that are fitted on, at most: a sample by hash of the key.
MAX_LABELLED = 4096
FEATURES = 2048
#: Powers of two that repetition is told apart by.
LEVELS = 8
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 256

_PAIRS = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(FEATURES // 2)).astype(np.int32)
_TRIPLES = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(FEATURES // 2) + np.uint64(FEATURES // 2)).astype(np.int32)


def features(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte pairs (first half) and triples, one row per text."""
    data, bounds = text_bytes(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    if len(data) < 2:
        return out
    wide = data.astype(np.uint32)
    pair = (wide[:-1] << 8) | wide[1:]
    # triples fold to 16 bits before they are looked up
    triple = ((pair[:-1] * np.uint32(40503)) ^ (wide[2:] * np.uint32(30011))) & np.uint32(0xFFFF)
    first, second = _PAIRS[pair], _TRIPLES[triple]
    for row in range(len(texts)):
        low, high = int(bounds[row]), int(bounds[row + 1])
        if high - low >= 2:
            out[row, :FEATURES // 2] = np.bincount(first[low:high - 1], minlength=FEATURES // 2)[:FEATURES // 2]
        if high - low >= 3:
            out[row, FEATURES // 2:] = np.bincount(second[low:high - 2] - FEATURES // 2, minlength=FEATURES // 2)
    return out


def repetition(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Square roots of the shares of pairs and of triples at each power of two of the expected number."""
    shares = []
    for half in (slice(0, FEATURES // 2), slice(FEATURES // 2, FEATURES)):
        n = np.maximum(counts[:, half].sum(1, keepdims=True), 1)
        times = counts[:, half] / (1 + n * expected[half])
        level = np.clip(np.log2(np.maximum(times, 1)).astype(np.int8), 0, LEVELS - 1)
        shares.append(np.stack([np.where(level == k, counts[:, half], 0).sum(1) for k in range(LEVELS)], 1) / n)
    return np.sqrt(np.concatenate(shares, 1))


@dataclass
class Model:
    expected: np.ndarray     # mean share of a feature among those of its kind
    weights: np.ndarray      # inverse document frequency of a feature
    directions: np.ndarray   # columns of described() x dimensions
    vectors: np.ndarray      # labelled rows x dimensions, of length 1
    labels: np.ndarray
    prior: float

    def state(self) -> tuple:
        return self.expected, self.weights, self.directions, self.vectors, self.labels, self.prior

    def described(self, counts: np.ndarray) -> np.ndarray:
        """Weighted logarithmic counts, then repetition, each of length 1."""
        parts = [np.log1p(counts) * self.weights, repetition(counts, self.expected)]
        return np.concatenate([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in parts],
                              1).astype(np.float32)

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1; zero for texts without a feature."""
        placed = self.described(counts) @ self.directions
        length = np.linalg.norm(placed, axis=1, keepdims=True)
        return np.where(length > 1e-6, placed / np.maximum(length, 1e-12), 0).astype(np.float32)

    def vote(self, placed: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Scores from exact cosines with all labelled vectors."""
        if not len(self.labels):
            return np.full(len(placed), self.prior)
        k = min(neighbours, len(self.labels))
        cosines = np.round(placed @ self.vectors.T, 6)
        # the k greatest; equal ones by place
        edge = -np.partition(-cosines, k - 1, axis=1)[:, k - 1:k]
        above, level = cosines > edge, cosines == edge
        room = k - above.sum(1, keepdims=True)
        chosen = above | (level & (np.cumsum(level, axis=1) <= room))
        weight = np.where(chosen, np.maximum(cosines, 0), 0).astype(np.float64)
        total = weight.sum(1)
        return np.where(total > 0, (weight @ self.labels) / np.maximum(total, 1e-12), self.prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows, chosen and ordered by hash of the key."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropna().distinct()
    # hashes are uniform, so the first ``most`` by hash are an even sample
    chosen = known.orderBy(F.xxhash64("k"), "k", "y").limit(most)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = filled(batch.column(2))
            for low, high in slices(whole):
                counts, rows = features(whole.slice(low, high - low)), batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], rows.column(3),
                     pa.array([row.tobytes() for row in counts], pa.binary())], ["k", "y", "h", "counts"])

    made = map_batches(
        texts.select("k", "y", "t", F.xxhash64("t").alias("h")), run, T.StructType([*texts.select("k", "y").schema.fields, T.StructField("h", T.LongType()),
                           T.StructField("counts", T.BinaryType())]))
    rows = made.orderBy(F.xxhash64("k"), "k", "y", "h").limit(most).select("y", "counts").collect()
    y = np.array([float(r["y"] > 0) for r in rows])
    return np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32), y


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        most: int = MAX_LABELLED) -> Model:
    """Fit on at most ``most`` labelled rows. Only the rows given are looked at."""
    counts, y = labelled_sample(docs, labels, key, text, label, most)
    if not len(y):
        flat = np.ones(FEATURES, np.float32)
        return Model(flat, flat, np.zeros((FEATURES + 2 * LEVELS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    halves = counts.reshape(len(y), 2, -1)
    expected = (halves / np.maximum(halves.sum(2, keepdims=True), 1)).mean(0).ravel()
    weights = np.log1p(len(y) / (1 + (counts > 0).sum(0))).astype(np.float32)
    model = Model(expected, weights, np.zeros((0, 0)), np.zeros((0, 0)), y, float(y.mean()))
    model.directions = leading_directions(model.described(counts), min(DIMENSIONS, len(y), FEATURES))
    model.vectors = model.place(counts)
    return model


def leading_directions(rows: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    start = np.random.default_rng(7).standard_normal((rows.shape[1], min(n + 8, rows.shape[1]))).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T[:, :n]).astype(np.float32)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` (0 to 1) to every row."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} is there already")
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            texts = filled(batch.column(place))
            scores = [np.zeros(0)]
            for low, high in slices(texts):
                for begin in range(low, high, BLOCK):
                    part = texts.slice(begin, min(BLOCK, high - begin))
                    scores.append(model.vote(model.place(features(part))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))],
                                             [*batch.schema.names, out])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
