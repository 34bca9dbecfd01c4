"""Language by compression: the language whose text helps most to compress a text.

``fit`` gathers, for each language, raw text of a bounded sample as a zstandard dictionary.
``predict`` compresses every whole text with each dictionary and takes the smallest; a text is
compressed in pieces of ``PIECE`` bytes, so the dictionary stays in reach over all of a long text.
Narrow margins are rejected: ``accepted`` says whether the next best is at least ``MARGIN`` larger.

Letters are lower-cased and everything between words is one space, in dictionaries and texts, so
that signs and capitals don't hide words.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and not accepted. Without
training rows every text is ``und``. Ties go to the language that sorts first. Rows with a null
language or text teach nothing. Repeated rows are predicted each. Columns of the input stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import map_batches
from quarry.operators.skew import topk


#: Different training texts of a language, at most; the first by hash.
SAMPLE_ROWS = 400
#: Bytes of a dictionary, at most.
DICTIONARY = 110 << 10
#: A sampled training text is carried to the driver as this many windows of so many characters, spread
#: evenly over all of it; shorter texts are carried whole. Predictions use whole texts.
WINDOWS, WINDOW_CHARS = 16, 512
PIECE = 4096
LEVEL = 9
#: Shortest repetition that is looked for: endings and function words are short.
MIN_MATCH = 3
#: Next best size over best size, less 1.
MARGIN = 0.02
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters, words one space apart."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def windows(text: Column, n: int = WINDOWS, chars: int = WINDOW_CHARS) -> Column:
    """The text, or, of a longer one, ``n`` windows from its begin to its end."""
    rest = F.char_length(text) - chars
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(
        text, F.floor(rest * i / (n - 1)).cast("int") + 1, F.lit(chars)))
    return F.when(F.char_length(text) > n * chars, F.array_join(places, " ")).otherwise(text)


def spread(data: bytes, size: int) -> bytes:
    """``size`` bytes of ``data`` at most: whole words from places spread evenly over it."""
    if len(data) <= size:
        return data
    n = max(1, size // WINDOW_CHARS)
    step, width = len(data) / n, size // n
    parts = [data[int(i * step):int(i * step) + width] for i in range(n)]
    # the words that a window cuts go
    return b" ".join(p.partition(b" ")[2].rpartition(b" ")[0] or p for p in parts)[:size]


def training_sample(training: DataFrame, text: str, lang: str, rows: int) -> list[tuple[str, str]]:
    """The first ``rows`` different texts of each language, by hash."""
    known = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna().withColumn(
        "place", F.xxhash64("text"))
    # copies are one text; at most ``rows`` a language are left
    chosen = topk(known.select("lang", "place").distinct(), ["lang"], [F.asc("place")], rows,
                  spread_on="place").drop("rank")
    # small beside the texts, which stay where they are
    taken = (known.join(F.broadcast(chosen), ["lang", "place"]).groupBy("lang", "place")
             .agg(F.min(windows(F.col("text"))).alias("text")))
    return sorted((r["lang"], r["text"]) for r in taken.collect())


def fit(training: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
        size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary per language."""
    texts: dict[str, list[bytes]] = {}
    for name, value in training_sample(training, text, lang, rows):
        texts.setdefault(name, []).append(plain(value))
    out = {}
    for name, values in texts.items():
        values = [v for v in values if v]
        each = max(64, size // max(1, len(values)))
        # long texts give what short ones leave
        spare, parts = size, []
        for i, v in enumerate(sorted(values, key=len)):
            part = spread(v, min(max(each, spare // (len(values) - i)), spare))
            parts.append(part)
            spare -= len(part)
        if parts:
            out[name] = b" ".join(parts)
    return out


class Languages:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH)
        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        data = plain(text)
        sizes = np.array(self.sizes(data or text.encode()), np.float64)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        margin = np.partition(sizes, 1)[1] / sizes[best] - 1
        # the share of the best when sizes count as evidence
        weight = np.exp(-(sizes / sizes[best] - 1) * 20)
        return self.names[best], float(1 / weight.sum()), bool(margin >= MARGIN)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
            out: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """Adds the language, its score (0 to 1) and whether the margin is wide enough to every row."""
    clash = {c.lower() for c in out} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Languages(shared.value)
        for batch in batches:
            found = [judge(value.as_py()) for value in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                [*batch.schema.names, *out])

    return map_batches(docs, run, T.StructType([
        *docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()),
        T.StructField(out[2], T.BooleanType())]))
