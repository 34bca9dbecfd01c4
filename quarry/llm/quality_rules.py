"""Quality rules as a short-circuit cascade.

A rule says whether it rejects a text, from counts that are made when first asked for and shared by
later rules. ``estimate`` runs every rule on a sample and measures seconds and rejections;
``cascade_order`` puts the rules with most rejections per second first; ``cascade`` asks the rules in
that order and stops at the first that rejects. The order changes the time, never the verdict.

Defined cases: a null or empty text, or one without words, has all counts 0 and is rejected by
``few_words``. Repeated rows are judged each. An empty sample leaves the rules in their given order.
Columns of the input stay as they are; a new column that is there already is an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import WORD_BREAKS, filled, map_batches

SYMBOLS = b"#*$%&|<>"
#: Rows of the sample, at most about this many; only the order of the rules depends on it.
SAMPLE_ROWS = 2000


class Text:
    """Counts of one text, each made once."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self._made: dict[str, object] = {}

    def __getattr__(self, name: str):
        make = COUNTS.get(name)
        if make is None:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = make(self)
        return self._made[name]


def _without(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))


def _dup_lines(text: Text) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and their bytes."""
    seen, n, size = set(), 0, 0
    for line in text.data.split(b"\n"):
        if line.strip(WORD_BREAKS):
            if line in seen:
                n, size = n + 1, size + len(line)
            seen.add(line)
    return n, size


def _repeat_words(text: Text) -> int:
    """Words in windows of three that occur twice or more."""
    words = text.words
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base = len(numbers)
    two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(two[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


_CONTINUATION = bytes(range(0x80, 0xC0))
_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_UPPER = bytes(range(65, 91))
_NOT_ASCII = bytes(range(0x80, 0x100))

#: How each count is made from the text.
COUNTS: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.data.split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.data.translate(None, WORD_BREAKS + _CONTINUATION)),
    "n_symbols": lambda t: _without(t.data, SYMBOLS),
    "dup_lines": _dup_lines,
    "n_dup_lines": lambda t: t.dup_lines[0],
    "dup_line_bytes": lambda t: t.dup_lines[1],
    "n_repeat_words": _repeat_words,
    # a word without a letter: nothing is left of it but digits and signs
    "n_bare_words": lambda t: sum(1 for w in t.words if len(w.translate(None, _ASCII_LETTERS + _NOT_ASCII)) == len(w)),
    "n_upper": lambda t: _without(t.data, _UPPER),
    "n_letters": lambda t: _without(t.data, _ASCII_LETTERS),
}

Rule = tuple[str, Callable[[Text], bool]]

#: The rules that make a text fail whatever the others say.
BASE_RULES: list[Rule] = [
    ("few_words", lambda t: t.n_words < 50),
    ("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
]
#: The others, in the manner of published web-corpus filters.
MORE_RULES: list[Rule] = [
    ("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    ("duplicate_lines", lambda t: 100 * t.dup_line_bytes > 30 * len(t.data)),
    ("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words),
    ("bare_words", lambda t: 100 * t.n_bare_words > 20 * t.n_words),
    ("upper_case", lambda t: 100 * t.n_upper > 40 * t.n_letters),
]
RULES = BASE_RULES + MORE_RULES


def _bytes(batch: pa.RecordBatch, place: int) -> Iterator[bytes]:
    for value in filled(batch.column(place)).cast(pa.large_binary()):
        yield value.as_py()


def estimate(docs: DataFrame, rules: Sequence[Rule] = tuple(RULES), text: str = "text",
             rows: int = SAMPLE_ROWS) -> DataFrame:
    """rule, n, rejected, seconds: every rule alone on a sample of the texts."""
    n = docs.count()
    sample = docs.select(text).sample(min(1.0, rows / n) if n else 1.0, seed=42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rejected, seconds = 0, [0] * len(rules), [0.0] * len(rules)
        for batch in batches:
            for data in _bytes(batch, 0):
                seen += 1
                for i, (_, rejects) in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += bool(rejects(Text(data)))
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array([name for name, _ in rules]), pa.array([seen] * len(rules), pa.int64()),
             pa.array(rejected, pa.int64()), pa.array(seconds)], ["rule", "n", "rejected", "seconds"])

    each = map_batches(sample, run, "rule string, n long, rejected long, seconds double")
    return each.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("n", "rejected", "seconds")))


def cascade_order(estimates: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> list[Rule]:
    """Rules by rejections per second, most first; ties stay in the given order."""
    worth = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in estimates.collect()}
    return sorted(rules, key=lambda rule: -worth.get(rule[0], 0.0))


def cascade(docs: DataFrame, order: Sequence[Rule], text: str = "text", kept: str = "kept",
            counts: Sequence[str] = ()) -> DataFrame:
    """Adds ``kept`` and the asked-for ``counts`` (long) to every row."""
    added = [*counts, kept]
    clash = {c.lower() for c in added} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    order, counts = list(order), list(counts)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, numbers = [], []
            for data in _bytes(batch, place):
                one = Text(data)
                verdicts.append(not any(rejects(one) for _, rejects in order))
                numbers.append([getattr(one, c) for c in counts])
            columns = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(verdicts, pa.bool_())],
                                             [*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts),
                           T.StructField(kept, T.BooleanType())])
    return map_batches(docs, run, schema)
