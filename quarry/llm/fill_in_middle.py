"""Fill-in-middle examples: a text is cut into prefix, middle and suffix at ends of its units.

A text is read as fixed blocks of ``BLOCK`` bytes. A Fenwick tree per text holds, for its blocks, how
many units end and how many code points begin in each. A cut after u units is found by binary lifting:
from the tree's top, steps that leave fewer than u ends behind are taken, which gives the block of the
u-th end and, on the way, the code points before it; the end itself is then looked up in that one
block. The trees of all texts of an Arrow batch lie end to end, so building and descent are a few
array operations per level for the whole batch.

Units are lines (with their line feed; the last may have none) or single code points. Both cuts are
uniform over the n + 1 places between units; they, the choice to leave a text plain, and the order of
the parts come from the sha256 of ``seed:key``, so they do not depend on partitions or on retries.

Defined cases: null counts as the empty text. Empty texts, texts that contain one of the marks, and
the share 100 - ``rate`` stay plain: output is the text, lengths are null. A null key counts as the
empty text. Repeated rows give repeated results. Empty tables give empty results. Result columns whose
name the input has (whatever its case) get underscores in front, see ``free_name``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import filled, free_name, map_batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block.
BLOCK = 1024
#: Result columns of ``transform``.
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


class Forest:
    """Fenwick trees over the blocks of several texts, end to end.

    ``ends`` marks the last byte of every unit, ``leads`` the first byte of every code point. Text t
    has the blocks ``first[t] .. first[t] + size[t]``; its tree's node i (from 1) lies at
    ``first[t] + i - 1``.
    """

    def __init__(self, ends: np.ndarray, leads: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> None:
        self.ends, self.bounds, self.block = ends, bounds, block
        self.size = -(-np.diff(bounds) // block)
        self.first = np.cumsum(self.size) - self.size
        total = int(self.size.sum())
        home = np.repeat(np.arange(len(self.size)), self.size)
        inside = np.arange(total) - self.first[home]
        self.begins = bounds[home] + inside * block
        if total:
            self.units = np.add.reduceat(ends.astype(np.int64), self.begins)
            self.chars = np.add.reduceat(leads.astype(np.int64), self.begins)
        else:
            self.units = self.chars = np.zeros(0, np.int64)
        node, limit = inside + 1, self.size[home]
        step = 1
        while step <= (int(self.size.max()) if total else 0):
            # nodes with this lowest bit are complete: add them to their parents, which differ
            child = np.flatnonzero(((node & -node) == step) & (node + step <= limit))
            self.units[child + step] += self.units[child]
            self.chars[child + step] += self.chars[child]
            step *= 2

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Units and code points of every text: the nodes of its size's bits."""
        units, chars, at = (np.zeros(len(self.size), np.int64) for _ in range(3))
        for bit in range(int(self.size.max()).bit_length() - 1, -1, -1) if len(self.size) else ():
            here = np.flatnonzero(self.size & (1 << bit))
            at[here] += 1 << bit
            node = self.first[here] + at[here] - 1
            units[here] += self.units[node]
            chars[here] += self.chars[node]
        return units, chars

    def find(self, text: np.ndarray, wanted: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place (within the text) and code points before the end of unit ``wanted`` of each
        ``text``; both 0 for unit 0."""
        at, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        left = wanted.astype(np.int64).copy()
        size, first = self.size[text], self.first[text]
        for bit in range(int(size.max()).bit_length() - 1, -1, -1) if len(text) else ():
            step = at + (1 << bit)
            node = first + np.minimum(step, np.maximum(size, 1)) - 1
            ok = (step <= size) & (wanted > 0)
            ok[ok] = self.units[node[ok]] < left[ok]
            at[ok] = step[ok]
            left[ok] -= self.units[node[ok]]
            chars[ok] += self.chars[node[ok]]
        place = np.zeros(len(text), np.int64)
        some = np.flatnonzero(wanted > 0)
        rows = max(1, (1 << 22) // self.block)  # blocks looked into at once
        for low in range(0, len(some), rows):
            part = some[low:low + rows]
            begin = self.begins[first[part] + at[part]]
            length = np.minimum(self.bounds[text[part] + 1] - begin, self.block)
            column = np.arange(self.block)
            valid = column < length[:, None]
            byte = np.where(valid, begin[:, None] + column, begin[:, None])
            hit = np.argmax(np.cumsum(self.ends[byte] & valid, axis=1, dtype=np.int32) == left[part, None], axis=1)
            place[part] = begin + hit + 1 - self.bounds[text[part]]
            chars[part] += np.sum(leads[byte] & (column <= hit[:, None]), axis=1)
        return place, chars


def unit_ends(data: np.ndarray, bounds: np.ndarray, leads: np.ndarray, unit: str) -> np.ndarray:
    """Marks the last byte of every unit; the last byte of a text always ends one."""
    if unit == "line":
        ends = data == 10
    elif unit == "char":
        ends = np.ones(len(data), bool)
        ends[:-1] = leads[1:]
    else:
        raise ValueError(f"unknown unit {unit}")
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
    return ends


def _words(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's key."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, unit: str = "line",
              rate: int = 100, spm: int = 50, block: int = BLOCK) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` per cent of texts are cut; of these ``spm`` per cent have the suffix first.
    """
    names = []
    for name in RESULT:
        names.append(free_name([*docs.columns, *names], name))
    hidden = [free_name(docs.columns, f"__h{k}") for k in range(4)]
    rows = docs.select("*", *(w.alias(h) for w, h in zip(_words(F.col(key), seed), hidden, strict=True)))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType()),
                           T.StructField(names[2], T.LongType()), T.StructField(names[3], T.LongType()),
                           T.StructField(names[4], T.StringType())])
    at, columns = docs.columns.index(text), len(docs.columns)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(filled(batch.column(at)))
            h = [batch.column(columns + k).to_numpy(zero_copy_only=False) for k in range(4)]
            leads = (data & 0xC0) != 0x80
            forest = Forest(unit_ends(data, bounds, leads, unit), leads, bounds, block)
            n, _ = forest.totals()
            first, second = h[0] % (n + 1), h[1] % (n + 1)
            every = np.arange(batch.num_rows)
            a, a_chars = forest.find(every, np.minimum(first, second), leads)
            b, b_chars = forest.find(every, np.maximum(first, second), leads)
            raw = data.tobytes()
            forms, outputs = [], []
            for i in range(batch.num_rows):
                body = raw[bounds[i]:bounds[i + 1]]
                if not body or h[2][i] % 100 >= rate or any(m in body for m in marks):
                    forms.append("plain")
                    outputs.append(body)
                    continue
                prefix, middle, suffix = body[:a[i]], body[a[i]:b[i]], body[b[i]:]
                if h[3][i] % 100 < spm:
                    forms.append("spm")
                    outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(n), pa.array(forms, pa.string()), pa.array(a_chars, mask=plain),
                 pa.array(b_chars - a_chars, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=schema.names)

    return map_batches(rows, run, schema)


def restore(form: Column, output: Column) -> Column:
    """The text that ``transform`` made ``output`` of. Its parts hold no mark, so each mark stands once."""
    psm, spm = F.split(output, SUFFIX, 2), F.split(output, PREFIX, 2)
    tail, rest = F.split(F.get(psm, 1), MIDDLE, 2), F.split(F.get(spm, 1), MIDDLE, 2)

    def unmarked(parts: Column) -> Column:
        return F.substring(F.get(parts, 0), len(PREFIX) + 1, 2**31 - 1)

    return (F.when(form == "psm", F.concat(unmarked(psm), F.get(tail, 1), F.get(tail, 0)))
            .when(form == "spm", F.concat(F.get(rest, 0), F.get(rest, 1), unmarked(spm)))
            .otherwise(output))
