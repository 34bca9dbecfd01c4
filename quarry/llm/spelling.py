"""Groups of spelling variants: words that one inserted, deleted or replaced code point tells apart.

The vocabulary is sorted and scanned with the edit matrix of every query word. Adjacent words of a
sorted list share a prefix (their LCP), and so the rows of that prefix: words that agree in their
first d letters are one range of the list, which has one row d. Of a row only the three cells next
to the diagonal matter, as the others exceed one edit; where all three do, the whole range is skipped.
``scan`` goes down the ranges of all groups of a chunk together, one letter of the LCP at a time.

Which words are scanned against which: two words that are near and have at least m letters share
either the first or the last half of those m, since the one edit lies in the other half. Words are
grouped by these halves (``first`` shared in front, ``stop`` bounding the place of the edit), and a
group is scanned with its shared part skipped, backwards where the end is shared. A group with more
than ``GROUP_CHARS`` letters is dealt out again: the half with the edit is halved, and so on, until
two words can differ in one place only. So no group is large, none is cut, and each near pair is met
in one group only, that of the length of its common prefix.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.

Defined cases: null and empty texts have no words. A null key counts as the empty text. Repeated rows
count as often as they occur. Of near words with the same count the first in code-point order is the
form. Empty tables give no words. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import filled, map_batches
from quarry.session import cut

MIN_LENGTH, MIN_COUNT = 6, 5
#: A word's form occurs at least this many times as often as the word.
RATIO = 5
#: Letters of a group at most, while it can be dealt out again, and of a chunk of groups scanned at once.
GROUP_CHARS = 1 << 16
#: Different words that a task counts before it passes them on.
HELD = 1 << 17

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GROUP = ["size", "first", "stop", "shared"]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, slip: int | None = None) -> DataFrame:
    """word, n of the words with at least ``min_length`` letters and ``min_count`` occurrences.

    With ``slip`` the words of a text whose crc32 of ``key:word`` it divides lose one letter first,
    the one at that number modulo the length: misspellings of known place, to measure with.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            keys = filled(batch.column(0)).to_pylist()
            for row, body in zip(keys, batch.column(1), strict=True):
                # A-Z are single bytes of UTF-8, so the bytes can be mapped
                found = Counter(runs.findall((body.as_py() or "").encode().translate(_LOWER).decode()))
                if slip is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{row}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        word = word[:h % len(word)] + word[h % len(word) + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(key).cast("string"), F.col(text))
    return (map_batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _shared(first: Column, stop: Column) -> Column:
    """The part of a word that its group shares: ``first`` letters in front, the last ones behind."""
    behind = F.greatest(F.col("size") - stop, F.lit(0))
    return F.concat(F.substring("word", F.lit(1), first), F.lit(" "),
                    F.when(behind > 0, F.substring("word", F.char_length("word") - behind + 1, behind)).otherwise(""))


def _halves(words: DataFrame, min_length: int) -> DataFrame:
    """Each word in its groups: those of pairs whose shorter word has its length, or one letter less."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
    rows = rows.filter(F.col("size") >= min_length)
    half = F.floor(F.col("size") / 2).cast("int")
    sides = F.array(F.struct(half.alias("first"), (F.col("size") + 1).alias("stop")),
                    F.struct(F.lit(0).alias("first"), half.alias("stop")))
    rows = rows.select("*", F.explode(sides).alias("side")).select("word", "n", "size", "side.*")
    return rows.withColumn("shared", _shared(F.col("first"), F.col("stop")))


def _deal(rows: DataFrame) -> DataFrame:
    """Groups with the place of the edit halved: it is in the second half, or in the first."""
    middle = F.floor((F.col("first") + F.col("stop")) / 2).cast("int")
    sides = F.array(F.struct(middle.alias("first"), F.col("stop").alias("stop")),
                    F.struct(F.col("first").alias("first"), middle.alias("stop")))
    rows = rows.select("word", "n", "size", F.explode(sides).alias("side")).select("word", "n", "size", "side.*")
    return rows.withColumn("shared", _shared(F.col("first"), F.col("stop")))


def _groups(words: DataFrame, min_length: int, group_chars: int) -> DataFrame:
    """All words in groups of bounded size."""
    settled, rows = [], _halves(words, min_length)
    while True:
        chars = F.sum(F.char_length("word"))
        large = rows.groupBy(*_GROUP).agg(chars.alias("chars")).filter(
            (F.col("chars") > group_chars) & (F.col("stop") - F.col("first") > 1))
        large = cut(large.drop("chars"), "large-groups")
        if large.isEmpty():
            settled.append(rows)
            break
        settled.append(rows.join(large, _GROUP, "left_anti"))
        rows = cut(_deal(rows.join(large, _GROUP, "left_semi")), "dealt-groups")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


class Letters:
    """Letters of words end to end."""

    def __init__(self, words: list[str]) -> None:
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(self.size) - self.size

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Letters at these places, 0 beyond the end or before the begin."""
        inside = (place >= 0) & (place < self.size[word])
        out = np.zeros(len(word), np.uint32)
        out[inside] = self.flat[self.begin[word[inside]] + place[inside]]
        return out


def scan(letters: Letters, group: np.ndarray, begin: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of one group with exactly one edit.

    Words of a group are adjacent and sorted; ``group`` numbers them from 0 and ``begin`` has the
    length of each word's shared prefix. ``query`` marks the words to ask for.
    """
    n = len(group)
    every = np.arange(n)
    opens = np.ones(n, bool)  # where a range of words with equal letters so far begins
    opens[1:] = group[1:] != group[:-1]
    firsts = np.append(np.flatnonzero(opens), n)
    lengths = np.diff(firsts)
    asked = np.flatnonzero(query & (lengths[group] > 1))
    low, high, of = firsts[group[asked]], firsts[group[asked] + 1], asked
    cells = np.tile(np.array([[1], [0], [1]], np.int8), (1, len(asked)))
    cells[0, begin[asked] == 0] = 2
    left, right = [], []
    depth = 0
    while len(of):
        # ranges one letter further: a word that ends here is a range of its own
        letter = letters.at(every, begin + depth)
        opens[1:] |= (letter[1:] != letter[:-1]) | (letter[1:] == 0)
        starts = np.append(np.flatnonzero(opens), n)
        child = np.searchsorted(starts, low)
        many = np.searchsorted(starts, high) - child
        row = np.repeat(np.arange(len(of)), many)
        child = np.repeat(child - (np.cumsum(many) - many), many) + np.arange(len(row))
        low, high, of, cells = starts[child], starts[child + 1], of[row], cells[:, row]
        place = begin[low] + depth
        ended = letters.size[low] == place
        if ended.any():
            at = np.flatnonzero(ended)
            offset = letters.size[of[at]] - letters.size[low[at]]
            near = np.abs(offset) <= 1
            at, offset = at[near], offset[near]
            one = cells[offset + 1, at] == 1
            left.append(of[at[one]])
            right.append(low[at[one]])
            on = ~ended
            low, high, of, cells, place = low[on], high[on], of[on], cells[:, on], place[on]
        here = letter[low]
        a = np.minimum(cells[0] + (letters.at(of, place - 1) != here), cells[1] + 1)
        b = np.minimum(np.minimum(cells[1] + (letters.at(of, place) != here), cells[2] + 1), a + 1)
        c = np.minimum(cells[2] + (letters.at(of, place + 1) != here), b + 1)
        cells = np.minimum(np.stack([a, b, c]), 2).astype(np.int8)
        alive = cells.min(axis=0) <= 1
        low, high, of, cells = low[alive], high[alive], of[alive], cells[:, alive]
        depth += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _common(letters: Letters, a: np.ndarray, b: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Length of the common prefix of words a and b, which are held backwards where ``turned``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    depth = 0
    while len(open_):
        x, y, back = a[open_], b[open_], turned[open_]
        i = np.where(back, letters.size[x] - 1 - depth, depth)
        j = np.where(back, letters.size[y] - 1 - depth, depth)
        one = letters.at(x, i)
        open_ = open_[(one == letters.at(y, j)) & (one != 0)]
        out[open_] += 1
        depth += 1
    return out


def _near(chunk: pa.Table) -> pa.RecordBatch:
    """word, n_near, best_n, best of the words of whole groups that have a near word in them."""
    n = chunk.num_rows
    held = chunk["held"].to_pylist()
    size, first, stop, counts = (chunk[c].to_numpy() for c in ("size", "first", "stop", "n"))
    turned = chunk["turned"].to_numpy()
    shared = np.maximum(size - stop, 0)
    letters = Letters(held)
    query, other = scan(letters, chunk["group"].to_numpy(), np.where(turned, shared, first).astype(np.int64), letters.size == size)
    # a pair belongs to one group: that with its first difference in first .. stop
    same = _common(letters, query, other, turned[query])
    mine = (same >= first[query]) & (same < stop[query])
    # words of one length ask each other; of two lengths only the shorter one asks
    query, other = query[mine], other[mine]
    uneven = letters.size[query] != letters.size[other]
    query, other = np.concatenate([query, other[uneven]]), np.concatenate([other, query[uneven]])
    words = [w[::-1] if t else w for w, t in zip(held, turned, strict=True)]
    used = np.unique(other)
    rank = np.zeros(n, np.int64)
    rank[np.array(sorted(used, key=lambda i: words[i]), np.int64)] = np.arange(len(used))
    order = np.lexsort((rank[other], -counts[other], query))
    query, other = query[order], other[order]
    heads = np.flatnonzero(np.append(True, query[1:] != query[:-1])[:len(query)])
    near = np.diff(np.append(heads, len(query)))
    take = [words[i] for i in query[heads]], [words[i] for i in other[heads]]
    return pa.RecordBatch.from_arrays([pa.array(take[0], pa.string()), pa.array(near, pa.int64()),
                                       pa.array(counts[other[heads]], pa.int64()), pa.array(take[1], pa.string())],
                                      ["word", "n_near", "best_n", "best"])


def _scan_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into chunks of whole groups and scans those."""
    rest: pa.Table | None = None

    def chunks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        new = np.ones(table.num_rows, bool)
        changed = np.zeros(table.num_rows - 1, bool)
        for name in _GROUP:
            column = table[name].combine_chunks()
            changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = changed
        table = table.append_column("group", pa.array(np.cumsum(new) - 1))
        firsts = np.append(np.flatnonzero(new), table.num_rows)
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(table["held"]).to_numpy())])[firsts]
        at = 0
        while at < len(firsts) - 1:
            to = max(at + 1, int(np.searchsorted(chars, chars[at] + GROUP_CHARS, "right")) - 1)
            part = table.slice(firsts[at], firsts[to] - firsts[at])
            groups = part["group"].to_numpy()
            yield _near(part.set_column(part.column_names.index("group"), "group", pa.array(groups - groups[0])))
            at = to

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        last = table.slice(table.num_rows - 1)
        same = np.ones(table.num_rows, bool)
        for name in _GROUP:
            same &= pc.equal(table[name], last[name][0]).to_numpy()
        begin = table.num_rows - int(same.sum())  # the last group may go on in the next batch
        yield from chunks(table.slice(0, begin))
        rest = table.slice(begin)
    if rest is not None:
        yield from chunks(rest)


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, n_near, best_n and best (the near word of largest n, then the first) of the words of
    ``words`` (word, n; each word once) that have a near one. Words shorter than ``min_length`` are left out."""
    rows = _groups(words.filter(F.char_length("word") >= min_length), min_length, group_chars)
    turned = F.col("first") < F.col("size") - F.col("stop")
    rows = rows.select(*_GROUP, F.when(turned, F.reverse("word")).otherwise(F.col("word")).alias("held"), "n", turned.alias("turned"))
    rows = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "held")
    found = map_batches(rows, _scan_groups, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
            .select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best")))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root of the words of ``forms`` (word, form): forms are followed to the last one, at most
    2 ** ``steps`` of them. Each step doubles the way."""
    rows = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        rows = cut(rows, "roots")
        further = rows.select(F.col("word").alias("via"), F.col("root").alias("end"))
        rows = rows.join(further, rows["root"] == further["via"], "left").select(
            "word", F.coalesce("end", "root").alias("root"))
    return rows


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None, ratio: int = RATIO,
             group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word that ``word_counts`` gives.

    The form is the near word of largest n, if that is at least ``ratio`` (2 or more) times the word's.
    """
    words = cut(word_counts(docs, key, text, slip=slip), "words")
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = cut(words.join(near_words(words, group_chars=group_chars), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    # a way's counts grow by the ratio at each form, which bounds its length
    most = words.agg(F.max("n")).first()[0] or 1
    way = max(1, math.floor(math.log(max(most, 1), ratio)) + 1)
    ends = roots(rows.filter(F.col("form").isNotNull()), math.ceil(math.log2(way)))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
