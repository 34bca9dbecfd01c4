"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library works on characters, so each byte stands for one printable character (``byte_table``).
``rank_tokenizer`` rebuilds merges from a rank file; ``Encoder`` runs a tokenizer over batches;
``encode`` and ``decode`` are the DataFrame operators.

Text is cut into pieces for a whole batch at once, by class of character, where the split pattern
would cut it; the library merges each different piece once per task (again after its table of pieces was
full and emptied), and its ids are then laid out for every place of that piece. Memory: one slice of text
and that table. The tokenizer is broadcast as an object, which a Python worker loads once.

Defined cases: a null or empty text has no ids and decodes to the empty text. A null list of ids
decodes to null; a list with a null or an unknown id does too. Bytes that are no UTF-8 by themselves
(an id list cut inside a character) are kept as bytes and shown as U+FFFD in the text. Repeated rows
give repeated results. New columns must not clash with those there (ValueError).
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import filled, gather, map_batches, slices, text_bytes

#: Bytes that stand for themselves (printable Latin-1); all others take the code
#: points from 256 on, in order of the byte.
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
#: Fixed value: the split pattern of this vocabulary family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces kept in a task before its table is emptied.
KEPT_PIECES = 1 << 18
#: Text bytes that are cut and numbered at once (or one row).
TEXT_BYTES = 1 << 20
#: Pieces that the library gets as the words of one text.
JOINED_PIECES = 64

LETTER, NUMBER, SPACE, OTHER, STOP = range(5)


def byte_table() -> list[str]:
    """The character that stands for each byte."""
    plain = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


@lru_cache(1)
def character_classes() -> bytes:
    """Letter, number, white space or other, for every code point, as the library's patterns see it."""
    from tokenizers import Regex, pre_tokenizers

    classes = np.full(0x110000, OTHER, np.uint8)
    # surrogates never occur in UTF-8 text
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        rest = pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every)
        found = np.ones(0x110000, bool)
        found[0xD800:0xE000] = False
        found[np.frombuffer("".join(x for x, _ in rest).encode("utf-32-le"), np.uint32)] = False
        classes[found] = value
    return classes.tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merges_from_ranks(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each longer token, in order of rank: what is left of the token's own bytes
    when only earlier tokens may be merged."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            places = [ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)]
            best = min(range(len(places)), key=places.__getitem__)
            if places[best] >= rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


def rank_tokenizer(ranks: dict[bytes, int]) -> str:
    """The tokenizer of a rank file, as the library's JSON. A piece that is a token is that token."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_table()
    shown = lambda token: "".join(table[b] for b in token)
    model = models.BPE(vocab={shown(t): r for t, r in ranks.items()},
                       merges=[(shown(a), shown(b)) for a, b in merges_from_ranks(ranks)],
                       ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(SPLIT), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer.to_str()


def _pieces_only(spec: dict) -> dict | None:
    """The tokenizer for pieces as words of the characters that stand for their bytes, if it splits text
    by ``SPLIT`` and changes nothing else; None if it does more, so that whole texts must go through it."""
    if spec.get("normalizer") or spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
        return None
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return None
    before = spec.get("pre_tokenizer") or {}
    by_bytes = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    steps = before.get("pretokenizers", [])
    by_pattern = (len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT}
                  and steps[0].get("behavior") == "Isolated" and not steps[0].get("invert")
                  and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex")
                  and not steps[1].get("add_prefix_space"))
    if not (by_bytes or by_pattern):
        return None
    model = spec["model"]
    if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not set(byte_table()) <= set(model["vocab"]):
        return None  # ids would not hold the bytes of a piece one after the other
    return spec | {"added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}


def loaded(tokenizer_json: str, added: bool = False) -> tuple:
    """What an ``Encoder`` needs of a tokenizer: the library's object, the bytes of each id (None if whole
    texts go through the library) and the added tokens to look for. To be broadcast: a Python worker
    keeps it for all its tasks."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    single, marks = _pieces_only(spec), (spec.get("added_tokens") or []) if added else []
    if (any(m.get(x) for m in marks for x in ("single_word", "lstrip", "rstrip"))
            or len({m.get("normalized") for m in marks}) > 1):
        single = None  # these depend on what stands around them: whole texts go through the library
    if not single:
        return Tokenizer.from_str(tokenizer_json), None, {}
    vocab = single["model"]["vocab"]
    widths = np.zeros(max(vocab.values()) + 1, np.int64)
    widths[list(vocab.values())] = [len(token) for token in vocab]
    return Tokenizer.from_str(json.dumps(single)), widths, {m["content"]: m["id"] for m in marks if m["content"]}


class Encoder:
    """A tokenizer (its JSON, or ``loaded`` from it) over lists of whole texts. Strings of special tokens are ordinary text;
    with ``added``, strings of added tokens are those tokens, as in a plain call of the library."""

    def __init__(self, tokenizer: str | tuple, classes: bytes, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.widths, self.marks = loaded(tokenizer, added) if isinstance(tokenizer, str) else tokenizer
        self.by_pieces = self.widths is not None
        self.tokenizer.encode_special_tokens = not added  # not kept when the tokenizer is sent
        longest_first = sorted(self.marks, key=len, reverse=True)
        self.at_marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.classes = np.frombuffer(classes, np.uint8)
        self.shown = np.array([ord(c) for c in byte_table()], np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = defaultdict(count().__next__)  # pieces, numbered as they come
        self.flat = np.zeros(0, np.int32)  # their ids
        self.edges = np.zeros(1, np.int64)  # and the bounds between them

    def _learn(self, pieces: pa.Array) -> None:
        """Ids of pieces that this task has not met. No piece in its characters for bytes has white space,
        so many are words of one text; the bytes of the ids tell where a piece ends."""
        data, bounds = text_bytes(pieces)
        words = np.insert(self.shown[data], bounds[1:-1], 0x20).tobytes().decode("utf-32-le")
        cuts = [*(bounds[:-1] + np.arange(len(pieces)))[::JOINED_PIECES].tolist(), len(words)]
        found = self.tokenizer.encode_batch_fast(
            [words[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        ends = np.searchsorted(np.cumsum(self.widths[ids]), bounds[1:]) + 1
        self.edges = np.concatenate([self.edges, len(self.flat) + ends])
        self.flat = np.concatenate([self.flat, ids])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        if not self.by_pieces:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes
        marked = [any(m in t for m in self.marks) for t in texts] if self.marks else [False]
        if not any(marked):
            return self._by_pieces(texts)
        # what stands between added tokens is a text of its own
        split = [self.at_marks.split(t) if m else [t] for t, m in zip(texts, marked)]
        parts = [p for s in split for p in s[::2]]
        flat, sizes = self._by_pieces(parts)
        last = np.cumsum([len(s) // 2 + 1 for s in split]) - 1  # the part that ends each text
        before_mark = np.ones(len(parts), bool)
        before_mark[last] = False
        ids = [self.marks[m] for s in split for m in s[1::2]]
        flat = np.insert(flat, np.cumsum(sizes)[before_mark], ids)
        upto = np.cumsum(sizes + before_mark)[last]
        return flat, np.diff(upto, prepend=0)

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        edges, is_stop = piece_edges(points, stops, self.classes)
        # the spans between edges as an Arrow array over the text in UTF-8, numbered by their content
        spans = pa.LargeStringArray.from_buffers(
            len(is_stop), pa.py_buffer(byte_places(points, edges)), pa.py_buffer(joined.encode())).dictionary_encode()
        pieces = spans.dictionary
        if len(self.slots) + len(pieces) > KEPT_PIECES:
            self._forget()
        known = len(self.slots)
        of = np.fromiter(map(self.slots.__getitem__, pieces.to_numpy(zero_copy_only=False)), np.int64, len(pieces))
        if len(self.slots) > known:
            self._learn(pieces.filter(pa.array(of >= known)))
        slot = of[spans.indices.to_numpy()]
        begins = self.edges[slot]
        sizes = np.where(is_stop, 0, self.edges[slot + 1] - begins)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.flatnonzero(is_stop)]
        return gather(self.flat, begins, sizes), np.diff(upto, prepend=0)


def byte_places(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in a text (ascending, the end last) in bytes of UTF-8 instead of characters."""
    wide = np.flatnonzero(points >= 0x80)
    more = 1 + (points[wide] >= 0x800) + (points[wide] >= 0x10000)
    passed = np.bincount(np.searchsorted(places, wide, "right"), more, len(places))
    return places + np.cumsum(passed).astype(np.int64)


def piece_edges(points: np.ndarray, stops: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches of ``SPLIT`` begin in texts laid end to end, each closed by one stop, and the end;
    and which of these spans are stops.

    Runs of one class are pieces. Of white space before something else the last character stands
    apart; a space there opens the next piece. An apostrophe that opens a piece takes s, t, m, d, re,
    ve or ll with it.
    """
    kind = classes[points]
    kind[stops] = STOP
    opens = np.ones(len(kind), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[stops] = True
    following = np.full(len(kind), STOP, np.uint8)
    following[:-1] = kind[1:]
    last = np.flatnonzero((kind == SPACE) & (following != SPACE) & (following != STOP))
    opens[last] = True
    opens[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & opens & (following == LETTER))
    if len(quote):
        one = points[quote + 1]
        two = np.where(kind[np.minimum(quote + 2, len(kind) - 1)] == LETTER,
                       points[np.minimum(quote + 2, len(kind) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        opens[quote[short | long] + 1] = False
        opens[quote[short] + 2] = True
        opens[quote[long] + 3] = True
    edges = np.flatnonzero(opens)
    return np.append(edges, len(points)), kind[edges] == STOP


def token_bytes(tokenizer_json: str) -> list[bytes | None]:
    """The bytes of every id: the byte table read backwards. Added tokens stand for their own text."""
    spec = json.loads(tokenizer_json)
    back = {c: b for b, c in enumerate(byte_table())}
    vocab = spec["model"]["vocab"]
    size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])], default=-1)
    out: list[bytes | None] = [None] * size
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    for added in spec["added_tokens"]:
        out[added["id"]] = added["content"].encode()
    return out


def id_offsets(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where ids begin and end in a text, in characters, from the number of bytes of each id.

    An id that holds part of a character covers that character; the third value counts the ids that
    begin inside one.
    """
    head = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(head)])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    inside = (begins < len(head)) & ~np.concatenate([head, [True]])[begins]
    return upto[begins] - inside, upto[ends], int(inside.sum())


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids",
           offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>) and, if wanted, ``<ids>_begin`` and ``<ids>_end`` (array<int>, places
    in characters of the text) to every row."""
    added = [ids, f"{ids}_begin", f"{ids}_end"] if offsets else [ids]
    clash = {c.lower() for c in added} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    classes = character_classes()
    widths = np.array([len(b or b"") for b in token_bytes(tokenizer_json)], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((loaded(tokenizer_json), classes, widths))
    place = docs.columns.index(text)
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table, widths = shared.value
        encoder = Encoder(tokenizer, table)
        for batch in batches:
            whole = filled(batch.column(place))
            for low, high in slices(whole, TEXT_BYTES):
                part = whole.slice(low, high - low)
                flat, sizes = encoder(part.to_pylist())
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                columns = [pa.ListArray.from_arrays(bounds, pa.array(flat, pa.int32()))]
                if offsets:
                    edge = np.concatenate([[0], np.cumsum(sizes)])
                    spans = [id_offsets(t.encode(), widths[flat[edge[i]:edge[i + 1]]])
                             for i, t in enumerate(part.to_pylist())]
                    for k in (0, 1):
                        values = np.concatenate([s[k] for s in spans]) if spans else np.zeros(0)
                        columns.append(pa.ListArray.from_arrays(bounds, pa.array(values.astype(np.int32))))
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in added)])
    return map_batches(docs, run, schema)


def joined_bytes(of_id: list[bytes | None], ids: list[int | None] | None) -> bytes | None:
    if ids is None or any(i is None or not 0 <= i < len(of_id) or of_id[i] is None for i in ids):
        return None
    return b"".join([of_id[i] for i in ids])


def decode(rows: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``<out>_bytes`` (binary, exact) and ``<out>`` (text) to every row with ids."""
    clash = {out.lower(), f"{out}_bytes".lower()} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    shared = rows.sparkSession.sparkContext.broadcast(token_bytes(tokenizer_json))
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                data = [joined_bytes(of_id, x) for x in part.column(place).to_pylist()]
                texts = [None if d is None else d.decode("utf-8", "replace") for d in data]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(data, pa.binary()), pa.array(texts, pa.string())],
                    [*part.schema.names, f"{out}_bytes", out])

    schema = T.StructType([*rows.schema.fields, T.StructField(f"{out}_bytes", T.BinaryType()),
                           T.StructField(out, T.StringType())])
    return map_batches(rows, run, schema)
