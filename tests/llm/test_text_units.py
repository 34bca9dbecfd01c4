"""Spelling variants, exact dedup and fill-in-middle against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import exact_dedup, fill_in_middle, spelling
from quarry.llm.common import BATCH_BYTES

DOCS = "doc_id long, text string, n long, Kept string"
RNG = random.Random(11)
LINES = "\n".join(RNG.choice(["", "a", "über <P", "日本語 😀", "x" * 40]) for _ in range(60_000))
ODD = [None, "", " ", "\n", "\n\n\n", "one line", "two\nlines", "two\nlines\n", "a <P> b\n", "<S>", "x<M>y", "Ünï code\n😀😀\nend",
       "\r\nCR\r\n", "THE End", "the end", "The END", "ÀB×", "àb×", LINES, LINES + "\n", "x" * (BATCH_BYTES + 7), "\0"]
ROWS = [(i, t, 1, "k") for i, t in enumerate(ODD)] + [(3, "\n", 1, "k"), (None, "the end", 1, "k"), (None, None, None, None),
                                                     (None, "only", None, None), (None, "only", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11: spelling variants

def _one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _counted(rows, slip, least=6, often=5):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def _variants(n):
    out, forms = [], {}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if _one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            forms[w] = best
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n[w], len(near[w]), forms.get(w), n[forms[w]] if w in forms else None, root))
    return sorted(out)


def _typed(rng, word):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice("abcé÷ÿ") + word[i:], word[:i] + word[i + 1:], word[:i] + rng.choice("abcé") + word[i + 1:]])


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 7, 7, 8, 12]))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "a" * 400, "a" * 401, "b" + "a" * 400]
    words = []
    for w in base:
        typed = _typed(rng, w)
        words += [w] * rng.choice([5, 30, 200, 1500]) + [typed] * rng.choice([1, 5, 70]) + [_typed(rng, typed)] * 7
    rng.shuffle(words)
    rows = [(i, " ".join(rng.choice([w, w, w.capitalize()]) for w in words[i::50])) for i in range(49)] + [
        (None, " ".join(words[49::50])), (50, None), (51, ""), (52, "1 2 _ ."), (7, "ABABAB_ababab"), (7, "ABABAB_ababab")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _variants(_counted(rows, 31))
    assert sum(r[2] for r in want) > 100 and any(r[5] not in (r[0], r[3]) for r in want)
    for chars in (spelling.GROUP_CHARS, 60):  # 60: nearly all groups are dealt out again
        got = spelling.variants(df, slip=31, group_chars=chars).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_hot_prefix_is_dealt_out(spark, monkeypatch):
    rng = random.Random(4)
    n = {"constant" + "".join(rng.choice("ab") for _ in range(8)): rng.choice([5, 9, 50]) for _ in range(150)}
    n.update({w + "a": 7 for w in list(n)[:40]})
    monkeypatch.setattr(spelling, "GROUP_CHARS", 300)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    sizes = spelling._groups(words, 6, 300).groupBy(*spelling._GROUP).count().collect()
    assert max(r["count"] * (r["size"] + 1) for r in sizes if r["stop"] - r["first"] > 1) <= 300 + 40
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(words, group_chars=300).collect()}
    want = {}
    for w in n:
        near = [x for x in n if _one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), best, n[best])
    assert got == want


def test_forms_are_followed_to_the_last(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string"), 4).collect()}
    assert set(got.values()) == {"w13"} and len(got) == 14


def test_variants_of_odd_tables(spark, docs, empty):
    assert spelling.variants(empty).count() == 0 and spelling.variants(docs.limit(1), slip=199).count() == 0
    got = {r.word: r.n for r in spelling.word_counts(docs, min_length=1, min_count=1).collect()}
    assert got == _counted([r[:2] for r in ROWS], None, 1, 1)


# --- 12: exact dedup

def _code(text):
    return hashlib.sha256(re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()).hexdigest()


def _marked(rows):
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[_code(text)].append(key)
    out = []
    for key, text in rows:
        of = groups[_code(text)]
        keep = max((k for k in of if k is not None), default=None)
        out.append((key, keep, len(of), key == keep, _code(text)))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("most", [exact_dedup.FILTER_WORDS, 64])
def test_marks_equal_texts(spark, docs, empty, most):
    got = exact_dedup.mark(docs, most=most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert _sorted(map(tuple, got.collect())) == _sorted(_marked([r[:2] for r in ROWS]))
    assert exact_dedup.mark(empty).count() == 0 and exact_dedup.keep_last(empty).count() == 0
    rows = [(i, "hot" if i % 3 == 0 else f"Text {i % 2500}".upper() if i % 2 else f"text {i % 2500}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _sorted(map(tuple, exact_dedup.mark(df, most=most).collect())) == _sorted(_marked(rows))


def test_keeps_whole_rows(spark, docs):
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    first = {}
    for row in sorted(ROWS, key=lambda r: r[1] or ""):
        first.setdefault((row[0], _code(row[1])), row)
    marked = {(k, c) for k, _, _, on, c in _marked([r[:2] for r in ROWS]) if on}
    assert sorted(str((r[0], r[2], r[3], _code(r[1]))) for r in kept.collect()) == sorted(
        str((r[0], r[2], r[3], c)) for (_, c), r in first.items() if (r[0], c) in marked)


def test_unique_rows_are_not_shuffled(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(i, "twice") for i in range(4000, 4040)]
    codes = exact_dedup._digests(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    probed = exact_dedup.maybe_repeated(codes, "code", exact_dedup.second_filter(codes, "code", len(rows)), "maybe")
    flagged = probed.filter("maybe").count()
    assert 40 <= flagged < 40 + 4000 * 0.02
    assert "hashpartitioning" not in probed._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


# --- 13: fill-in-middle

def _cut(key, text, unit):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    code = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(code[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("block", [1, 16, fill_in_middle.BLOCK])
def test_cuts_and_restores(spark, docs, unit, block):
    if block == 1:  # a tree over single bytes, on the shorter texts
        docs = docs.filter("coalesce(length(text), 0) < 100")
    from pyspark.sql import functions as F

    made = fill_in_middle.transform(docs, unit=unit, block=block)
    assert made.columns == [*docs.columns, "_n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("whole", fill_in_middle.restore(F.col("form"), F.col("output"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r._n, r.form, r.prefix_chars, r.middle_chars, r.output) == _cut(r.doc_id, r.text, unit)
        assert r.whole == (r.text or "")


def test_rates_and_empty_tables(spark, docs, empty):
    assert fill_in_middle.transform(empty).count() == 0
    assert {r.form for r in fill_in_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.transform(docs, spm=100).collect()} == {"plain", "spm"}
    with pytest.raises(Exception, match="unknown unit"):
        fill_in_middle.transform(docs, unit="word").collect()


def test_trees_hold_running_totals():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 90, 40)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.choice(np.array([10, 97, 0xC3, 0xA9], np.uint8), bounds[-1])
    leads = (data & 0xC0) != 0x80
    ends = fill_in_middle.unit_ends(data, bounds, leads, "line")
    forest = fill_in_middle.Forest(ends, leads, bounds, 7)
    n, chars = forest.totals()
    for t in range(40):
        here = slice(bounds[t], bounds[t + 1])
        assert (n[t], chars[t]) == (ends[here].sum(), leads[here].sum())
        wanted = np.arange(n[t] + 1)
        place, before = forest.find(np.full(len(wanted), t), wanted, leads)
        assert place.tolist() == [0, *(np.flatnonzero(ends[here]) + 1)]
        assert before.tolist() == [int(leads[here][:p].sum()) for p in place]
