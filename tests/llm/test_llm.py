"""Operators of quarry.llm against plain Python, libraries and DuckDB, with nulls, empty and long
texts, repeated rows, empty tables and clashing column names."""

import collections
import glob
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import (byte_bpe, chat_format, common, decontaminate, language_id, lm_scoring, quality_classifier,
                        quality_rules, queries, simhash_dedup, token_output, url_filter)
from quarry.session import work_path
from test_similar import brute

SF = os.environ.get("QUARRY_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

random.seed(5)
WORDS = ["".join(random.choice("abcdeéü'’.,!") for _ in range(random.randint(1, 7))) for _ in range(300)]
LONG = " ".join(random.choice(WORDS) for _ in range(30_000))
PROSE = " ".join(random.choice(WORDS) for _ in range(120))
ODD = [None, "", " \t\n", "a", "A a", "x\u00a0y\u2003z", "'s don't we'll 'tis", "日本語 テキスト 😀👍🏽", "a  b\n\n\nc   ", LONG,
       PROSE, PROSE, PROSE + " more", "\0 nul", "THE END. " * 40]
ROWS = [(i, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(ODD)] + [
    (3, "a", "en", "s", 1), (None, PROSE, None, None, None), (None, PROSE, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.vocabulary(queries.RANKS))


@pytest.fixture(scope="module")
def rank_json(ranks):
    return byte_bpe.rank_tokenizer(ranks)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(queries.SQL[name])
    assert sorted(relation.columns) == columns
    want = [plain(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall()]
    assert ordered(plain(r[c] for c in columns) for r in df.collect()) == ordered(want)


@tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_carry_their_columns(spark, name):
    wanted = {
        "op1_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op2_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept"],
        "op5_chat_format": ["conv_id"],
        "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op7_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op8_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
        "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op10_decontaminate": ["doc_id", "item_id"],
        "op11_spelling_variants": ["word", "n", "n_near", "form", "form_n", "root"],
        "op12_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                                "restored_sha256"]}[name]
    assert queries.QUERIES[name](spark, SF).columns[:len(wanted)] == wanted


# --- 1: LM scoring

def _tokens(text):
    return (text or "").encode().lower().split() + [b"\0end"]


def test_lm_base_is_exact_and_model_is_close(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FLOOR", 1 << 9)  # most words are below level 1: the join gives their counts
    held = common.fold("doc_id", 5) == 1
    model, counts = lm_scoring.learn(docs.filter(~held))
    got = lm_scoring.score(docs, model, counts, [docs.doc_id, docs.text, held]).collect()
    c = collections.Counter(t for i, x, *_ in ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
                            for t in _tokens(x))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(ROWS)
    for r in got:
        tokens = _tokens(r.c1)
        base = sum(math.log10((c[t] + .5) / (n + .5 * (v + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0 and abs(r.score - base) < 2 * len(tokens) + 1


def test_filter_gives_levels():
    keys = common.mix(np.arange(5000, dtype=np.uint64))
    level = np.arange(5000) % 7
    found = lm_scoring.Filter.of(keys, level).level(keys)
    assert (found >= level).all() and (found > level).mean() < 0.05
    counts = np.array([1.0, 2.0, 10.0, 1000.0])
    back = lm_scoring.count_of(lm_scoring.levels(counts, 1.0), 1.0)
    assert (np.abs(np.log(back / counts)) < np.log(lm_scoring.RATIO)).all()


def test_lm_holds_rare_words_and_pairs_in_shards(spark, monkeypatch):
    texts = ["the end " * 300] * 10 + ["seldom met words stand here once"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole, counts = lm_scoring.learn(rows)
    want = {r.c0: r.score for r in lm_scoring.score(rows, whole, counts, [rows.doc_id]).collect()}
    for name, value in (("EXACT", 4), ("HOT", 4), ("SHARD_BYTES", 16), ("GROUP_TOKENS", 8)):
        monkeypatch.setattr(lm_scoring, name, value)
    model, counts = lm_scoring.learn(rows)
    assert len(model.shards) > 1
    got = {r.c0: r.score for r in lm_scoring.score(rows, model, counts, [rows.doc_id]).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    # met words after met words are far likelier than unmet ones
    unmet = spark.createDataFrame([(99, "never seen terms stay away forever")], rows.schema)
    other = lm_scoring.score(unmet, model, counts, [unmet.doc_id]).first().score
    assert got[10] > other + 6


def test_lm_without_training_texts(docs, empty):
    model, counts = lm_scoring.learn(empty)
    got = lm_scoring.score(docs, model, counts, [docs.doc_id]).collect()
    assert len(got) == len(ROWS) and all(r.score == r.base_score == r.n_known == 0 for r in got)
    model, counts = lm_scoring.learn(docs)
    assert lm_scoring.score(empty, model, counts, [empty.doc_id]).count() == 0


# --- 2: token output

def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [2 ** 64 - 1, 5, 2 ** 60], [0] * 1000, rng.integers(0, 50_257, 5000),
                   2 ** rng.integers(0, 63, 3000) + rng.integers(0, 2, 3000)):
        values = np.array(values, np.uint64)
        words, escapes, starts = token_output.pack(values)
        assert (token_output.unpack(words, escapes, len(values)) == values).all()
        assert len(starts) == len(words)
        if len(words) > 3:  # a reader can enter at any word
            at = len(words) // 2
            assert (token_output.unpack(words[at:], escapes, len(values) - int(starts[at])) == values[starts[at]:]).all()


@pytest.mark.parametrize("shard", [1 << 30, 200])
def test_written_ids_come_back(spark, docs, shard):
    from tokenizers import Tokenizer

    with open(queries.vocabulary(queries.TOKENIZER), encoding="utf-8") as f:
        spec = f.read()
    path = work_path(spark, "test-blocks")
    token_output.write(docs, spec, path, shard_bytes=shard)
    got = token_output.read_documents(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_str(spec)
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, *_ in ROWS)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    with open(queries.vocabulary(queries.TOKENIZER), encoding="utf-8") as f:
        spec = f.read()
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end} x{end}", f" {end}  \n{end} ", "<|endof text|>", f"a<|{end}|>", "", PROSE]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path = work_path(spark, "test-added")
    token_output.write(rows, spec, path)
    tokenizer = Tokenizer.from_str(spec)
    got = token_output.read_documents(spark, path).orderBy("start").collect()
    assert [list(r.ids) for r in got] == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    # texts with stripping tokens go through the library whole
    stripping = json.loads(spec)
    stripping["added_tokens"][0]["lstrip"] = True
    stripping = json.dumps(stripping)
    flat, sizes = byte_bpe.Encoder(stripping, byte_bpe.character_classes(), added=True)(texts)
    want = [Tokenizer.from_str(stripping).encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_no_documents_no_blocks(spark, empty):
    with open(queries.vocabulary(queries.TOKENIZER), encoding="utf-8") as f:
        spec = f.read()
    path = work_path(spark, "test-no-blocks")
    token_output.write(empty, spec, path)
    assert token_output.read_documents(spark, path).count() == 0


# --- 3: URL filter

def test_rules_and_hosts(spark):
    urls = [("http://a.COM/x", "a.com", "/x", "com/", "allow"), ("https://example.com/en/1?q", "example.com", "/en/1", "example.com/en/", "block"),
            ("x://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
            ("http://a.net/es/#t", "a.net", "/es/", "net/es/", "block"), ("http://x.com", "x.com", "", None, None),
            ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://b.org?x://y", "b.org", "", None, None)]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(urls)] + [(0, urls[0][0], None)], "page_id long, url string, verdict string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_models_tell_urls_apart(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.com/{word('abcde')}") for i in range(150)]
    rows += [(200 + i, f"http://{word('vwxyz')}.net/es/{word('vwxyz')}") for i in range(150)]
    rows += [(1000 + i, f"http://{word('abcde' if i % 2 else 'vwxyz')}.org/{word('abcde' if i % 2 else 'vwxyz')}") for i in range(40)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum((got[1000 + i] == "allow") == bool(i % 2) for i in range(40))
    assert right >= 38


# --- 4: quality rules

def test_counts_match_a_plain_count():
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", "|", "\x1c", "\u00a0", "A"]) for _ in range(rng.randint(0, 80)))
        words = re.findall(common.WORD, text)
        t = quality_rules.Text(text.encode())
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, x in enumerate(zip(words, words[1:], words[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(common.WORD, x)]
        assert (t.n_words, t.word_chars, t.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (t.n_repeat_words, t.n_dup_lines) == (len(covered), len(lines) - len(set(lines)))
        assert t.n_bare_words == sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", w) for w in words)


def test_order_follows_worth_and_verdicts_do_not(docs, empty):
    rules = quality_rules.RULES
    order = quality_rules.cascade_order(quality_rules.estimate(docs, rows=10), rules)
    assert {n for n, _ in order} == {n for n, _ in rules}
    verdicts = [sorted((str(r.doc_id), str(r.text), r.kept) for r in quality_rules.cascade(docs, o).collect())
                for o in (order, rules, rules[::-1])]
    assert verdicts[0] == verdicts[1] == verdicts[2]
    assert quality_rules.cascade_order(quality_rules.estimate(empty)) == rules
    assert quality_rules.cascade(empty, rules).count() == 0
    estimates = docs.sparkSession.createDataFrame([(n, 10, 5 if n == "symbols" else 1, 1.0) for n, _ in rules],
                                                  "rule string, n long, rejected long, seconds double")
    assert quality_rules.cascade_order(estimates)[0][0] == "symbols"
    with pytest.raises(ValueError):
        quality_rules.cascade(docs, rules, kept="Lang")


# --- 5: chat

def test_snapshots_collapse(spark, monkeypatch):
    turns = lambda i, *said: [(i, k, "user" if k % 2 == 0 else "assistant", s) for k, s in enumerate(said)]
    rows = (turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "b", "a", "c")
            + turns(5, "x") + turns(6, "x", None) + [(None, 0, None, "z")] + [(8, 0, "user", "q")] * 2 + turns(9, "q"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "Turn")
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat_format.render(*chat_format.collapse(df)).collect()}
    assert got == {2: (3, 2), 4: (3, 1), 6: (2, 1), None: (1, 1), 8: (2, 1)}
    parts = chat_format.render(*chat_format.collapse(df), per_row=2).filter("conv_id = 2").orderBy("part").collect()
    assert [r.text.count(chat_format.OPEN) for r in parts] == [2, 1] and "".join(r.text for r in parts).endswith("c<|im_end|>\n")
    assert chat_format.render(*chat_format.collapse(df.limit(0))).count() == 0


# --- 6: byte-level BPE

def test_ids_are_those_of_the_rank_library(ranks, rank_json):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe.SPLIT == public_tokenizers.PATTERN
    rng = random.Random(4)
    some = ["".join(rng.choice("ab'stmdrevlL  \n\t\r12³é世\u3000!.,|’😀\0") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    some += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)]
    encoder = byte_bpe.Encoder(rank_json, byte_bpe.character_classes())
    assert encoder.by_pieces
    flat, sizes = encoder(some)
    edges = np.cumsum(sizes)
    for text, low, high in zip(some, edges - sizes, edges):
        assert flat[low:high].tolist() == own.encode_ordinary(text)


def test_decoding_and_offsets(docs, empty, rank_json):
    rows = byte_bpe.decode(byte_bpe.encode(docs, rank_json, offsets=True), rank_json).collect()
    of_id = byte_bpe.token_bytes(rank_json)
    assert len(rows) == len(ROWS)
    for r in rows:
        text = r.text or ""
        assert r.decoded == text and bytes(r.decoded_bytes) == text.encode()
        for i, low, high in list(zip(r.ids, r.ids_begin, r.ids_end))[:400]:
            assert of_id[i] in text[low:high].encode()
    assert byte_bpe.encode(empty, rank_json).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, rank_json, ids="TEXT")


def test_split_characters_and_unknown_ids(spark, rank_json):
    of_id = byte_bpe.token_bytes(rank_json)
    single = {b: i for i, b in enumerate(of_id) if len(b) == 1}
    cut = [single[bytes([b])] for b in "é".encode()]
    df = spark.createDataFrame([(cut,), (cut[:1],), ([10 ** 8],), ([None],), (None,), ([],)], "ids array<int>")
    got = [(r.decoded_bytes and bytes(r.decoded_bytes), r.decoded) for r in byte_bpe.decode(df, rank_json).collect()]
    assert sorted(got, key=str) == sorted([("é".encode(), "é"), (b"\xc3", "\ufffd"), (None, None), (None, None), (None, None), (b"", "")], key=str)


# --- 7: quality classifier

@tables
def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = queries.op7_quality_classifier(spark, sf).join(common.read(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.9


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, asked = unit(rng.standard_normal((200, 8))).astype(np.float32), unit(rng.standard_normal((50, 8))).astype(np.float32)
    labels = rng.integers(0, 2, 200).astype(float)
    model = quality_classifier.Model(None, None, None, vectors, labels, 0.3)
    for one, score in zip(asked, model.vote(asked)):
        cos = np.round(vectors @ one, 6).astype(float)
        near = np.argsort(-cos, kind="stable")[:quality_classifier.NEIGHBOURS]
        w = np.maximum(cos[near], 0)
        assert score == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)
    assert model.vote(np.zeros((1, 8), np.float32)) == [0.3]


def test_classifier_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (10, 0), (10, 0), (None, 1), (11, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0


# --- 8: SimHash

def _fingerprint(text, k=4):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), seed=42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(codes, bits=4):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints():
    for text in ODD[:9] + ODD[10:]:
        assert simhash_dedup.fingerprint((text or "").encode()) == _fingerprint(text)


def _near_codes(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    codes = centres[rng.integers(0, 40, n)].copy()
    for _ in range(5):
        codes ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(codes)


@pytest.mark.parametrize("n", [1, 50, 1500])
def test_forest_has_the_groups_of_all_links(n):
    codes = _near_codes(n, n)
    a, b = simhash_dedup.forest(codes.copy())
    index = {c: i for i, c in enumerate(codes.tolist())}
    got = simhash_dedup.unite(np.arange(len(codes)), np.array([index[x] for x in a.tolist()], int), np.array([index[x] for x in b.tolist()], int))
    assert len(a) < len(codes)
    assert got.tolist() == _groups(codes)


@pytest.mark.parametrize("most", [1 << 17, 60])
def test_links_over_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "MOST", most)  # the smaller one deals buckets out again
    codes = np.concatenate([_near_codes(800, 9), np.arange(200, dtype=np.uint64)])
    codes = np.unique(codes)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash_dedup.connected(simhash_dedup.near_links(df)).collect()}
    names = [got.get(int(c), int(c)) for c in codes.view(np.int64)]
    mine, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, (a, b) in enumerate(zip(names, _groups(codes))):
        mine[a].add(i)
        want[b].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_and_the_row_that_stays(docs, empty):
    got = simhash_dedup.components(docs).collect()
    assert len(got) == len(ROWS)
    codes = np.array([_fingerprint(r[1]) for r in ROWS], np.uint64)
    groups = _groups(codes)
    least = {g: min((ROWS[i][0] for i, x in enumerate(groups) if x == g and ROWS[i][0] is not None), default=None) for g in groups}
    want = collections.Counter((ROWS[i][0], f"{int(codes[i]):016x}", least[g]) for i, g in enumerate(groups))
    assert collections.Counter(tuple(r) for r in got) == want
    clash = docs.withColumnRenamed("lang", "__row").withColumnRenamed("source", "__FP")
    kept = simhash_dedup.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in least.values())
    assert simhash_dedup.components(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0


# --- 9: language

@tables
def test_languages_of_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = queries.op9_language_id(spark, sf).join(common.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_copies_teach_once_and_crowd_nobody_out(spark):
    copies = [("en", "one text that is there very often indeed")] * 600
    others = [(lang, f"{lang} text number {i}") for lang in ("de", "en", "fr") for i in range(30)]
    rows = spark.createDataFrame(copies + others, "lang string, text string").repartition(4)
    got = language_id.training_sample(rows, "text", "lang", 20)
    per_lang = collections.Counter(lang for lang, _ in got)
    assert per_lang == {"de": 20, "en": 20, "fr": 20} and len(set(got)) == 60
    assert got == language_id.training_sample(rows.repartition(7), "text", "lang", 20)
    assert set(language_id.training_sample(rows, "text", "lang", 400)) == set(copies + others)


def test_no_letters_no_language(docs, empty):
    dictionaries = language_id.fit(docs)
    got = {r.text: r for r in language_id.predict(docs.withColumnRenamed("lang", "known"), dictionaries).collect()}
    for text in (None, "", " \t\n"):
        assert (got[text].lang_pred, got[text].score, got[text].accepted) == ("und", 0.0, False)
    assert {r.lang_pred for r in got.values()} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.fit(empty) == {} and language_id.predict(empty, dictionaries).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}


# --- 10: decontamination

def _shingles(text, k=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i:i + min(k, len(words))]) for i in range(len(words) - min(k, len(words)) + 1)} if words else set()


def test_items_inside_documents(spark, docs, empty):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    items = [(i, prose(rng.choice([1, 3, 5, 6, 12, 40, 80]))) for i in range(30)] + [(30, None), (31, ""), (5, prose(20)), (None, prose(30))]
    items += [items[0]]
    made = [(100 + i, prose(300) + " " + (items[i % 30][1] if i % 3 else " ".join(items[i % 30][1].split()[:-2])).upper() + ". " + prose(200))
            for i in range(60)] + [(160, LONG + " " + items[33][1])]
    rows = ROWS + [(i, t, None, None, 0) for i, t in made] + [(100, made[0][1], None, None, 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(df, bench).collect()}
    want = set()
    for i, text, *_ in rows:
        for j, item in items:
            wanted = _shingles(item)
            if wanted:
                size = len(next(iter(wanted)))
                found = len(wanted & _shingles(text, size)) if len(re.findall(r"[^\W_]+", (text or ""))) >= size else 0
                if found >= math.ceil(len(wanted) * 0.8 - 1e-9):
                    want.add((i, j))
    assert got == want and len(got) > 40
    clash = df.withColumnRenamed("lang", "__doc")
    clean = decontaminate.remove(clash, bench)
    hit = {i for i, _ in got}
    assert clean.columns == clash.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] not in hit)
    assert decontaminate.pairs(empty, bench).count() == 0 and decontaminate.pairs(df, bench.limit(0)).count() == 0
    assert decontaminate.remove(df, bench.limit(0)).count() == len(rows)


# --- pipeline

@tables
def test_pipeline_against_its_parts(spark, ranks):
    import public_tokenizers
    import tiktoken

    rows = {r.doc_id: r for r in common.read(spark, SF, "documents").collect()}
    kept = {r.doc_id for r in queries.op4_quality_rules(spark, SF).collect() if r.kept}
    kept &= {r.doc_id for r in queries.op7_quality_classifier(spark, SF).collect() if r.score >= 0.5}
    kept = brute([(i, rows[i].text) for i in kept])[1]  # groups by all pairs of five-word shingle sets
    items = [_shingles(r.text) for r in common.read(spark, SF, "benchmark").collect()]
    kept = {i for i in kept if not any(len(s & _shingles(rows[i].text)) >= 0.8 * len(s) - 1e-9 for s in items)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(i, len(own.encode_ordinary(rows[i].text)),
             hashlib.sha256(" ".join(map(str, own.encode_ordinary(rows[i].text))).encode()).hexdigest(),
             hashlib.sha256(rows[i].text.encode()).hexdigest()) for i in kept}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


@tables
def test_stages_keep_columns_and_take_odd_rows(spark, docs, empty):
    wide = docs.withColumnRenamed("source", "__kept").withColumnRenamed("lang", "__score")
    for df in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
