"""Cases that once went wrong: regular long words, very long URLs, training text from all of a text."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import byte_bpe, common, language_id, queries, url_filter


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 1024, 2048, 8192)]


def test_regular_words_have_keys_of_their_own():
    words = [w for pair in PAIRS for w in pair] + ["ab" * 512, "ba" * 512]
    texts = pa.array([" ".join(words), *words])
    tokens, before, sizes = common.token_keys(texts, common.Powers())
    assert len(set(tokens[:len(words)].tolist())) == len(words)
    assert tokens[:len(words)].tolist() == tokens[len(words) + 1::2].tolist()


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.vocabulary(queries.RANKS))


def test_regular_words_get_their_own_ids(ranks):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    texts = [" ".join(pair) for pair in PAIRS] + [w for pair in PAIRS for w in pair] + ["", "日本 語", "a\0b", " "]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(queries.vocabulary(queries.TOKENIZER), encoding="utf-8") as file:
        spec = file.read()
    whole = Tokenizer.from_str(spec)
    for encoder, want in (
            (byte_bpe.Encoder(byte_bpe.rank_tokenizer(ranks), byte_bpe.character_classes()), own.encode_ordinary),
            (byte_bpe.Encoder(spec, byte_bpe.character_classes(), added=True),
             lambda t: whole.encode(t, add_special_tokens=False).ids)):
        flat, sizes = encoder(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [want(t) for t in texts]


def test_a_worker_keeps_its_tokenizer_and_empties_its_pieces(monkeypatch):
    import pickle

    from tokenizers import Tokenizer

    with open(queries.vocabulary(queries.TOKENIZER), encoding="utf-8") as file:
        spec = file.read()
    sent = pickle.loads(pickle.dumps(byte_bpe.loaded(spec, added=True)))
    rng = random.Random(5)
    letters = "abcdefgh éßñ日本\u00a0\u2003😀\0\n'1 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "", "\u0085 \x1c", "x" * 3000]
    whole = Tokenizer.from_str(spec)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 50)
    for _ in range(2):  # two tasks of one worker
        encoder = byte_bpe.Encoder(sent, byte_bpe.character_classes(), added=True)
        assert encoder.tokenizer is sent[0] and encoder.by_pieces
        got, kept = [], []
        for low in range(0, len(texts), 7):
            flat, sizes = encoder(texts[low:low + 7])
            got += [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
            kept.append(len(encoder.slots))
        assert got == want and min(np.diff(kept)) < 0


def test_long_urls_take_linear_time(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh/%-") for _ in range(1_000_000))
    pages = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate(
        [("a.com", f"good{i}") for i in range(60)] + [("b.net", f"fr/bad{i}") for i in range(60)]
        + [("c.org", long), ("c.org", "good1"), ("c.org", "bad1")])], "page_id long, url string")
    start = time.monotonic()
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert time.monotonic() - start < 90 and len(got) == pages.count()
    assert got[120].path == "/" + long and got[120].score is not None
    assert got[121].score > got[122].score


def test_training_text_comes_from_all_of_a_text(spark):
    parts = [f"wort{i:05d}" for i in range(20_000)]
    rows = spark.createDataFrame([(" ".join(parts), "de"), ("kurz und gut", "de"), ("short and good", "en")], "text string, lang string")
    sample = dict(reversed(x) for x in language_id.training_sample(rows, "text", "lang", 10))
    long = next(t for t in sample if len(t) > 100)
    assert len(long) <= language_id.WINDOWS * (language_id.WINDOW_CHARS + 1)
    met = [int(w[4:]) for w in long.split() if len(w) == 9 and w.startswith("wort")]
    assert np.histogram(met, 8, (0, 20_000))[0].min() > 50 and met[0] < 10 and met[-1] > 19_990
    cut = language_id.spread(" ".join(parts).encode(), 8192)
    met = [int(w[4:]) for w in cut.decode().split()]
    assert len(cut) <= 8192 and np.histogram(met, 8, (0, 20_000))[0].min() > 50


def test_sizes_are_those_of_plain_compression():
    import zstandard

    rng = random.Random(1)
    words = {k: ["".join(rng.choice(k + "aeiou") for _ in range(rng.randint(3, 8))) for _ in range(400)] for k in ("rstl", "kmnp")}
    dictionaries = {k: " ".join(rng.choice(v) for _ in range(4000)).encode() for k, v in words.items()}
    judge = language_id.Languages(dictionaries)
    for lang in words:
        text = " ".join(rng.choice(words[lang]) for _ in range(3000))
        data = language_id.plain(text)
        sizes = []
        for name in sorted(dictionaries):
            how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH)
            one = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(
                dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append(sum(len(one.compress(data[i:i + language_id.PIECE])) for i in range(0, len(data), language_id.PIECE)))
        assert judge.sizes(data) == sizes and judge(text)[0] == lang


def test_scores_are_those_of_a_plain_model(spark):
    """All probabilities from exact counts, put on the filter's levels; false positives lift a few."""
    import collections
    import math

    from quarry.llm import lm_scoring

    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(9000)]
    texts = [" ".join(words[i:i + 30]) for i in range(0, 9000, 30)]
    rows = spark.createDataFrame(list(enumerate([*texts, None, "w1 unseen words"])), "doc_id long, text string").repartition(3)
    training = rows.filter("doc_id < 250")
    model, counts = lm_scoring.learn(training)
    got = {r.c0: r.score for r in lm_scoring.score(rows, model, counts, [rows.doc_id]).collect()}
    tokens = [[*(t or "").split(), "\0end"] for t in [*texts, None, "w1 unseen words"]]
    one, two = collections.Counter(), collections.Counter()
    for t in tokens[:250]:
        one.update(t)
        two.update(zip(["\0begin", *t], t))
    held = lambda n: float(lm_scoring.count_of(lm_scoring.levels(np.array([n], float), 1.0), 1.0)[0])
    taken = collections.Counter()
    for (v, _), n in two.items():
        taken[v] += n - lm_scoring.DISCOUNT
    n, v = sum(one.values()), len(one)
    close = 0
    for i, t in enumerate(tokens):
        want = 0.0
        for a, b in zip(["\0begin", *t], t):
            single = (held(one[b]) + 0.5) / (n + 0.5 * (v + 1)) if one[b] else 0.5 / (n + 0.5 * (v + 1))
            times = held(one["\0end"] if a == "\0begin" else one[a])
            share = min(held(taken[a]) / times, 0.98) if times else 0.0
            direct = max(min(held(two[a, b]), times) - lm_scoring.DISCOUNT, 0) / times if times else 0.0
            want += math.log10(min(lm_scoring.MIX * (direct + (1 - share) * single) + (1 - lm_scoring.MIX) * single, 1.0))
        assert got[i] == pytest.approx(want, rel=0.05)
        close += abs(got[i] - want) <= 0.005 * abs(want)
    assert close > 0.8 * len(tokens)
