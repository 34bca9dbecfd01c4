"""The near-dedup of the pipeline against brute force over all pairs."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import common, simhash_similar

SF = os.environ.get("QUARRY_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
DOCS = "doc_id long, text string, __f0 string, __ROW int"


def shingles(text, n=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows, similarity=0.8):
    """Pairs of rows (doc_id, text) that are alike, and the doc_ids one per group keeps."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if likeness(sets[i], sets[j]) >= similarity]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [(rows[i][0], rows[j][0]) for i, j in pairs], {rows[i][0] for i in range(len(rows)) if root[i] == i}


def edited(seed, bases, copies, share):
    """Texts of random words with copies in which up to ``share`` of the words are others."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(bases):
        base = [draw.choice(words) for _ in range(draw.randint(60, 300))]
        out.append(base)
        for _ in range(copies):
            copy = list(base)
            for _ in range(draw.randint(1, max(1, int(len(base) * share)))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(copy)
    return [" ".join(t) for t in out]


def test_similarities_are_those_of_the_sets():
    texts = edited(1, 5, 3, 0.05) + ["", "a", "a b", "A b", "x " * 40, "日本 語 " * 9, None, "é É é É é É"]
    left = pa.array([a for a in texts for _ in texts], pa.large_string()).fill_null("")
    right = pa.array([b for _ in texts for b in texts], pa.large_string()).fill_null("")
    want = [likeness(shingles(a), shingles(b)) for a in texts for b in texts]
    assert np.allclose(simhash_similar.similarities(left, right, common.Powers()), want)


def test_lanes_count_each_bit_over_different_shingles():
    texts = edited(2, 3, 1, 0.05) + ["", "a", "a b c d e f " * 30]
    powers = common.Powers()
    got = simhash_similar.fingerprints(pa.array(texts, pa.large_string()), powers)
    keys, home = simhash_similar.shingle_keys(pa.array(texts, pa.large_string()), powers)
    for i, text in enumerate(texts):
        mine = keys[home == i]
        assert len(mine) == len(shingles(text))
        for lane in range(simhash_similar.LANES):
            mixed = common.mix(mine ^ simhash_similar._LANE_STEPS[lane]).tolist()
            want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))
            assert int(got[i, lane]) == want


def test_candidates_of_the_index_join_what_all_pairs_join():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    codes = np.repeat(base, 60, 0)
    for lane in (0, 1):
        for _ in range(5):
            codes[:, lane] ^= np.uint64(1) << draw.integers(0, 64, len(codes)).astype(np.uint64)
    pairs = simhash_similar.candidates(codes[:, 0], codes[:, 1])
    bits = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2)
    lane = np.bitwise_count(codes[:, None, 0] ^ codes[None, :, 0])
    near = (bits <= simhash_similar.RADIUS) & (lane <= simhash_similar.LANE_RADII[-1])
    assert near[pairs[:, 0], pairs[:, 1]].all()
    labels = simhash_similar.unite(np.arange(len(codes)), *pairs.T)
    assert (labels[:, None] == labels[None])[near].all()
    assert len(pairs) < 2 * len(codes)


@pytest.mark.parametrize("most", [simhash_similar.MOST, 40])
def test_one_of_each_group_stays(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_similar, "MOST", most)
    rows = list(enumerate(edited(4, 60, 6, 0.03)))
    pairs, want = brute(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id for r in simhash_similar.keep_one(df).collect()}
    assert want <= got  # only alike texts are linked
    assert len(pairs) > 400 and len(got - want) <= 0.1 * (len(rows) - len(want))


def test_most_alike_pairs_are_found():
    """Over pairs alone, without help by other members of a group: at least 0.9 of those alike."""
    texts = edited(5, 600, 1, 0.045)
    made = simhash_similar.fingerprints(pa.array(texts, pa.large_string()), common.Powers())
    bits = np.unpackbits(made.astype("<u8").view(np.uint8).reshape(len(texts), -1), axis=1, bitorder="little")
    drawn = simhash_similar._bucket_bits(simhash_similar.TABLES, simhash_similar.BUCKET_BITS, 256, 1)
    alike = [i for i in range(0, len(texts), 2) if likeness(shingles(texts[i]), shingles(texts[i + 1])) >= 0.8]
    differ = [bits[i] != bits[i + 1] for i in alike]
    found = [any(not d[p].any() for p in drawn) and d[:128].sum() <= simhash_similar.RADIUS
             and d[:64].sum() <= simhash_similar.LANE_RADII[-1] for d in differ]
    assert len(alike) > 200 and np.mean(found) >= 0.9


def test_odd_rows(spark):
    long = " ".join(f"v{i % 9973}" for i in range(60_000))
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n\t", None, None), (4, "one two", "x", 1), (5, "ONE  two", "x", 1),
            (5, "one two", "x", 1), (6, "two one", "x", 1), (7, long, "x", 1), (8, long + " end", "x", 1),
            (None, long, "x", 1), (None, "only here, and without a key", "x", 1),
            (None, "only here, and without a key", "y", 2)]
    df = spark.createDataFrame(rows, DOCS)
    out = simhash_similar.keep_one(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 4, 6, 7]
    assert simhash_similar.keep_one(df.limit(0)).count() == 0
    assert simhash_similar.keep_one(df.filter("doc_id = 4")).count() == 1


@tables
def test_recall_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    _, want = brute(rows)
    got = {r.doc_id for r in simhash_similar.keep_one(common.read(spark, SF, "documents")).collect()}
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))


@pytest.mark.parametrize("small", [simhash_similar.SMALL, 4])
def test_a_link_that_goes_hides_no_other(spark, monkeypatch, small):
    """The rows kept are those of all candidates, each pair of every bucket checked."""
    monkeypatch.setattr(simhash_similar, "SMALL", small)
    texts = edited(6, 40, 12, 0.08)
    sets = [shingles(t) for t in texts]
    made = simhash_similar.fingerprints(pa.array(texts, pa.large_string()), common.Powers())
    bits = np.unpackbits(made.astype("<u8").view(np.uint8).reshape(len(texts), -1), axis=1, bitorder="little")
    root = np.arange(len(texts))
    drawn = simhash_similar._bucket_bits(simhash_similar.TABLES, simhash_similar.BUCKET_BITS, 256, 1)
    for i in range(len(texts)):
        for j in range(i):
            differ = bits[i] != bits[j]
            if (differ[:128].sum() <= simhash_similar.RADIUS and any(not differ[p].any() for p in drawn)
                    and likeness(sets[i], sets[j]) >= 0.8):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = sorted(r.doc_id for r in simhash_similar.keep_one(df).collect())
    assert got == sorted(set(root.tolist())) and 40 < len(got) < len(texts)


def test_the_index_finds_pairs_that_are_near_in_either_lane():
    draw = np.random.default_rng(7)
    codes = draw.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    codes[1, 0] = codes[0, 0] ^ np.uint64((1 << 20) - 1)  # 20 bits in the first lane, none in the second
    codes[1, 1] = codes[0, 1]
    assert {0, 1} in [set(p) for p in simhash_similar.candidates(codes[:, 0], codes[:, 1]).tolist()]


def test_sketches_reject_no_alike_pair_and_most_others():
    draw, sets = random.Random(8), []
    for size in (1, 5, 40, 63, 64, 65, 200, 1000, 1100, 5000):
        for _ in range(6):
            base = [draw.getrandbits(64) for _ in range(size)]
            sets.append(set(base))
            for share in (0.05, 0.1, 0.2, 0.3):
                sets.append({draw.getrandbits(64) if draw.random() < share else x for x in base})
                sets.append({x for x in base if draw.random() > share} or {1})
    sets.append(set())
    sizes = np.array([len(x) for x in sets])
    keys = np.array([k for x in sets for k in sorted(x)], np.uint64)
    flat, words = simhash_similar.sketches(keys, sizes)
    a, b = np.triu_indices(len(sets), 1)
    can = simhash_similar.can_be_alike(flat, words, sizes, a, b, 0.8)
    real = np.array([likeness(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist())])
    got = simhash_similar.set_similarities(keys, np.cumsum(sizes) - sizes, sizes, a, b)
    assert np.allclose(got, real) and can[real >= 0.8].all() and (real >= 0.8).sum() > 100
    assert can[real < 0.7].mean() < 0.02 and len(set(words[a][can] - words[b][can])) > 1


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """A group in which every two texts are near but under the similarity: its pairs are never rows."""
    draw = random.Random(9)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(300):
        copy = list(base)
        for place in draw.sample(range(5, 195), 3):
            copy[place] = f"x{i}y{place}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    pairs, want = brute(rows)
    made, cut = {}, simhash_similar.cut

    def counted(df, name):
        out = cut(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash_similar, "cut", counted)
    got = {r.doc_id for r in simhash_similar.keep_one(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)).collect()}
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want)) + 2 and len(pairs) < 2000
    assert made["similar-again"] > 250 and max(made.values()) <= simhash_similar.TABLES * len(rows) // 2


def kept_whole(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    return {r.doc_id for r in simhash_similar.keep_one(df, whole=True).collect()}, brute(rows)


def test_whole_finds_links_that_fingerprints_miss(spark):
    """The same texts as above: 4 of their 176 alike pairs are no neighbours by fingerprints."""
    got, (_, want) = kept_whole(spark, edited(6, 40, 12, 0.08))
    assert got == want and len(want) == 402


@pytest.mark.parametrize("most", [simhash_similar.MOST, 40, 6])
def test_whole_is_brute_force_with_common_passages(spark, monkeypatch, most):
    """Copies of every similarity around 0.8, a passage that all share, and blocks that are cut."""
    monkeypatch.setattr(simhash_similar, "MOST", most)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{t} {passage}" if i % 3 else t for i, t in enumerate(edited(10, 30, 8, 0.06))]
    got, (pairs, want) = kept_whole(spark, [*texts, *texts[:40], texts[0] + " more", None, "", "one", "ONE"])
    assert got == want and len(pairs) > 150


def test_prefixes_of_alike_sets_meet_at_one_place_at_least():
    draw = np.random.default_rng(12)
    sets = []
    for size in (1, 2, 4, 5, 9, 10, 40, 123, 500):
        base = draw.integers(0, 1 << 62, size, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.11):
            for _ in range(4):
                other = draw.integers(0, 1 << 62, size, dtype=np.uint64)
                changed = np.where(draw.random(size) < share, other, base)
                sets += [np.unique(changed), np.unique(np.concatenate([base, other[:int(share * size * 2)]]))]
    sizes = np.array([len(x) for x in sets])
    keys, home = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    frequent = np.concatenate([sets[0], sets[100][::2], sets[-1][:90]])
    flat, n = simhash_similar.prefixes(keys, home, sizes, np.unique(frequent & simhash_similar.ORDER_KEY)[::-1], 0.8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    of, met = np.repeat(np.arange(len(sets)), n), set()
    for a, b in simhash_similar.pairs_between(flat, of):
        can = simhash_similar.can_overlap(sizes[of], place, a, b, 0.8)
        met |= {tuple(sorted(p)) for p in zip(of[a[can]].tolist(), of[b[can]].tolist())}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if likeness(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}
    assert alike <= met and len(alike) > 300


@tables
def test_whole_is_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    _, want = brute(rows)
    got = {r.doc_id for r in simhash_similar.keep_one(common.read(spark, SF, "documents"), whole=True).collect()}
    assert got == want
