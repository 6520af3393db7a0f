import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citegraph.llm import near_dedup as nd
from tests.llm.conftest import sentences


def shingles(text):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[k] / a[x], b[k] / b[x]) for k in keys) for x in set(a) & set(b))


def test_classes_match_all_pairs(spark):
    texts = {}
    for s in range(12):
        base = sentences(100 + s, 80).split()
        texts[10 * s] = " ".join(base)
        for k in range(1, 6):  # more and more words differ
            edited = list(base)
            for j in range(k):
                edited[7 + 15 * j] = f"new{s}{k}{j}"
            texts[10 * s + k] = " ".join(edited)
    texts[500] = texts[501] = "alpha beta gamma delta epsilon " * 30
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {k: shingles(t) for k, t in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in texts}


def test_probability_jaccard_is_exact_and_estimated_by_the_registers():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 80, dtype=np.uint64)
    a, b = np.sort(np.repeat(pool[:60], rng.integers(1, 4, 60))), np.sort(np.repeat(pool[20:], rng.integers(1, 4, 60)))
    exact = similarity(Counter(a.tolist()), Counter(b.tolist()))
    assert nd.probability_jaccard(a, b) == pytest.approx(exact)
    own, element, weight = [], [], []
    for k, x in enumerate((a, b)):
        keys, counts = np.unique(x, return_counts=True)
        own += [k] * len(keys)
        element += keys.tolist()
        weight += counts.tolist()
    w = nd.prob_minhash(np.array(own), np.array(element, np.uint64), np.array(weight, float), 2)
    assert abs((w[0] == w[1]).mean() - exact) < 4 * (exact * (1 - exact) / nd.REGISTERS) ** 0.5


def test_awkward_rows(docs):
    rows = nd.near_duplicate_classes(docs).collect()
    assert len(rows) == docs.count()
    cls = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert cls[1] == cls[2] == cls[3] == 1 and cls[8] == cls[9] == 8
    assert all(cls[i] == i for i in (4, 5, 6, 7, 10, 16, 17, 18))
    assert sorted(str(r["class_id"]) for r in rows if r["doc_id"] is None) == ["1", "None"]
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == sorted([-1, 1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19])


def test_empty(no_docs):
    assert nd.near_duplicate_classes(no_docs).collect() == []


def test_a_large_group_makes_few_pairs(spark):
    """300 near copies of one text are one class."""
    base = sentences(77, 150).split()
    rows = []
    for k in range(300):
        edited = list(base)
        edited[k % 150] = f"other{k}"
        rows.append((k, " ".join(edited)))
    assert {r["class_id"] for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def short_pairs():
    """Pairs of short texts and of texts of repeated lines, at similarity 0.8 or more."""
    pairs = []
    for n in range(6, 31):
        words = [f"w{i}" for i in range(n)]
        for k in (1, 2):
            pairs += [(words, words[:-k] + [f"x{i}" for i in range(k)]), (words, words + [f"x{i}" for i in range(k)])]
        pairs += [(words * m, words * m + words[: n // 2]) for m in (3, 10)] + [(words * m, words * m + ["x"]) for m in (3, 10)]
    return [p for p in pairs if similarity(*(shingles(" ".join(t)) for t in p)) >= nd.THRESHOLD]


def test_sketches_of_short_and_repetitive_texts_agree():
    rng, trials, bad, total = np.random.default_rng(11), 100, 0, 0
    for pair in short_pairs():
        sets = [shingles(" ".join(t)) for t in pair]
        keys = sorted(set(sets[0]) | set(sets[1]))
        own, place, weight = (np.array(x) for x in zip(*((k, keys.index(g), float(c)) for k, s in enumerate(sets) for g, c in s.items())))
        hashes = rng.integers(1, 1 << 63, (trials, len(keys)), dtype=np.uint64)
        owner = (np.arange(trials)[:, None] * 2 + own[None]).reshape(-1)
        bits = np.unpackbits(nd.sketch_bits(nd.prob_minhash(owner, hashes[:, place].reshape(-1), np.tile(weight, trials), 2 * trials)), axis=1)
        bad += int(((bits[::2] == bits[1::2]).sum(axis=1) < nd.AGREEING).sum())
        total += trials
    assert total >= 10_000 and bad <= total // 1000


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    """Copies and near copies without an id and repeated rows go; texts that are no copies stay."""
    a, b, c, d = (sentences(300 + k, 60) for k in range(4))
    near_c = c.replace(c.split()[30], "qqq", 1)
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, c), (None, near_c), (3, d), (3, None), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [tuple(r) for r in nd.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (None, kept_c(kept, c, near_c)), (3, d), (3, None), (None, None)], key=str)
    verdict = nd.near_duplicate_classes(docs).collect()
    assert len(verdict) == len(rows) and sum(r["is_kept"] for r in verdict) == len(kept)
    assert sorted(str(r["class_id"]) for r in verdict if r["doc_id"] is None) == ["1"] + ["None"] * 5


def kept_c(kept, c, near_c):
    return next(t for _, t in kept if t in (c, near_c))


def test_near_copies_of_each_text_of_an_id_are_found(spark):
    a, b = sentences(401, 60), sentences(402, 60)
    near_a, near_b = (t.replace(t.split()[30], "qqq", 1) for t in (a, b))
    docs = spark.createDataFrame([(1, a), (1, b), (2, near_a), (3, near_b)], "doc_id long, text string")
    assert {r["class_id"] for r in nd.near_duplicate_classes(docs).collect()} == {1}
    assert [r["doc_id"] for r in nd.keep_one(docs).collect()] == [1, 1]


def test_what_texts_have_of_their_own_bounds_their_similarity(spark):
    """No pair is above the bound, whatever its weights; where nothing is shared there is none."""
    rng = random.Random(8)
    bags = []
    for k in range(40):
        bag = [rng.randint(0, 25) for _ in range(rng.randint(1, 40))] + [1000 + 50 * k + rng.randint(0, 20) for _ in range(rng.randint(0, 12))]
        bags.append(np.sort(np.array(bag, np.uint64)))
    bags.append(np.array([77_777, 77_777], np.uint64))
    frame = spark.createDataFrame([(k, bytearray(b.tobytes())) for k, b in enumerate(bags)], "doc long, shingles binary")
    excess = {r["doc"]: r["excess"] for r in nd.own_shares(frame).collect()}
    assert len(excess) == len(bags) and excess[40] is None
    tight = 0
    for i in range(40):
        for j in range(i):
            bound = 1 / (1 + excess[i] + excess[j])
            value = nd.probability_jaccard(bags[i], bags[j])
            assert value <= bound + 1e-9
            tight += value > 0.5 * bound
    assert tight > 0
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5, 10], [1, 2, 3, 4, 5, 20, 21])]
    frame = spark.createDataFrame([(k, bytearray(b.tobytes())) for k, b in enumerate(sets)], "doc long, shingles binary")
    a, b = (r["excess"] for r in nd.own_shares(frame).orderBy("doc").collect())
    assert nd.probability_jaccard(*sets) <= 1 / (1 + a + b) + 1e-9


def test_a_large_group_of_copies_changed_in_places_of_their_own(spark):
    """Copies of one text, each with words of its own in one to six places: classes are those of all pairs compared."""
    rng = random.Random(4)
    base = sentences(77, 100).replace("\n", " ").split()
    texts = []
    for k in range(60):
        words = list(base)
        for place in rng.sample(range(0, len(words), 6), rng.randint(1, 6)):
            words[place] = f"own{k}x{place}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate([" ".join(base), *texts])), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(docs).collect()}
    words = nd.words_of(pa.array([" ".join(base), *texts], pa.large_string()))
    grams = words.grams(nd.SHINGLE)
    bags = [np.sort(nd.shingles_of(words, i, grams)) for i in range(61)]
    root = list(range(61))
    for i in range(61):
        for j in range(i):
            if nd.probability_jaccard(bags[i], bags[j]) >= nd.THRESHOLD:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 1 < len(set(root)) < 61
    assert got == dict(enumerate(root))


def test_two_centres_of_a_bucket_meet_once(spark):
    """Among centres a pair is one row, not one from either side; other members meet every centre."""
    bits = [0] * nd.SKETCH
    rows = [(7, k, k % 3, bits, [7], k, 0.0, False) for k in range(20)]
    bucket = spark.createDataFrame(rows, "key long, doc long, meets long, sketch array<long>, bands array<long>, cls long, excess double, done boolean")
    for n in (1, 5, 4096):
        met = nd._meetings(bucket, nd._centres(bucket, n), 0.25).select("doc", "centre").collect()
        order = sorted(range(20), key=lambda k: (-(k % 3), k))
        assert len(met) == len({frozenset(m) for m in met})
        assert {frozenset(m) for m in met} == {frozenset(p) for p in itertools.combinations(order, 2) if p[0] in order[:n]}


def test_arrivals_are_drawn_in_bounded_pieces(monkeypatch):
    """Registers do not depend on the size of a piece, and no array of arrivals is larger than one."""
    rng = np.random.default_rng(5)
    own = np.repeat(np.arange(60), rng.integers(20, 60, 60))
    element, weight = rng.integers(1, 1 << 63, len(own), dtype=np.uint64), np.ones(len(own))
    whole = nd.prob_minhash(own, element, weight, 60)
    monkeypatch.setattr(nd, "PIECE_ARRIVALS", 5_000)
    largest, mix = [], nd.mix
    monkeypatch.setattr(nd, "mix", lambda x: (largest.append(x.size), mix(x))[1])
    assert (nd.prob_minhash(own, element, weight, 60) == whole).all() and max(largest) <= 5_000
