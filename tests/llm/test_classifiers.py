"""The three learnt scores: held-out accuracy on made-up corpora, and awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.llm import language_id, quality_classifier, toxicity
from tests.llm.conftest import sentences

SYLLABLES = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["schu", "ung", "ver", "zt"], "cc": ["ção", "ñe", "ou", "rri"]}


def text_in(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_languages_of_held_out_texts(spark, docs, no_docs):
    rows = [(k, text_in(lang, k), lang, "s") for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 !! ...", "cc", "s"), (1003, text_in("bb", 7, 9000), None, "s"), (1003, text_in("bb", 7, 9000), None, "s"), (None, text_in("cc", 9), "cc", "s")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    got = language_id.predict(frame).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    wrong = [r for r in rows if held(r[0]) and by[r[0]]["lang_pred"] != r[2]]
    assert not wrong and all(by[r[0]]["held_out"] == held(r[0]) for r in rows)
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict(no_docs).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_the_kernel_is_shared_grams(spark):
    import pyarrow as pa

    flags = language_id.presence(pa.array(["abcd", "abxd", "", "abcd abcd"], pa.large_string()))
    shared = (flags[0] & flags[1]).sum()
    assert shared == len({"a", "b", "d", "ab"}) and flags[2].sum() == 0
    assert (flags[0] <= flags[3]).all()


def test_quality_of_held_out_texts(spark, docs, no_docs):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        text = sentences(k, 80 + rng.randint(0, 200))
        rows.append((k, text if good else " ".join(w + rng.choice(["***", "%%%", "###"]) for w in text.split())))
        labels.append((k, int(good), 0))
    labels += [(0, 0, 0), (5, None, None), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.score(frame, marks).collect()}
    assert len(got) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    right = [got[k]["predicted"] == int(k % 3 > 0) for k in range(240) if held(k)]
    assert np.mean(right) > 0.95
    assert quality_classifier.score(no_docs, marks).collect() == []
    assert {r["score"] for r in quality_classifier.score(frame, marks.limit(0)).collect()} == {0.5}


def test_toxicity_of_held_out_texts(spark, docs, no_docs):
    bad = ["grobzork", "grobmuk", "idiot", "vilefex"]
    rows, labels = [], []
    for k in range(400):
        rng = random.Random(k)
        words = sentences(k, 60).split()
        toxic = k % 5 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), w + rng.choice(["", "ka", "mi"]) if w.startswith("grob") else w)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    frame = spark.createDataFrame([*rows, (900, None), (901, ""), (902, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame, marks).collect()}
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    unseen = [k for k in range(400) if held(k)]
    assert np.mean([got[k]["predicted"] == int(k % 5 == 0) for k in unseen]) > 0.97
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    assert toxicity.score(no_docs, marks).collect() == []
    assert {r["score"] for r in toxicity.score(frame, marks.limit(0)).collect()} == {0.0}


def test_the_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.15
    vote = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false)
    good, weak = vote(0.7, 0.005), vote(0.4, 0.05)
    votes = np.column_stack([good, weak, weak, vote(0.6, 0.01)])
    model = toxicity.fit_label_model(votes, np.ones(4), 0.15)
    assert model.accuracy()[0] == pytest.approx(y[good].mean(), abs=0.08)
    assert model.weight[1] < 0.7 and model.weight[0] > 0.8


def test_the_label_model_leaves_independent_voters_their_weight():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.15
    votes = np.column_stack([np.where(y, rng.random(4000) < hit, rng.random(4000) < false) for hit, false in ((0.7, 0.02), (0.5, 0.01), (0.6, 0.03), (0.4, 0.02))])
    model = toxicity.fit_label_model(votes, np.ones(4), 0.3)
    assert (model.weight > 0.8).all() and model.prior == pytest.approx(y.mean(), abs=0.03)
    for k in range(4):
        assert model.accuracy()[k] == pytest.approx(y[votes[:, k]].mean(), abs=0.08)


def test_the_label_model_equals_plain_em():
    """Text by text, voter by voter: the same chances, share and posteriors."""
    rng = np.random.default_rng(5)
    y = rng.random(300) < 0.3
    votes = np.column_stack([np.where(y, rng.random(300) < 0.6, rng.random(300) < 0.05) for _ in range(3)])
    model = toxicity.fit_label_model(votes, np.ones(3), 0.3)
    assert model.weight.tolist() == [1.0, 1.0, 1.0]
    share, chance = 0.3, [[0.002] * 3, [0.15] * 3]
    for _ in range(200):
        p = []
        for row in votes:
            like = [1 - share, share]
            for c in (0, 1):
                for j in range(3):
                    like[c] *= chance[c][j] if row[j] else 1 - chance[c][j]
            p.append(like[1] / sum(like))
        share = sum(p) / len(p)
        chance = [
            [(sum(q for q, row in zip(p0, votes) if row[j]) + start) / (sum(p0) + 1) for j in range(3)] for p0, start in (([1 - q for q in p], 0.002), (p, 0.15))
        ]
    assert model.prior == pytest.approx(share, abs=1e-4)
    assert model.chance == pytest.approx(np.array(chance), abs=1e-3)
    assert model.posterior(votes.astype(float)) == pytest.approx(np.array(p), abs=1e-3)
