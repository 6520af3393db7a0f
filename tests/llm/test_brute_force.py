"""Fitted parts held against plain computations of the same thing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from citegraph.llm import common, language_id, quality_classifier
from tests.llm.conftest import sentences
from tests.llm.test_classifiers import SYLLABLES, held, text_in


def test_nystroem_with_all_texts_as_landmarks_is_kernel_ridge(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANDMARKS", 1000)
    rows = [(k, text_in(lang, k, 12 + k % 30), lang) for k, lang in enumerate([*SYLLABLES] * 16)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = [r for r in rows if not held(r[0])]
    assert len(seen) == model.landmarks.shape[1]
    x = language_id.embed(pa.array([t for _, t, _ in seen], pa.large_string())).astype(float)
    kernel = x @ x.T
    own = np.array([lang for _, _, lang in seen])
    assert kernel[0, 1] == pytest.approx(_shared(seen[0][1], seen[1][1]), abs=1e-5)
    # Ridge in the dual: coordinates of the texts in their own span.
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-9 * value.max()
    axes = vector[:, keep] / np.sqrt(value[keep])
    a = np.column_stack([kernel @ axes, np.ones(len(seen))])
    weight = np.array([1 / (own == k).sum() for k in own])
    y = np.where(own[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    penalty = language_id.RIDGE * np.diag([*np.ones(keep.sum()), 1e-6]) / len(model.languages)
    w = np.linalg.solve((a * weight[:, None]).T @ a + penalty, (a * weight[:, None]).T @ y)
    fresh = [text_in(lang, 900 + k, 20) for k, lang in enumerate([*SYLLABLES] * 4)] + [sentences(3, 40)]
    t = language_id.embed(pa.array(fresh, pa.large_string()))
    plain = language_id.SHARPNESS * (np.column_stack([t @ x.T @ axes, np.ones(len(fresh))]) @ w)
    plain = np.exp(plain - plain.max(axis=1, keepdims=True))
    assert model.score(t) == pytest.approx(plain / plain.sum(axis=1, keepdims=True), abs=0.02)


def _shared(a, b):
    """The presence kernel by hand: shared buckets over the root of the product of their numbers."""
    fa, fb = language_id.presence(pa.array([a, b], pa.large_string()))
    return (fa & fb).sum() / np.sqrt(fa.sum() * fb.sum())


def test_long_texts_keep_their_language(spark):
    rows = [(k, text_in(lang, k, 60), lang) for k, lang in enumerate([*SYLLABLES] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang in SYLLABLES:
        unit = " ".join(text_in(lang, 5000 + k, 2000) for k in range(20))
        long = unit * (5_000_000 // len(unit.encode()) + 1)
        vector = language_id.embed(pa.array([long, unit[:800], ""], pa.large_string()))
        assert vector.shape == (3, language_id.BUCKETS) and not vector[2].any()
        score = model.score(vector)
        assert model.languages[int(score[0].argmax())] == lang and score[0].max() > 0.5


def test_a_sample_keeps_rows_and_languages_of_a_repeated_id(spark, monkeypatch):
    """Sixty rows of one id, in three languages: sixty samples, each with its own language."""
    rows = [(1, text_in(lang, k, 30), lang) for k, lang in enumerate([*SYLLABLES] * 20)]
    assert not held(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "LANDMARKS", 10_000)
    model = language_id.fit(frame)
    assert model.landmarks.shape[1] == 60
    got = model.score(language_id.embed(pa.array([t for _, t, _ in rows], pa.large_string())))
    assert [model.languages[i] for i in got.argmax(axis=1)] == [lang for *_, lang in rows]


def test_quality_features_are_compressed_sizes():
    rng = random.Random(1)
    good, bad = sentences(1, 400).encode(), " ".join(rng.choice(["#$%", "***", "buy"]) for _ in range(900)).encode()
    texts = [sentences(2, 50).encode(), b"*** buy #$% " * 40, "é".encode() * 3000, b""]

    def size(text, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        n = quality_classifier.PART_BYTES
        return sum(len(packer.compress(text[i : i + n])) for i in range(0, len(text), n))

    got = quality_classifier.size_features(texts, good, bad)
    for row, text in zip(got, texts):
        if not text:
            assert row.tolist() == [0, 0, 0]
            continue
        g, b = size(text, good), size(text, bad)
        assert row == pytest.approx([(b - g) / (b + g), g / len(text), b / len(text)], rel=0.05)


def test_logistic_regression_stands_where_the_loss_is_flat():
    """The penalised loss by itself, its gradient by differences, at the fitted weights."""
    rng = np.random.default_rng(2)
    x, noise = rng.normal(size=(200, 4)), rng.normal(size=200)
    y = (x @ [1.0, -2.0, 0.5, 0.0] + noise > 0.3).astype(float)
    w = common.fit_logistic(x, y, ridge=1e-2)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return np.sum(np.log1p(np.exp(z)) - y * z) + 0.5 * (1e-2 * len(x) * np.sum(v[:-1] ** 2) + 1e-6 * v[-1] ** 2)

    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-5
        assert abs(loss(w + step) - loss(w - step)) / 2e-5 < 1e-3
    assert loss(w) <= min(loss(w + d) for d in rng.normal(size=(50, 5)) * 0.05)


def test_held_out_rows_are_those_of_the_checksum(spark):
    frame = spark.createDataFrame([(k,) for k in range(200)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in frame.select("doc_id", common.held_out(frame["doc_id"]).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(200)} | {None: True}
