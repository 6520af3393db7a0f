"""Quality by compression: a text is good if a dictionary of good text packs it better than one of bad text.

Two zstandard dictionaries are trained on parts of labelled texts. A text is compressed part by part with
both; the normalised difference of the compressed sizes, with the two compression ratios, becomes a score by
a logistic calibration on other labelled texts. Labels come from a bounded sample: `PER_CLASS`
documents of each label, by a hash of the id; of each of them at most `PARTS` parts train a dictionary. Every text is scored whole.

Defined cases: a null text is empty; an empty text is scored by the calibration at its neutral values;
without texts of both labels every score is the share of label 1 (0.5 without labels); repeated rows
are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from citegraph.llm.common import fit_logistic, held_out, labelled_sample, sigmoid
from citegraph.session import cut_lineage

PER_CLASS = 2000
PARTS = 3
PART_BYTES = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.7


def parts_of(text: bytes) -> list[bytes]:
    return [text[i : i + PART_BYTES] for i in range(0, len(text), PART_BYTES)]


def build_dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary, or the parts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def size_features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: the normalised size difference, and the ratio with either dictionary."""
    pair = [_compressor(good), _compressor(bad)]
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if text:
            g, b = (sum(len(c.compress(p)) for p in parts_of(text)) for c in pair)
            out[i] = (b - g) / (b + g), g / len(text), b / len(text)
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x**2, x[:, 0] * x[:, 1]])


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), self.share)
        x = size_features(texts, self.good, self.bad)
        empty = np.array([not t for t in texts], bool)
        z = (_expand(x) - self.mean) / self.scale
        z[empty] = 0.0
        return sigmoid(np.column_stack([z, np.ones(len(z))]) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """Dictionaries from one half of the sample, calibration on the other half, weighted to the labels' true shares."""
    sample = cut_lineage(labelled_sample(docs, labels, "quality", PER_CLASS, id_col, text))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, out = batch.column("label").to_pylist(), ([], [])
            for k, t in zip(label, batch.column("text").to_pylist()):
                for p in parts_of(t.encode())[:: max(1, -(-len(t.encode()) // PART_BYTES) // PARTS)][:PARTS]:
                    out[0].append(k)
                    out[1].append(p)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["label", "part"])

    table = sample.where(half == 0).mapInArrow(chunks, "label int, part binary").orderBy("label", "part").toArrow()
    label, part = table.column("label").to_numpy(), table.column("part").to_pylist()
    parts = [[p for k, p in zip(label, part) if k == want] for want in (1, 0)]
    rated = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where(~held_out(F.col("doc_id")))
    share = rated.where("q IN (0, 1)").agg(F.avg("q")).first()[0]
    share = 0.5 if share is None else float(share)
    if not parts[0] or not parts[1]:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), share)
    good, bad = build_dictionary(parts[0]), build_dictionary(parts[1])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = size_features([t.encode() for t in batch.column("text").to_pylist()], good, bad)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(x[:, k]) for k in range(3)]], ["label", "a", "b", "c"])

    seen = sample.where((half == 1) & (F.length("text") > 0)).mapInArrow(sizes, "label int, a double, b double, c double").orderBy("label", "a", "b", "c").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    x = _expand(np.column_stack([seen.column(c).to_numpy() for c in "abc"]).reshape(-1, 3)) if len(y) else np.zeros((0, 7))
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), share)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights = fit_logistic((x - mean) / scale, y)
    # The sample holds the labels in other shares than the table does.
    drawn = y.mean()
    weights[-1] += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(drawn / (1 - drawn))
    return Model(good, bad, mean, scale, weights, share)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    model = fit(docs, labels, id_col, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            value = np.concatenate([model.score(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = F.col(id_col).cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
