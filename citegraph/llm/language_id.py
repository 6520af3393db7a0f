"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel is the blended spectrum in its presence form: two texts are alike by the share of byte
n-grams (one to four bytes, lower-cased, hashed into `BUCKETS`) that occur in both. A text is described by
its kernel values with a few landmark texts per language; one ridge regression per language against the
rest is solved on a bounded sample, and a batch is scored by two matrix products.

The sample holds at most `PER_LANGUAGE` texts of each language, by a hash of the id, of which
`LANDMARKS` are landmarks. Texts are scored whole.

Defined cases: a null text or one without a letter is `und` with score 0, as is everything if no
language can be learnt; repeated rows are each predicted; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from citegraph.llm.common import held_out, pieces, text_bytes

PER_LANGUAGE = 400
LANDMARKS = 24
#: Rows drawn per row wanted; bytes of a stretch of text; stretches or texts that are worked on at a time.
OVERSAMPLE, STRETCH, TOGETHER = 4, 1 << 14, 256
GRAMS = 4
BUCKETS = 1 << 13
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"


def _flags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) booleans of byte rows: which n-grams each has."""
    n = len(offsets) - 1
    flags = np.zeros(n * BUCKETS, bool)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offsets))
    code = np.zeros(len(data), np.uint32)
    for k in range(GRAMS):
        m = len(data) - k
        if m <= 0:
            break
        code = code[:m] * np.uint32(2654435761) + data[k:].astype(np.uint32) + np.uint32(k * 97 + 1)
        h = code ^ (code >> np.uint32(15))
        h = (h * np.uint32(2246822519)) >> np.uint32(32 - 13)
        whole = row[:m] == row[k:]
        flags[(row[:m] + h)[whole]] = True
    return flags.reshape(n, BUCKETS)


def presence(column: pa.Array) -> np.ndarray:
    """(rows, BUCKETS) booleans: which n-grams a text has."""
    return _flags(*text_bytes(pc.utf8_lower(column)))


def _unit_rows(flags: np.ndarray) -> np.ndarray:
    x = flags.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))


def embed(column: pa.Array) -> np.ndarray:
    """(rows, BUCKETS): the mean of the unit vectors of all stretches of a text; a text of one stretch has length 1.

    The buckets of a whole long text would fill up until all languages look alike. The kernel of two texts is
    then the mean kernel of their stretches.
    """
    data, offsets = text_bytes(pc.utf8_lower(column))
    size = np.diff(offsets)
    parts = np.maximum(-(-size // STRETCH), 1)
    row = np.repeat(np.arange(len(size)), parts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][row] + place * size[row] // parts[row]
    stop = offsets[:-1][row] + (place + 1) * size[row] // parts[row]
    out = np.zeros((len(size), BUCKETS), np.float32)
    for k in range(0, len(row), TOGETHER):
        ends = np.concatenate([start[k : k + 1], stop[k : k + TOGETHER]])
        unit = _unit_rows(_flags(data[ends[0] : ends[-1]], ends - ends[0]))
        np.add.at(out, row[k : k + TOGETHER], unit / parts[row[k : k + TOGETHER], None].astype(np.float32))
    return out


def _code(text: pa.Array) -> list[bytes]:
    """Vectors of texts, small: bits where a text is one stretch, else half-precision numbers."""
    out = []
    for k in range(0, len(text), TOGETHER):
        column = text.slice(k, TOGETHER)
        for v in embed(column):
            some = v > 0
            whole = some.any() and np.ptp(v[some]) == 0
            out.append(np.packbits(some).tobytes() if whole or not some.any() else v.astype(np.float16).tobytes())
    return out


def _decode(code: bytes) -> np.ndarray:
    if len(code) > BUCKETS // 8:
        return np.frombuffer(code, np.float16).astype(np.float32)
    return _unit_rows(np.unpackbits(np.frombuffer(code, np.uint8)).astype(bool)[None])[0]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # (BUCKETS, landmarks)
    weights: np.ndarray  # (landmarks + 1, languages)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, languages) shares that sum to one."""
        kernel = vectors @ self.landmarks
        value = SHARPNESS * (np.column_stack([kernel, np.ones(len(kernel), np.float32)]) @ self.weights)
        value = np.exp(value - value.max(axis=1, keepdims=True))
        return value / value.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = source.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A hash of id and text picks some times as many rows as wanted, so that few texts meet; the window takes the first of them.
    share = source.groupBy("lang").agg((OVERSAMPLE * PER_LANGUAGE / F.count(F.lit(1))).alias("share"))
    drawn = known.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang").where(
        F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("share")
    )
    picked = drawn.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= PER_LANGUAGE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("n"), pa.array(_code(part.column("text")), pa.binary())], ["lang", "n", "code"])

    table = picked.select("text", "lang", "n").mapInArrow(rows, "lang string, n int, code binary").toArrow().sort_by([("lang", "ascending"), ("n", "ascending")])
    if not table.num_rows:
        return None
    names = np.array(table.column("lang").to_pylist())
    rank = table.column("n").to_numpy()
    x = np.stack([_decode(b) for b in table.column("code").to_pylist()])
    languages = sorted(set(names))
    landmarks = x[rank <= LANDMARKS].T.copy()
    inner = landmarks.T.astype(np.float64) @ landmarks
    # Nystroem: features K(x, landmarks) * K(landmarks, landmarks)^(-1/2).
    value, vector = np.linalg.eigh(inner)
    root = vector @ np.diag(1.0 / np.sqrt(np.maximum(value, 1e-6 * value.max()))) @ vector.T
    phi = (x @ landmarks).astype(np.float64) @ root
    y = np.where(names[:, None] == np.array(languages)[None], 1.0, -1.0)
    # Each language weighs the same, whatever its share of the sample.
    weight = np.array([1.0 / (names == k).sum() for k in names])
    a = np.column_stack([phi, np.ones(len(phi))])
    gram = (a * weight[:, None]).T @ a + RIDGE * np.diag([*np.ones(phi.shape[1]), 1e-6]) / len(languages)
    w = np.linalg.solve(gram, (a * weight[:, None]).T @ y)
    weights = np.vstack([root @ w[:-1], w[-1:]])
    return Model(languages, landmarks, weights.astype(np.float32))


def predict(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row."""
    model = fit(docs, id_col, text, lang)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n = part.num_rows
                names, best = np.full(n, UNKNOWN, object), np.zeros(n)
                letters = pc.match_substring_regex(part.column("text"), r"\p{L}").to_numpy(zero_copy_only=False)
                if model is not None and letters.any():
                    share = np.concatenate([model.score(embed(part.column("text").slice(i, TOGETHER))) for i in range(0, n, TOGETHER)])
                    names[letters] = np.array(model.languages, object)[share.argmax(axis=1)[letters]]
                    best[letters] = share.max(axis=1)[letters]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"]
                )

    doc_id = F.col(id_col).cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")
