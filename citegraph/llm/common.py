"""What the operators of this folder share: fresh names, splits, and word hashes of whole Arrow batches.

Word hashing works on the UTF-8 bytes of a batch at once. `Words` holds, for a piece of a batch, where
each word lies and a 64-bit hash of it; n-grams of words are hashed from those. Hashes depend on
nothing but the bytes, so every task and every run gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that are worked on at a time. A longer text is a piece of its own, whole.
PIECE_BYTES = 1 << 20
_U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text and at most `rows` rows, at least one row each; nulls in `text` are empty."""
    column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    batch = batch.set_column(batch.schema.get_field_index(text), text, column)
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        stop = stop if rows is None else min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets start at 0."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0xD1342543DE82EF95)
_BASE_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_GRAM = _U(0xAF251AF3B0F025B5)
#: Bytes whose prefix sums are held at a time: spans that begin within a stretch, and may reach into the next.
STRETCH = 1 << 20
_UP = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * STRETCH, _BASE, _U)]), dtype=_U)
_DOWN = np.cumprod(np.concatenate([np.ones(1, _U), np.full(STRETCH, _BASE_INVERSE, _U)]), dtype=_U)


@dataclass
class Words:
    """Words of a piece: byte spans, 64-bit hashes, the row of each word, and per row its first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    first: np.ndarray

    def of(self, row: int) -> slice:
        return slice(self.first[row], self.first[row + 1])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the n-word windows that lie within one row."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        out = np.zeros(m, _U)
        for k in range(n):
            out = out * _GRAM + self.hashes[k : k + m]
        inside = np.flatnonzero(self.rows[:m] == self.rows[n - 1 :])
        return inside, mix(out[inside])


#: Bytes of words: ASCII letters and digits and all of every non-ASCII character.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes of what white space parts: all but space and 9 to 13.
SOLID_BYTES = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def segment(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the runs of `inside` bytes; a run ends where its row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span, equal for equal bytes wherever they lie; spans may come in any order and overlap.

    Prefix sums cover a stretch at a time, so a long text takes no more than its bytes and the sums of two stretches.
    """
    out = np.zeros(len(starts), _U)
    long = ends - starts > STRETCH
    for i in np.flatnonzero(long):  # its parts, each raised to its place
        total = 0
        for lo in range(int(starts[i]), int(ends[i]), STRETCH):
            part = _BYTE[data[lo : min(lo + STRETCH, int(ends[i]))]]
            total += int(np.sum(part * _UP[: len(part)], dtype=_U)) * pow(int(_BASE), lo - int(starts[i]), 1 << 64)
        out[i] = total % (1 << 64)
    rising = len(starts) < 2 or bool((starts[1:] >= starts[:-1]).all())
    order = np.arange(len(starts)) if rising else np.argsort(starts, kind="stable")
    if long.any():
        order = order[~long[order]]
    first, begin = 0, starts[order]
    while first < len(order):
        base = begin[first]
        last = int(np.searchsorted(begin, base + STRETCH, "left"))
        own = order[first:last]
        at, to = starts[own] - base, ends[own] - base
        reach = int(to.max())
        sums = np.zeros(reach + 1, _U)
        np.cumsum(_BYTE[data[base : base + reach]] * _UP[:reach], out=sums[1:], dtype=_U)
        out[own] = (sums[to] - sums[at]) * _DOWN[at]
        first = last
    return mix(out)


def words_of(column: pa.Array, lower: bool = True, inside: np.ndarray = WORD_BYTES) -> Words:
    """Words of a large_string array without nulls, lower-cased by default."""
    if lower:
        column = pc.utf8_lower(column)
    data, offsets = text_bytes(column)
    starts, ends = segment(data, offsets, inside[data])
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(starts, ends, hash_spans(data, starts, ends), rows, first)


def word_hash(words: Iterable[str]) -> np.ndarray:
    """Hashes of single words as `words_of` gives them."""
    listed = list(words)
    if not listed:
        return np.zeros(0, _U)
    data, offsets = text_bytes(pc.utf8_lower(pa.array(listed, pa.large_string())))
    return hash_spans(data, offsets[:-1], offsets[1:])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last weight is the intercept. `y` may be soft."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * max(len(x), 1))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `per_class` documents of each label (0, 1) that may be learnt from, by a hash of the id.

    Ids are picked before texts are joined. An id with several labels counts as 1 if most say so.
    """
    rated = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg((F.avg("label") > 0.5).cast("int").alias("label"))
    )
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    picks = [
        rated.where(F.col("label") == k).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(per_class).drop("_h") for k in (0, 1)
    ]
    picked = picks[0].unionByName(picks[1])  # at most 2 * per_class rows
    sample = known.join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return sample.dropDuplicates(["doc_id"])


def bitmap_of(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter (two probes, 2^bits bits) of a long column, put together in Spark; the driver receives the bitmap alone."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(probes(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at))], ["bit"])

    found = values.select(F.col(column).cast("long").alias("v")).where("v IS NOT NULL").mapInArrow(positions, "bit long")
    word = found.groupBy((F.col("bit") / 64).cast("long").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), _U)
    table = word.toArrow()
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(_U)
    return out


def probes(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(values.view(_U))
    return (h >> _U(64 - bits)).astype(np.int64), (h & _U((1 << bits) - 1)).astype(np.int64)


def in_bitmap(values: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which values may be in the filter; those that are in it always are."""
    hit = np.ones(len(values), bool)
    for probe in probes(values, bits):
        hit &= (table[probe >> 6] >> (probe & 63).astype(_U)) & _U(1) == 1
    return hit


def bitmap_bits(rows: int) -> int:
    """Sixteen bits a row, from 8 KB to at most 64 MB whatever the rows."""
    return int(min(29, max(16, np.ceil(np.log2(max(rows, 1) * 16)))))
