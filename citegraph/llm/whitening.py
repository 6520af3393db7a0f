"""Whitening of embeddings: covariances from variances of dimensions and of sums of two dimensions.

Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), so a matrix of covariances follows from squares alone:

1. Entries become whole numbers x; one aggregation gives the row count n and the sums S of each dimension.
2. Each task adds up, over its rows, the squares of the centred values of every dimension and of the sum of every two
   dimensions. Values are centred by the whole number next to the mean, and what that leaves (at most one half) is put right
   in whole numbers afterwards, so (n * x - S)^2 is summed without any rounding. Spark adds up the tasks' sums as decimals.
3. The driver receives one number per dimension and pair, takes differences of variances, and finds the
   eigenvectors of the matrix. Rows are projected in a last pass, and the covariance of what came out is
   aggregated to measure how far it is from the identity.

Rows are read three times and never shuffled; what is shuffled are d * (d + 1) / 2 numbers per task, d being the dimensions.

Defined cases: a row goes if its vector is null, or holds a null, a NaN, an infinity or a number whose x is no 64-bit integer. Of
several vector lengths the most frequent one counts (of equally frequent ones the longest) and rows of others go. Repeated
rows and ids, and null ids, each count as rows of their own. A component whose eigenvalue is not above rounding (d * 2^-52 of
the largest) has no direction of its own and is left out: none is left if all rows are equal or there is one. A
`deviation` beyond 64 bits is null in the query (the operator's is a decimal). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: x = floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
COMPONENTS = 32
#: Numbers held at a time while squares of pairs are added up, and rows while they are projected.
CHUNK_NUMBERS, CHUNK_ROWS = 1 << 19, 4096
_SAFE = 1 << 62
_LOW = 32
_HALF = 10**18


@dataclass
class Fit:
    """What the rows are projected with: `weights` has a column per component, scaled to variance 1."""

    n: int
    sums: list[int]
    values: np.ndarray
    weights: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(kept rows' numbers by vector length as x, rows of each) of a list column; rows with an entry that has no x are in none."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # leaves null lists out
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        bad = ~(np.abs(scaled) < 2.0**62)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    broken = np.zeros(len(sizes), bool)
    broken[row[bad]] = True
    x = np.where(bad, 0, scaled).astype(np.int64) + ORIGIN
    out, rows = {}, {}
    for d in np.unique(sizes[(sizes > 0) & ~broken]):
        pick = (sizes == d) & ~broken
        out[int(d)] = x[pick[row]].reshape(-1, d)
        rows[int(d)] = np.flatnonzero(pick)
    return out, rows


class Exact:
    """Sums of 64-bit columns without overflow: a high and a low part of each."""

    def __init__(self, width: int) -> None:
        self.high, self.low = np.zeros(width, np.int64), np.zeros(width, np.int64)

    def add(self, sums: np.ndarray) -> None:
        self.high += sums >> _LOW
        self.low += sums & ((1 << _LOW) - 1)

    def total(self) -> list[int]:
        return [(int(h) << _LOW) + int(v) for h, v in zip(self.high, self.low)]


def _decimal(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def _halves(values: list[int]) -> list[pa.Array]:
    """Whole numbers of any size as two decimals that Spark can add up."""
    return [_decimal([v // _HALF for v in values]), _decimal([v % _HALF for v in values])]



def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """(rows, sums of x per dimension) of the most frequent vector length; (0, []) without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        sums: dict[int, Exact] = {}
        for batch in batches:
            for d, x in whole_numbers(batch.column(0))[0].items():
                count[d] = count.get(d, 0) + len(x)
                acc = sums.setdefault(d, Exact(d))
                for part in (x[i : i + CHUNK_ROWS] for i in range(0, len(x), CHUNK_ROWS)):
                    acc.high += (part >> _LOW).sum(axis=0)
                    acc.low += (part & ((1 << _LOW) - 1)).sum(axis=0)
        for d, acc in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([count[d]] * d, pa.int64()), *_halves(acc.total())],
                ["d", "i", "n", "high", "low"],
            )

    parts = vectors.mapInArrow(add, "d int, i int, n long, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    best = found.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).select("d").collect()
    if not best:
        return 0, []
    rows = found.where(F.col("d") == best[0]["d"]).orderBy("i").collect()  # one row per dimension
    return rows[0]["n"], [int(r["high"]) * _HALF + int(r["low"]) for r in rows]


def squares(vectors: DataFrame, n: int, sums: list[int]) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Sums over rows of y_i^2 (key (i, i)) and (y_i + y_j)^2 (key (i, j), i < j), y = x - centre; and the sums of y_i. All exact."""
    d = len(sums)
    centre = Fit(n, sums, np.zeros(0), np.zeros(0), np.zeros(0)).centre
    left, right = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, any_row = Exact(len(left)), False
        rest = [0] * len(left)
        step = max(1, CHUNK_NUMBERS // len(left))
        for batch in batches:
            x = whole_numbers(batch.column(0))[0].get(d)
            for k in range(0, 0 if x is None else len(x), step):
                any_row = True
                y = x[k : k + step] - centre
                top = int(np.abs(y).max())
                if 4 * top * top * len(y) < _SAFE:
                    pair = y[:, left]
                    pair += np.where(left == right, 0, 1) * y[:, right]
                    acc.add(np.einsum("ij,ij->j", pair, pair))
                else:  # too large for 64 bits: Python's whole numbers
                    for row in y.tolist():
                        for p, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
                            rest[p] += (row[i] + (row[j] if i != j else 0)) ** 2
        if any_row:
            both = [a + b for a, b in zip(acc.total(), rest)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), *_halves(both)], ["i", "j", "high", "low"])

    parts = vectors.mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0)")
    table = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow()  # d * (d + 1) / 2 rows
    columns = (table.column(c).to_pylist() for c in ("i", "j", "high", "low"))
    found = {(i, j): int(high) * _HALF + int(low) for i, j, high, low in zip(*columns)}
    return found, [s - n * int(m) for s, m in zip(sums, centre)]


def covariance(n: int, square: dict[tuple[int, int], int], rest: list[int]) -> np.ndarray:
    """The covariance matrix of x, each entry rounded once. With u = n * y - rest the sum of u^2 is n * (n * sum y^2 - (sum y)^2)."""
    d = len(rest)
    spread = {(i, j): n * (n * s - (rest[i] + (rest[j] if i != j else 0)) ** 2) for (i, j), s in square.items()}
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * spread[i, i] if i == j else spread[i, j] - spread[i, i] - spread[j, j]
            out[i, j] = out[j, i] = twice / (2 * n**3)  # whole numbers: a correctly rounded quotient
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of all rows of a one-column table of vectors; None without rows."""
    n, sums = totals(vectors)
    if not n:
        return None
    square, rest = squares(vectors, n, sums)
    v = covariance(n, square, rest)
    values, directions = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    floor = len(sums) * np.finfo(float).eps * max(float(values.max()), 0.0)
    order = order[values[order] > floor][:components]
    kept = values[order]
    trace = float(np.trace(v))
    return Fit(n, sums, kept, directions[:, order] / np.sqrt(kept), kept / trace if trace > 0 else kept)


def project(x: np.ndarray, model: Fit) -> tuple[list[int], np.ndarray]:
    """(sum over dimensions of (n * x - S)^2, exact; whitened values) of rows of x."""
    y = x - model.centre
    rest = np.array([s - model.n * int(m) for s, m in zip(model.sums, model.centre)], object)
    exact = y.astype(object) * model.n - rest if model.n * (int(np.abs(y).max(initial=0)) + 1) >= _SAFE else y * model.n - rest.astype(np.int64)
    top = int(np.abs(exact).max(initial=0))
    if exact.dtype != object and top * top * x.shape[1] >= _SAFE:
        exact = exact.astype(object)
    deviation = (exact * exact).sum(axis=1)
    white = (y - (rest / model.n).astype(float)) @ model.weights
    return [int(v) for v in deviation], white


def _whitened(model: Fit):
    d = len(model.sums)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[int], np.ndarray]]:
        for batch in batches:
            x, rows = whole_numbers(batch.column(batch.num_columns - 1))
            if d not in x:
                continue
            for k in range(0, len(x[d]), CHUNK_ROWS):
                yield batch.column(0).take(pa.array(rows[d][k : k + CHUNK_ROWS])), *project(x[d][k : k + CHUNK_ROWS], model)

    return chunks


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), aggregated over the rows."""
    k = model.weights.shape[1]
    if not k:
        return 0.0
    left, right = np.triu_indices(k)
    chunks = _whitened(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, means = np.zeros((k, k)), np.zeros(k)
        for _, _, white in chunks(batches):
            products += white.T @ white
            means += white.sum(axis=0)
        at = [*zip(left.tolist(), right.tolist()), *((-1, i) for i in range(k))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([*products[left, right], *means])], ["i", "j", "s"]
        )

    table = vectors.mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for i, j, s in zip(*(table.column(c).to_pylist() for c in ("i", "j", "s"))):
        if i < 0:
            mean[j] = s / model.n
        else:
            cov[i, j] = cov[j, i] = s / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) per kept row and component, from 1 by falling variance."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = embeddings.select(F.col(vector).alias("v"))
    model = fit(vectors, components)
    if model is None or not model.weights.shape[1]:
        return spark.createDataFrame([], schema)
    error = identity_error(vectors, model)
    k = model.weights.shape[1]
    chunks = _whitened(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, deviation, white in chunks(batches):
            each = pa.array(np.repeat(np.arange(len(deviation)), k))
            m = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(deviation))), pa.array(np.full(m, model.n)), _decimal(deviation).take(each),
                    pa.array(white.reshape(-1)), pa.array(np.tile(model.explained, len(deviation))), pa.array(np.full(m, error)),
                ],
                [part.split()[0] for part in schema.split(", ")],
            )

    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(rows, schema)
