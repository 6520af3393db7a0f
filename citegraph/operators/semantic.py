"""Nearest vectors by cosine: cells of a coarse k-means, probed by the query, and an exact ranking of what they hold.

1. Centres are fitted by Lloyd's rounds on a bounded sample of the vectors (`SAMPLE` rows, by a hash of the id); each
   round is an aggregation per cell, and the driver holds the centres alone.
2. Every vector is put into the cell of its nearest centre. Cells are as many as the square root of the rows, at most `MOST_CELLS`.
3. A query probes its nearest cells: it is written once for each, and meets the cell's vectors in a group of the
   cell number, a salt and a block of queries, so that a very large cell or very many queries are dealt over tasks. A group
   multiplies its queries with its vectors a stretch at a time, adds the best up again in the order of the dimensions (so equal
   vectors have equal cosines, whatever the matrix product rounds), and gives the best of each query; then the best are kept per query.
4. With `exact`, a query then goes on to every cell that may hold a better vector: a cell's vectors lie within its radius, so
   none has a smaller angle to the query than the centre's angle less the radius. What is skipped is proved to be worse.

Vectors without entries, with a null or a number that is not finite, of another length than most, or of length zero have
no direction: they are neither found nor do they find anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from citegraph.session import cut_lineage

SAMPLE, ROUNDS, MOST_CELLS = 20_000, 6, 4096
#: Vectors of a cell that one group ranks, and queries that it ranks them for, at most; cosines of a group that are held at a time.
SALT_ROWS = QUERY_ROWS = 20_000
HELD = 4_000_000
#: By how much two ways of adding up the cosine of unit vectors may differ, generously.
_ROUNDING = 1e-9


def unit_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v ARRAY<DOUBLE>) of length 1; of several dimensions the most frequent stays."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    rows = vectors.select(F.col(id_col).alias("id"), entries.alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    rows = rows.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    rows = rows.select("id", F.transform("v", lambda c: c / F.col("norm")).alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centres(units: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres by Lloyd's rounds over the sample; an empty cell keeps its centre."""
    sample = cut_lineage(units.withColumn("_h", F.xxhash64("id", "v")).orderBy("_h").limit(SAMPLE).drop("_h"))
    first = sample.orderBy(F.xxhash64(F.lit(1), "id", "v")).limit(cells).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0))
    centres = _matrix(first.column("v").combine_chunks())
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)  # noqa: B023
            for batch in batches:
                v = _matrix(batch.column("v"))
                near = (v @ now.T).argmax(axis=1)  # noqa: B023
                np.add.at(total, near, v)
                count += np.bincount(near, minlength=len(now))  # noqa: B023
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "total"])

        part = sample.mapInArrow(sums, "cell int, total array<double>").select("cell", F.posexplode("total").alias("i", "x"))
        found = part.groupBy("cell", "i").agg(F.sum("x").alias("x")).toArrow()  # cells x dimensions numbers
        centres = centres.copy()
        centres[found.column("cell").to_numpy(), found.column("i").to_numpy()] = found.column("x").to_numpy()
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Cells:
    """Unit vectors by cell (id, v, cell, salt), per cell how many salts it has, and the centres and radii (in radians)."""

    rows: DataFrame
    salts: DataFrame
    centres: np.ndarray
    radii: np.ndarray

    def _near(self, units: DataFrame, probes: int) -> DataFrame:
        centres, k = self.centres, min(probes, len(self.centres))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cosine = _matrix(batch.column("v")) @ centres.T
                    near = (cosine.argmax(axis=1)[:, None] if k == 1 else np.argsort(-cosine, axis=1, kind="stable")[:, :k]).astype(np.int32)
                    yield batch.append_column("cells", pa.array(list(near), pa.list_(pa.int32())))

        return units.mapInArrow(rows, "id long, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))


    def _further(self, units: DataFrame, probes: int) -> DataFrame:
        """(id, v, least, cell) of cells beyond the `probes` nearest that may hold a vector within `reach` (radians) of a unit."""
        centres, radii, k = self.centres, self.radii, min(probes, len(self.centres))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cosine = _matrix(batch.column("v")) @ centres.T
                    order = np.argsort(-cosine, axis=1, kind="stable")[:, k:]
                    angle = np.arccos(np.clip(cosine, -1, 1)) - radii[None]
                    may = angle <= batch.column("reach").to_numpy()[:, None] + 1e-6
                    cells = [o[m[o]].astype(np.int32) for o, m in zip(order, may)]
                    yield batch.drop_columns(["reach"]).append_column("cells", pa.array(cells, pa.list_(pa.int32())))

        return units.mapInArrow(rows, "id long, v array<double>, least double, cells array<int>").select("id", "v", "least", F.explode("cells").alias("cell"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> Cells:
    """Index every row that has a direction."""
    units = cut_lineage(unit_vectors(vectors, id_col, vector))
    count = units.count()
    cells = Cells(units, units, fit_centres(units, max(1, min(MOST_CELLS, math.isqrt(count)))), np.zeros(0))
    if not count:
        return cells
    placed = cut_lineage(cells._near(units, 1))
    centres = cells.centres

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                cosine = np.einsum("ij,ij->i", _matrix(batch.column("v")), centres[cell])
                yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(np.arccos(np.clip(cosine, -1, 1)))], ["cell", "angle"])

    radii = np.zeros(len(centres))
    for row in placed.mapInArrow(widths, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r")).collect():  # a row per cell
        radii[row["cell"]] = row["r"]
    salts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))  # a row per cell
    salted = placed.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("salts")).cast("int")).drop("salts")
    return Cells(cut_lineage(salted), cut_lineage(salts), centres, radii)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a table, and which are null."""
    column = table.column("id")
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def _rank(queries: pa.Table, vectors: pa.Table, top: int) -> pa.Table:
    """(query_id, id, cosine): for each query its `top` vectors with a cosine of `least` or more, but those of its own id; ties by id, null last."""
    out = []
    if queries.num_rows and vectors.num_rows:
        q, v = _matrix(queries.column("v").combine_chunks()), _matrix(vectors.column("v").combine_chunks())
        (ask, ask_null), (ids, null) = _ids(queries), _ids(vectors)
        least, last = queries.column("least").to_numpy(), len(v) - min(top + 1, len(v))  # one more: its own row may be among them
        step = max(1, HELD // len(v))
        for at in range(0, len(q), step):
            cosine = q[at : at + step] @ v.T
            own = (ask[at : at + step, None] == ids[None]) & (ask_null[at : at + step, None] == null[None])
            cosine[own] = -np.inf
            bound = np.maximum(np.partition(cosine, last, axis=1)[:, last], least[at : at + step]) - _ROUNDING
            i, j = np.nonzero((cosine >= bound[:, None]) & ~own)
            exact = np.zeros(len(i))
            for d in range(q.shape[1]):
                exact += q[at + i, d] * v[j, d]
            order = np.lexsort((ids[j], null[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)
            kept = (np.arange(len(i)) - first < top) & (exact >= least[at + i])
            out.append((at + i[kept], j[kept], exact[kept]))
    i, j, exact = (np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, np.float64)))
    return pa.table({"query_id": queries.column("id").take(pa.array(i)), "id": vectors.column("id").take(pa.array(j)), "cosine": pa.array(exact)})


def _best(cells: Cells, probed: DataFrame, blocks: int, top: int) -> DataFrame:
    """(query_id, id, cosine): the best rows of the cells that queries (id, v, least, cell) probe, which come in `blocks`."""
    asked = probed.join(F.broadcast(cells.salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = asked.select("cell", "salt", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "v", "least")
    held = cells.rows.select("cell", "salt", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("id").cast("long").alias("id"), "v")
    group = ("cell", "salt", "block")
    met = asked.groupBy(*group).cogroup(held.groupBy(*group))
    return met.applyInArrow(lambda queries, vectors: _rank(queries, vectors, top), "query_id long, id long, cosine double")


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("cosine"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def nearest(
    cells: Cells, queries: DataFrame, top: int = 10, probes: int = 16, exact: bool = False, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, cosine): the `top` rows for each query, but those of the query's own id; ties by id."""
    asked = cut_lineage(unit_vectors(queries, id_col, vector).withColumn("id", F.col("id").cast("long")))
    if not len(cells.centres):
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("cosine")).limit(0)
    blocks = math.ceil(max(1, asked.count()) / QUERY_ROWS)
    near = cells._near(asked, probes).withColumn("least", F.lit(-2.0))
    found = cut_lineage(_first(_best(cells, near, blocks, top), ["query_id"], top))
    if exact:
        # The angle of the last of the best; without so many, anything may be nearer. What has a smaller cosine is no better.
        last = found.where(F.col("rank") == top).select(
            F.col("query_id").alias("id"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))).alias("reach"), F.col("cosine").alias("least")
        )
        reach = asked.join(last, "id", "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"), F.coalesce("reach", F.lit(math.pi)).alias("reach"))
        more = _best(cells, cells._further(reach, probes), blocks, top)
        found = _first(found.drop("rank").unionByName(more), ["query_id"], top)
    return found.select("query_id", "rank", "id", "cosine")
