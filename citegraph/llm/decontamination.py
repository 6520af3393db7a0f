"""Benchmark decontamination by greedy string tiling over seeds shared with the test items.

Seeds are the five-word windows (lower-cased words of letters and digits) of the items. A Bloom filter
of the item seeds, of fixed size whatever their number, tells which documents can share one; for those the
seeds are joined exactly with the items'. Each (document, item) pair that shares a seed is tiled: the
longest common run of words that are still unmarked is marked in both, again and again, down to
five words; runs are found by a rolling (Karp-Rabin) hash whose length is bisected. An item is leaked if its
tiles cover at least half of its words, in whatever order they stand in the document.

Defined cases: null and empty texts share nothing; an item of fewer than five words is never matched; equal items are each reported;
repeated rows are each searched (once per different doc_id and text); a null doc_id is searched and
reported as null; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citegraph.llm.common import bitmap_of, fresh_name, in_bitmap, pieces, words_of
from citegraph.session import cut_lineage

MIN_TILE = 5
COVERAGE = 0.5
#: Bits of the Bloom filter (4 MB); two probes. Beyond about ten million seeds it lets more documents through to the join.
FILTER_BITS = 25
_U = np.uint64
_ROLL = _U(0x9E3779B97F4A7C15)


def item_seeds(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item_id, n_words, words, seed): one row per item and different seed; `words` are 64-bit hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"))
                at, seeds = words.grams(MIN_TILE)
                own = words.rows[at]
                code = [words.hashes[words.of(i)].tobytes() for i in range(part.num_rows)]
                seed = [np.unique(seeds[own == i]).view(np.int64) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), pa.array(np.diff(words.first)), pa.array(code, pa.binary()), pa.array(seed, pa.list_(pa.int64()))],
                    ["item_id", "n_words", "words", "seeds"],
                )

    source = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "item_id long, n_words long, words binary, seeds array<long>")


def _longest_runs(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Starts (in a, in b) of common runs of length n, by rolling hashes confirmed word by word. 0 words are marked and match nothing."""
    def rolled(x: np.ndarray) -> np.ndarray:
        power = np.cumprod(np.full(len(x) + 1, _ROLL, _U), dtype=_U)
        sums = np.zeros(len(x) + 1, _U)
        np.cumsum(x * power[:-1], out=sums[1:], dtype=_U)
        marks = np.concatenate(([0], np.cumsum(x == 0)))
        m = len(x) - n + 1
        h = (sums[n:] - sums[:m]) * power[len(x) - np.arange(m)]
        h[marks[n:] > marks[:m]] = 0
        return h

    if n > min(len(a), len(b)):
        return []
    ha, hb = rolled(a), rolled(b)
    # Normalise both to one power: multiply by what is missing to the longer text.
    gap = len(a) - len(b)
    if gap > 0:
        hb = np.where(hb == 0, hb, hb * np.cumprod(np.full(gap, _ROLL, _U), dtype=_U)[-1])
    elif gap < 0:
        ha = np.where(ha == 0, ha, ha * np.cumprod(np.full(-gap, _ROLL, _U), dtype=_U)[-1])
    common = np.intersect1d(ha[ha != 0], hb[hb != 0])
    if not len(common):
        return []
    where_b: dict[int, list[int]] = {}
    for j in np.flatnonzero(np.isin(hb, common)):
        where_b.setdefault(int(hb[j]), []).append(int(j))
    found = []
    for i in np.flatnonzero(np.isin(ha, common)):
        for j in where_b.get(int(ha[i]), ()):
            if np.array_equal(a[i : i + n], b[j : j + n]):
                found.append((int(i), j))
                break
    return found


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first, none overlapping."""
    a, b = doc.copy(), item.copy()
    a[a == 0], b[b == 0] = 1, 1
    tiles = []
    top = min(len(a), len(b))
    while top >= min_tile:
        lo, hi, best = min_tile, top, []
        while lo <= hi:  # a common run of length n has one of every shorter length
            mid = (lo + hi) // 2
            runs = _longest_runs(a, b, mid)
            if runs:
                best, length, lo = runs, mid, mid + 1
            else:
                hi = mid - 1
        if not best:
            break
        for i, j in best:
            if a[i : i + length].all() and b[j : j + length].all():
                tiles.append((i, j, length))
                a[i : i + length] = 0
                b[j : j + length] = 0
        top = length
    return tiles


def shared_seeds(docs: DataFrame, bits: np.ndarray, id_col: str, text: str) -> DataFrame:
    """(doc_id, words, seeds) of the documents that may share a seed: all their word hashes, and the seeds in question."""
    holder = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = holder.value
        for batch in batches:
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"))
                at, seeds = words.grams(MIN_TILE)
                hit = in_bitmap(seeds, table, FILTER_BITS)
                own, found = words.rows[at[hit]], seeds[hit]
                which = np.unique(own)
                code = [words.hashes[words.of(i)].tobytes() for i in which]
                some = [np.unique(found[own == i]).view(np.int64) for i in which]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(which)), pa.array(code, pa.binary()), pa.array(some, pa.list_(pa.int64()))], ["doc_id", "words", "seeds"]
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, words binary, seeds array<long>")


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, items = batch.column("words").to_pylist(), batch.column("item_words").to_pylist()
        tiles = [tile(np.frombuffer(d, _U), np.frombuffer(i, _U)) for d, i in zip(docs, items)]
        covered, count = ([f(x) for x in tiles] for f in (lambda x: sum(t[2] for t in x), len))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("item_id"), batch.column("n_words"), pa.array(covered, pa.int64()), pa.array(count, pa.int64())],
            ["doc", "item_id", "n_words", "covered", "n_tiles"],
        )


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, covered, n_tiles, coverage) for each leaked item of each document."""
    known = cut_lineage(item_seeds(items, item_id, item_text).withColumn("item", F.monotonically_increasing_id()))
    seeds = known.select("item", F.explode("seeds").alias("seed"))
    found = cut_lineage(shared_seeds(docs, bitmap_of(seeds, "seed", FILTER_BITS), id_col, text).withColumn("doc", F.md5("words")))
    # Documents with the same words and id share their pairs.
    texts = found.dropDuplicates(["doc"]).select("doc", "words", "seeds")
    pairs = texts.select("doc", F.explode("seeds").alias("seed")).join(seeds, "seed").select("doc", "item").distinct()
    wide = pairs.join(texts.select("doc", "words"), "doc").join(known.select("item", "item_id", "n_words", F.col("words").alias("item_words")), "item")
    judged = wide.mapInArrow(_tiled, "doc string, item_id long, n_words long, covered long, n_tiles long")
    hit = judged.withColumn("coverage", F.col("covered") / F.col("n_words")).where(F.col("coverage") >= coverage)
    return found.select("doc", "doc_id").join(hit, "doc").drop("doc").select("doc_id", "item_id", "n_words", "covered", "n_tiles", "coverage")


def drop_leaked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without a leaked item, all columns kept, whatever their id. The rows are written with numbers, by which they go."""
    row = fresh_name(docs, "row")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = leaks(rows, items, row, text).select(F.col("doc_id").alias("gone")).distinct()
    return rows.join(gone, rows[row] == gone["gone"], "left_anti").drop(row)
