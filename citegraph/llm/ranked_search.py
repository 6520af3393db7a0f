"""Ranked lexical search: accumulators of short lists, walked as one more iterator beside the long lists.

1. Index. Each task reads whole texts and writes *segments*: the postings (document, term frequency) of the query set's terms
   in some `SEGMENT_BYTES` of text, grouped by term, with every document's number of terms. A segment is one row.
2. Statistics over all documents: N, L, and the document frequency of each term, added up from the segments.
3. Search, per segment and query. The term's lists are sorted by length. The short ones, as long as they hold a quarter as
   many postings as the segment has documents, are taken a term at a time: their scores are summed into
   accumulators. Those are then one iterator like any other, with a bound of its own (its largest sum), next to the
   long lists, each with the largest score of its postings. Documents are walked in stretches. Iterators whose bounds
   together stay below the worst of the best documents so far are not walked: they are only looked up, by
   binary search, for documents that the others bring, and a document is given up once what it has and what is
   left cannot reach that score. The best documents of a query go along from segment to segment of a task.
4. A task returns its best documents of each query; these meet in two steps, first by query and salt, then by query.

A score is the same whole number as the plain sum over all terms; no list, document or posting is left out
but by bounds. Queries go in blocks of bounded size (by a hash of their text), and each block reads the documents
once; equal queries are searched once. Terms are told apart by a 64-bit hash.

Defined cases: a null text, or one without terms, has none: such a document is not counted and such a query finds nothing.
Rows are documents, whatever their ids: repeated rows are found each. Ties go to the smaller id, null ids last; between
rows of one id and score any order is the same result. Without documents or queries the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from citegraph.llm.common import WORD_BYTES, hash_spans, pieces, segment, text_bytes
from citegraph.session import cut_lineage

TOP = 20
#: Text of one segment of the index; a longer text is one of its own.
SEGMENT_BYTES = 16 << 20
#: Text of the queries whose terms the driver and each task hold at a time.
QUERY_BYTES = 4 << 20
#: Lists are short while they hold together one posting for so many documents of a segment.
SHORT_SHARE = 4
#: Documents of a stretch.
STRETCH_DOCS = 1024
#: First steps of the merge of the tasks' results.
SALTS = 64
_INDEX = "ids array<long>, lengths binary, terms array<int>, dfs array<int>, docs binary, tfs binary, n_docs long, n_terms long"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the terms, offsets per row) of a large_string array without nulls; A to Z are lower-cased, nothing else."""
    data, offsets = text_bytes(column)
    data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends = segment(data, offsets, WORD_BYTES[data])
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Segments of the documents' postings of `terms` (sorted hashes); a term's code is its place there."""

    def flush(ids: list, lengths: list, parts: list) -> pa.RecordBatch:
        codes, at, tfs = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*parts)) or ((), (), ())))
        order = np.argsort(codes, kind="stable")  # documents already rise within a code
        own, dfs = np.unique(codes, return_counts=True)
        n = np.concatenate(lengths)
        row = (
            [pa.concat_arrays(ids).to_pylist()], [n.astype(np.int64).tobytes()], [own.astype(np.int32)], [dfs.astype(np.int32)], [at[order].astype(np.int32).tobytes()],
            [tfs[order].astype(np.int32).tobytes()], [int((n > 0).sum())], [int(n.sum())],
        )
        kinds = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [part.split()[0] for part in _INDEX.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, parts, size, base = [], [], [], 0, 0
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, first = terms_of(part.column("text"))
                k = len(first) - 1
                row = np.repeat(np.arange(k), np.diff(first))
                code = np.searchsorted(terms, hashes)
                known = terms[np.minimum(code, len(terms) - 1)] == hashes if len(terms) else np.zeros(len(hashes), bool)
                key, tf = np.unique(code[known] * k + row[known], return_counts=True)
                ids.append(part.column("doc_id"))
                lengths.append(np.diff(first))
                parts.append((key // k, key % k + base, tf))
                size, base = size + part.column("text").nbytes, base + k
                if size >= SEGMENT_BYTES:
                    yield flush(ids, lengths, parts)
                    ids, lengths, parts, size, base = [], [], [], 0, 0
        if ids:
            yield flush(ids, lengths, parts)

    return docs.mapInArrow(rows, _INDEX)


@dataclass
class Statistics:
    """N, L and the weight of each term code; `impact` is what a posting counts before its weight."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        wide = 25 * int(n.max(initial=0)) * self.n_docs >= 1 << 62
        m = 75 + (25 * (n.astype(object) if wide else n.astype(np.int64)) * self.n_docs) // self.n_terms
        return ((10**9 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)).astype(np.int64)


def statistics(segments: DataFrame, n_codes: int) -> Statistics:
    """Over all segments; the driver receives one number per term of the block."""
    sums = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    pairs = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.dfs").alias("df"))
    n_docs, weights = sums["n"] or 0, np.zeros(n_codes, np.int64)
    table = pairs.toArrow()
    for code, df in zip(table.column("term").to_pylist(), table.column("df").to_pylist()):
        weights[code] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return Statistics(n_docs, sums["l"] or 0, weights)


class Best:
    """The best documents of a query so far; `threshold` is the score that a document must reach."""

    def __init__(self, top: int) -> None:
        self.top, self.threshold = top, 1
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        keep = np.lexsort((ids, null, -scores))[: self.top]
        self.scores, self.ids, self.null = scores[keep], ids[keep], null[keep]
        if len(keep) == self.top:
            self.threshold = int(self.scores[-1])


@dataclass
class Iter:
    """An iterator over rising documents: what each adds to the score (times `factor`), and the most that any adds."""

    docs: np.ndarray
    scores: np.ndarray
    bound: int
    factor: int = 1


def iterators(lists: list[Iter], n_docs: int) -> list[Iter]:
    """The short lists as one iterator of summed accumulators, and the long ones as they are; by falling bound."""
    lists = sorted(lists, key=lambda it: len(it.docs))
    filled, short = 0, 0
    while short < len(lists) and filled + len(lists[short].docs) <= n_docs / SHORT_SHARE:
        filled += len(lists[short].docs)
        short += 1
    out = lists[short:]
    if short:
        sums = np.zeros(n_docs, np.int64)
        for it in lists[:short]:  # a term at a time; a list holds a document once
            sums[it.docs] += it.scores * it.factor
        docs = np.flatnonzero(sums)
        if len(docs):
            out.append(Iter(docs, sums[docs], int(sums[docs].max())))
    return sorted(out, key=lambda it: -it.bound)


def walk(its: list[Iter], n_docs: int, ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Put the documents of a segment that can be among the best into `best`; returns how many documents were scored in full or part."""
    bounds = np.array([it.bound for it in its], np.int64)
    left = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])  # left[k]: what iterators k and later may add
    at, seen = [0] * len(its), 0
    for low in range(0, n_docs, STRETCH_DOCS):
        lead = int(np.count_nonzero(left[:-1] >= best.threshold))  # iterators that are walked; never more than before
        if not lead:
            break
        high = min(low + STRETCH_DOCS, n_docs)
        score = np.zeros(high - low, np.int64)
        for k in range(lead):
            it = its[k]
            start = at[k]
            stop = start + int(np.searchsorted(it.docs[start : start + high - low], high))
            score[it.docs[start:stop] - low] += it.scores[start:stop] * it.factor
            at[k] = stop
        docs = np.flatnonzero(score)
        seen += len(docs)
        value = score[docs]
        docs = docs + low
        for k in range(lead, len(its) + 1):
            alive = value + left[k] >= best.threshold
            docs, value = docs[alive], value[alive]
            if k == len(its) or not len(docs):
                break
            it = its[k]
            place = np.searchsorted(it.docs, docs)
            place[place == len(it.docs)] = 0
            value = value + np.where(it.docs[place] == docs, it.scores[place] * it.factor, 0)
        if len(docs):
            best.add(value, ids[docs], null[docs])
    return seen


def search_segments(segments: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], stats: Statistics, top: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents of each query, given as (term codes, repeats)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: E731, B023
                ids = get("ids").values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                n = np.frombuffer(get("lengths").as_buffer(), np.int64)
                docs, tfs = (np.frombuffer(get(c).as_buffer(), np.int32) for c in ("docs", "tfs"))
                codes, dfs = (get(c).values.to_numpy(zero_copy_only=False) for c in ("terms", "dfs"))
                if not len(codes):
                    continue
                impact, stop = stats.impact(tfs, n[docs]), np.cumsum(dfs)
                bound = np.maximum.reduceat(impact, stop - dfs)
                for (own, repeats), found in zip(queries, best):
                    place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    factor = np.where(codes[place] == own, repeats * stats.weights[own], 0)
                    if int((bound[place] * factor).sum()) < found.threshold:
                        continue
                    lists = [
                        Iter(docs[stop[p] - dfs[p] : stop[p]], impact[stop[p] - dfs[p] : stop[p]], int(bound[p] * f), int(f)) for p, f in zip(place, factor) if f > 0
                    ]
                    walk(iterators(lists, len(n)), len(n), ids, null, found)
        for q, found in enumerate(best):
            if len(found.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.scores), q, np.int32)), pa.array(found.ids, mask=found.null), pa.array(found.scores)], ["query", "doc_id", "score"]
                )

    return segments.mapInArrow(rows, "query int, doc_id long, score long")


def _block(docs: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(key, rank, doc_id, score) of one block of different queries (key, text)."""
    spark = docs.sparkSession
    table = queries.toArrow()  # at most some QUERY_BYTES, or one longer query
    hashes, first = terms_of(table.column("text").combine_chunks().cast(pa.large_string()))
    terms = np.unique(hashes)
    asked = [np.unique(np.searchsorted(terms, hashes[a:b]), return_counts=True) for a, b in zip(first, first[1:])]
    segments = cut_lineage(index(docs, terms))
    stats = statistics(segments, len(terms))
    found = search_segments(segments, asked, stats, top).withColumn("salt", F.spark_partition_id() % SALTS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (("query", "salt"), ("query",)):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    keys = spark.createDataFrame(list(enumerate(table.column("key").to_pylist())), "query int, key string")
    return found.join(F.broadcast(keys), "query").select("key", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with a score above 0, best first."""
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    asked = asked.withColumn("key", F.sha2("text", 256))
    different = cut_lineage(asked.groupBy("key").agg(F.first("text").alias("text")))
    size = different.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for k in range(blocks):
        part = _block(source, different.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k), top)
        found = part if found is None else found.unionByName(part)
    return asked.drop("text").join(found, "key").select("item_id", "rank", "doc_id", "score")
