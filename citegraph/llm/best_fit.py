"""Best-fit packing into sequences of 4096 tokens, in rounds that place a document in every gap at once.

A round takes the pieces that have no place yet and the gaps of all open sequences, and gives each piece, from
the longest down, the smallest gap that no longer piece took (best fit):

1. Pieces and gaps are sorted by size, gaps first among equals, over range partitions. Downwards, a
   gap is put on a stack and a piece takes the gap on top: its successor in size among the free ones.
2. Each task sweeps its stretch. Its stack is a level: the number of gaps less pieces so far, which never falls
   below zero. On each level gaps and pieces alternate, and a piece takes the gap before it on its level.
3. Pieces that found their stretch's stack empty take what earlier stretches (larger gaps) left. Only how many
   pieces and gaps each stretch left reaches the driver, which deals out ranks; pieces and gaps meet by (stretch, rank).
4. Gaps shrink by what they took, and the next round begins. A piece longer than all gaps will never fit one: for
   those, as many new sequences are opened as their tokens fill at least. A gap twice as large as the longest piece
   left, or more, is offered in equal parts, each large enough for any piece.

All pieces are placed when a round leaves none; each round places one piece in each gap that any fits, so their number goes
with the pieces in a sequence, and less where pieces are short. The rows of a round are (number, length) and
(sequence, gap); token ids are only seen while texts are tokenised, and what a round reads was written by the one before.

Defined cases: a null or empty text is its end id alone; a text of more than 4096 ids, end id with it, is cut into pieces of 4096, and its
last piece is packed like a document; rows that share a doc_id, and rows without one, are documents of their own, told apart by a written row number;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from citegraph.llm.common import pieces
from citegraph.llm.packing import WordIds
from citegraph.session import cut_lineage

WINDOW = 4096
END_ID = 1
#: Rows of a stretch that one task sweeps.
SWEEP_ROWS = 200_000
_SWEPT = "number long, size int, sequence long, place int, state int, part int, rank long"
PLACED, WAITING, FREE = 0, 1, 2


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end id, cut at every 4096th."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or WordIds(tokenizer)
            for part in pieces(batch, "text"):
                ids, at = words.encode(part.column("text"))
                out: list[tuple[int, int, int, int, int]] = []
                for i in range(part.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]].astype("<u4"), np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), WINDOW)):
                        piece = own[start : start + WINDOW]
                        out.append((i, k, start, len(piece), zlib.crc32(piece.tobytes())))
                row, *columns = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def match(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the gap that each piece takes or -1, which gaps stay) along a row of gaps and pieces, by a stack."""
    step = np.where(is_gap, 1, -1)
    height = np.cumsum(step)
    floor = np.minimum(np.minimum.accumulate(height), 0)
    before = np.concatenate([[0], floor[:-1]])
    met = is_gap | (height >= before)  # a piece that makes a new low has no gap
    level = height - before + np.where(is_gap, 0, 1)
    taken = np.full(len(is_gap), -1, np.int64)
    at = np.flatnonzero(met)
    at = at[np.lexsort((at, level[at], before[at]))]
    if len(at) > 1:
        pair = is_gap[at[:-1]] & ~is_gap[at[1:]] & (level[at[:-1]] == level[at[1:]]) & (before[at[:-1]] == before[at[1:]])
        taken[at[1:][pair]] = at[:-1][pair]
    free = is_gap.copy()
    free[taken[taken >= 0]] = False
    return taken, free


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One stretch, sorted: pieces with their gap, pieces without (ranked from the first), free gaps (ranked from the last)."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    number, sequence, size, place, part = (table.column(c).to_numpy() for c in ("number", "sequence", "size", "place", "part"))
    is_gap = table.column("is_gap").to_numpy(zero_copy_only=False).astype(bool)
    taken, free = match(is_gap)
    placed, waiting = np.flatnonzero(~is_gap & (taken >= 0)), np.flatnonzero(~is_gap & (taken < 0))
    free = np.flatnonzero(free)[::-1]
    rows = np.concatenate([placed, waiting, free])
    gap = np.where(is_gap, np.arange(len(is_gap)), taken)[rows]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(number[rows]), pa.array(size[rows].astype(np.int32)), pa.array(sequence[gap], mask=gap < 0), pa.array(place[gap].astype(np.int32), mask=gap < 0),
            pa.array(np.repeat([PLACED, WAITING, FREE], [len(placed), len(waiting), len(free)]).astype(np.int32)), pa.array(part[rows].astype(np.int32)),
            pa.array(np.concatenate([np.zeros(len(placed), np.int64), np.arange(len(waiting)), np.arange(len(free))])),
        ],
        [c.split()[0] for c in _SWEPT.split(", ")],
    )


def carry(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Deal earlier stretches' free gaps to later stretches' pieces: (stretch of pieces, first rank, end rank, stretch of gaps, its first rank).

    `left`: (stretch, pieces waiting, gaps free) in order, larger sizes first. At most two rows per stretch come out.
    """
    out, stack = [], []
    for part, waiting, free in left:
        rank = 0
        while rank < waiting and stack:
            source, used, end = stack.pop()
            n = min(waiting - rank, end - used)
            out.append((part, rank, rank + n, source, used))
            rank += n
            if used + n < end:
                stack.append((source, used + n, end))
        if free:
            stack.append((part, 0, free))
    return out


def one_round(waiting: DataFrame, gaps: DataFrame, longest: int, rows: int) -> DataFrame:
    """(number, size, sequence, place) of all waiting pieces; sequence is null where a piece found no gap. Written."""
    spark = waiting.sparkSession
    share = F.greatest(F.lit(1), F.floor(F.col("gap") / longest).cast("int"))
    offered = gaps.withColumn("share", share).select(
        F.lit(True).alias("is_gap"), F.lit(0).cast("long").alias("number"), "sequence", F.floor(F.col("gap") / F.col("share")).cast("int").alias("size"),
        F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("place"),
    )
    asking = waiting.select(F.lit(False).alias("is_gap"), "number", F.lit(0).cast("long").alias("sequence"), F.col("length").cast("int").alias("size"), F.lit(0).alias("place"))
    parts = max(1, math.ceil(rows / SWEEP_ROWS))
    order = [F.desc("size"), F.desc("is_gap"), F.asc("number"), F.asc("sequence"), F.asc("place")]
    every = offered.unionByName(asking).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    swept = cut_lineage(every.mapInArrow(_sweep, _SWEPT))
    counts = swept.groupBy("part").agg(F.count_if(F.col("state") == WAITING).alias("w"), F.count_if(F.col("state") == FREE).alias("f")).collect()
    dealt = carry(sorted((r["part"], r["w"], r["f"]) for r in counts))
    placed = swept.where(F.col("state") == PLACED).select("number", "size", "sequence", "place")
    without = swept.where(F.col("state") == WAITING)
    if dealt:
        ranges = F.broadcast(spark.createDataFrame(dealt, "part int, low long, high long, source int, base long"))  # two rows a stretch at most
        met = without.drop("sequence", "place").join(ranges, (without["part"] == ranges["part"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
        met = met.select("number", "size", "source", (F.col("base") + F.col("rank") - F.col("low")).alias("taken"))
        free = swept.where(F.col("state") == FREE).select(F.col("part").alias("source"), F.col("rank").alias("taken"), "sequence", "place")
        without = met.join(free, ["source", "taken"], "left")
    return cut_lineage(placed.unionByName(without.select("number", "size", "sequence", "place")))


def place_all(numbered: DataFrame) -> DataFrame:
    """(number, sequence_id, round, place) of every (number, length) row."""
    spark = numbered.sparkSession
    waiting = numbered.where(F.col("length") < WINDOW).select("number", "length")
    gaps = spark.createDataFrame([], "sequence long, gap int")
    placed, opened, turn = [], 0, 0
    while True:
        room = gaps.agg(F.max("gap").alias("g"), F.count(F.lit(1)).alias("n")).first()
        most = room["g"] or 0
        fits = F.col("length") <= most
        left = waiting.agg(
            F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.sum(F.when(~fits, F.col("length"))).alias("tokens")
        ).first()
        if not left["n"]:
            break
        new = math.ceil((left["tokens"] or 0) / WINDOW)
        if new:
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("sequence"), F.lit(WINDOW).alias("gap"))
            gaps, opened = gaps.unionByName(fresh), opened + new
        gaps = gaps.where(F.col("gap") >= left["shortest"])
        done = one_round(waiting, gaps, left["longest"], left["n"] + (room["n"] + new) * max(1, WINDOW // left["longest"]))
        here = done.where(F.col("sequence").isNotNull())
        placed.append(here.select("number", F.col("sequence").alias("sequence_id"), F.lit(turn).alias("round"), "place"))
        waiting = done.where(F.col("sequence").isNull()).select("number", F.col("size").cast("long").alias("length"))
        taken = here.groupBy("sequence").agg(F.sum("size").cast("int").alias("taken"))
        gaps = cut_lineage(gaps.join(taken, "sequence", "left").select("sequence", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"))
        turn += 1
    # Full pieces fill a sequence each, under the numbers after those that were opened.
    full = numbered.where(F.col("length") == WINDOW).select("number", (F.col("number") + opened).alias("sequence_id"), F.lit(0).alias("round"), F.lit(0).alias("place"))
    for part in placed:
        full = full.unionByName(part)
    return full


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    every = cut_lineage(tokenize(docs, tokenizer, id_col, text).withColumn("number", F.monotonically_increasing_id()))
    placed = place_all(every.select("number", "length"))
    inside = W.partitionBy("sequence_id").orderBy("round", "place", "number").rowsBetween(W.unboundedPreceding, -1)  # 4096 pieces at most
    out = every.join(placed, "number").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
