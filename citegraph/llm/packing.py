"""Packing into windows of 4096 tokens: strategies weighted by non-negative least squares.

1. Each text is tokenised; its ids (and an end id) are cut into full windows and a rest. The rest of one
   document in `POOL` (by a hash of its id, or of its row number where it has none) goes to the filler pool, with its ids; other pieces carry no ids.
2. Lengths are counted in bins of 32 tokens, 128 bins. Strategies are multisets of bins that fill a
   window: i pieces of one bin and j of another, and triples. Non-negative least squares finds how often each is
   used so that demand meets the histogram; counts are rounded down and capped by what is there.
3. Pieces left over are packed greedily: windows take the largest bins that fit, one after the other.
4. Each piece takes the slot of its rank in its bin. A window's free end (bins are upper bounds) is filled from
   the pool, cut freely: free ends and pool pieces are laid along one axis each and joined where
   they overlap. What the pool has left is laid end to end into windows of its own.

Only the histogram, the strategies and counts per block reach the driver or a single task. Ranks and running sums are
taken in blocks that grow in number with the rows.

Defined cases: a null or empty text is its end id alone; rows that share a doc_id are packed each, as they come; a null
doc_id is packed like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from citegraph.llm.common import SOLID_BYTES, hash_spans, pieces, segment, text_bytes
from citegraph.session import cut_lineage

WINDOW = 4096
END_ID = 2
BIN = 32
BINS = WINDOW // BIN
#: One document in so many lends its rest to fill windows up.
POOL = 6
#: Rows of a block in which ranks and running sums are taken.
BLOCK_ROWS = 20_000
#: Different words whose ids a worker remembers.
REMEMBER = 1_000_000
_LATIN = re.compile(r"[a-zà-öø-ÿ]+")
_U = np.uint64


class WordIds:
    """Token ids of whole batches: each different word is encoded once per worker.

    White space always parts tokens of this vocabulary, and so does the border between an ASCII letter and
    a mark such as a comma, so a text's ids are those of its parts in a row. ASCII and Latin-1 capitals are folded before
    parts are compared, as the tokenizer itself does, but for batches that hold special tokens' brackets.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in shown else next(hidden)) for b in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, _U)  # sorted hashes
        self.place = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _encode(self, word: bytes) -> list[int]:
        text = word.decode()
        if _LATIN.fullmatch(text):  # one run of lower-case letters: the model's merges alone
            return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.alphabet.__getitem__, word)))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, spans: list[bytes]) -> None:
        new = [self._encode(s) for s in spans]
        flat = np.fromiter((i for w in new for i in w), np.uint16)
        begin = self.start[-1] + np.cumsum([0, *map(len, new)])
        self.place = np.concatenate([self.place, np.arange(len(self.known), len(self.known) + len(new))])
        self.known = np.concatenate([self.known, hashes])
        self.start = np.concatenate([self.start, begin[1:]])
        self.ids = np.concatenate([self.ids, flat])
        order = np.argsort(self.known, kind="stable")
        self.known, self.place = self.known[order], self.place[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per row) of a large_string array without nulls."""
        data, offsets = text_bytes(column)
        inside = SOLID_BYTES[data]
        special = np.any((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else False
        starts, ends = segment(data, offsets, inside)
        if not special and len(data):
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
            after = np.flatnonzero(data[:-1] == 0xC3) + 1
            data[after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]] += 32
            letter = (data >= 97) & (data <= 122)
            cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        hashes = hash_spans(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self._forget()
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[starts[i] : ends[i]] for i in first[new]])
        slot = self.place[np.searchsorted(self.known, distinct)][which]
        begin, size = self.start[slot], self.start[slot + 1] - self.start[slot]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
        return ids, at[np.searchsorted(starts, offsets)]


#: ASCII marks that always stand apart from a letter before them and are in no special token.
_MARK = np.isin(np.arange(256), [ord(c) for c in '.,!?;:*&%$#"()=+-/'])


def tokenize(docs: DataFrame, tokenizer: str, id_col: str, text: str) -> DataFrame:
    """Pieces of at most a window: (doc_id, number, start, length, ids_crc32, doc_tokens, ids); `ids` only in the filler pool.

    `number` tells rows apart, whatever their ids; it holds once the result is written.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or WordIds(tokenizer)
            for part in pieces(batch, "text"):
                ids, at = words.encode(part.column("text"))
                pool = part.column("pool").to_pylist()
                out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for i in range(part.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]].astype("<u4"), np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(own), WINDOW):
                        piece = own[start : start + WINDOW].tobytes()
                        kept = piece if pool[i] and len(piece) < 4 * WINDOW else None
                        for k, v in zip(out, (i, start, len(piece) // 4, zlib.crc32(piece), len(own), kept)):
                            out[k].append(v)
                row = pa.array(out.pop("row"), pa.int64())
                kinds = {"ids": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("number").take(row), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], ["doc_id", "number", *out]
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("number", F.monotonically_increasing_id()).withColumn("pool", F.pmod(F.xxhash64(F.coalesce("doc_id", "number")), F.lit(POOL)) == 0)
    return source.mapInArrow(rows, "doc_id long, number long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def strategies() -> np.ndarray:
    """(strategies, BINS + 1) counts of bins, each filling a window: pairs with repeats, and triples."""
    out = {(BINS,): 1}
    for a in range(1, BINS):
        for b in range(a, BINS):
            for j in range(1, BINS // b + 1):
                rest = BINS - j * b
                if rest % a == 0:
                    out[tuple(sorted([b] * j + [a] * (rest // a)))] = 1
            c = BINS - a - b
            if c >= b:
                out[(a, b, c)] = 1
    table = np.zeros((len(out), BINS + 1))
    for i, bins in enumerate(out):
        np.add.at(table[i], list(bins), 1)
    return table


def solve_counts(table: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson), relative to each bin's size; rounded down, never above the histogram."""
    scale = 1.0 / np.sqrt(np.maximum(histogram, 1.0))
    a, b = (table * scale).T, histogram * scale
    x, active = np.zeros(len(table)), np.zeros(len(table), bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * max(1.0, b.max()):
            break
        active[best] = True
        while True:
            trial = np.zeros(len(table))
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if trial[active].min() > 0:
                x = trial
                break
            bad = active & (trial <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - trial[bad], 1e-300))
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(table), np.int64)
    for s in np.argsort(-x, kind="stable"):
        if x[s] <= 0:
            break
        use = table[s].astype(np.int64)
        has = use > 0
        counts[s] = max(0, min(int(x[s]), int((left[has] // use[has]).min())))
        left -= counts[s] * use
    return counts


def plan(histogram: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end rank, first window, pieces of this bin per window, place of the first) for every rank of every bin."""
    table = strategies()
    counts = solve_counts(table, histogram)
    used = np.zeros(BINS + 1, np.int64)
    ranges, window = [], 0
    for s in np.flatnonzero(counts):
        place = 0
        for b in np.flatnonzero(table[s]):
            per = int(table[s, b])
            ranges.append((int(b), int(used[b]), int(used[b] + per * counts[s]), window, per, place))
            used[b] += per * counts[s]
            place += per
        window += int(counts[s])
    left = histogram.astype(np.int64) - used
    while left.any():  # the greedy rest: largest bins first, a window's pattern as often as it lasts; each turn uses up a bin
        room, use = BINS, np.zeros(BINS + 1, np.int64)
        for b in np.flatnonzero(left)[::-1]:
            use[b] = min(left[b], room // b)
            room -= use[b] * b
        own = np.flatnonzero(use)
        times, place = int((left[own] // use[own]).min()), 0
        for b in own:
            per = int(use[b])
            ranges.append((int(b), int(used[b]), int(used[b] + per * times), window, per, place))
            used[b] += per * times
            place += per
        left -= times * use
        window += times
    return ranges


def _blocks(rows: int) -> int:
    return max(1, ceil(rows / BLOCK_ROWS))


def _running(df: DataFrame, block: str, order: list[str], value: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add `name`: the sum of `value` over earlier rows of the key; rows meet in blocks only, and blocks by their totals."""
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    out = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(totals, [*keys, block]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of the cuts of pool pieces."""
    for batch in batches:
        lo, n = batch.column("cut").to_numpy(), batch.column("length").to_numpy()
        crc = [zlib.crc32(memoryview(b.as_buffer())[4 * i : 4 * (i + k)]) for b, i, k in zip(batch.column("ids"), lo, n)]
        at = batch.schema.get_field_index("ids")
        yield batch.remove_column(at).append_column("ids_crc32", pa.array(crc, pa.int64()))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    spark = docs.sparkSession
    every = cut_lineage(tokenize(docs, tokenizer, id_col, text))
    final = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fixed = every.where("ids IS NULL").drop("ids").withColumn("bin", F.ceil(F.col("length") / BIN).cast("int"))
    histogram = np.zeros(BINS + 1)
    for row in fixed.groupBy("bin").count().collect():
        histogram[row["bin"]] = row["count"]
    n_blocks = _blocks(int(histogram.sum()))
    slots = fixed.withColumn("block", F.pmod(F.xxhash64("number", "start"), F.lit(n_blocks))).withColumn("one", F.lit(1))
    ranked = _running(slots, "block", ["number", "start"], "one", "rank", ("bin",)).drop("block", "one")
    schema = "bin int, lo long, hi long, window long, per int, place int"
    ranges = spark.createDataFrame(plan(histogram), schema)  # at most a few rows per strategy in use
    met = ranked.join(F.broadcast(ranges), "bin").where("rank >= lo AND rank < hi")
    placed = met.select(
        *final[:5], (F.col("window") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).alias("sequence_id"),
        (F.col("place") + (F.col("rank") - F.col("lo")) % F.col("per")).alias("place"),
    )
    inside = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = cut_lineage(placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("place"))

    # Free ends of windows, and pool pieces, each along an axis of tokens; then what overlaps.
    ends = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled")).withColumn("room", F.lit(WINDOW) - F.col("filled"))
    ends = _running(ends.withColumn("block", F.floor(F.col("sequence_id") / BLOCK_ROWS)), "block", ["sequence_id"], "room", "from").where("room > 0")
    ends = cut_lineage(ends.select("sequence_id", F.col("filled").alias("base"), "from", (F.col("from") + F.col("room")).alias("to")))
    sums = ends.agg(F.max("to").alias("room")).first()
    room = sums["room"] or 0
    last = placed.agg(F.max("sequence_id")).first()[0]
    windows = 0 if last is None else int(last) + 1
    pool = every.where("ids IS NOT NULL")
    # These rows carry their ids, so fewer of them make a block.
    pool = pool.withColumn("block", F.pmod(F.xxhash64("number", "start"), F.lit(_blocks(10 * pool.count()))))
    pool = _running(pool, "block", ["number", "start"], "length", "from").drop("block", "ids_crc32", "start", "number").withColumn("to", F.col("from") + F.col("length")).drop("length")
    pool = cut_lineage(pool)
    total = pool.agg(F.max("to")).first()[0] or 0
    # Windows of the pool alone, beyond the free ends.
    rest = max(0, total - room)
    more = spark.range(ceil(rest / WINDOW)).select(
        (F.lit(windows) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("base"), (F.lit(room) + F.col("id") * WINDOW).alias("from"),
        (F.lit(room) + (F.col("id") + 1) * WINDOW).alias("to"),
    )
    tile = lambda c: F.explode(F.sequence(F.floor(F.col("from") / WINDOW), F.floor((F.col("to") - 1) / WINDOW))).alias(c)
    holes = ends.unionByName(more).select("sequence_id", "base", F.col("from").alias("h_from"), F.col("to").alias("h_to"), tile("tile"))
    parts = pool.select("doc_id", "doc_tokens", "from", "to", "ids", tile("tile"))
    lo, hi = F.greatest("from", "h_from"), F.least("to", "h_to")
    both = parts.join(holes, "tile").withColumn("_lo", lo).withColumn("_hi", hi).where("_lo < _hi").where(F.floor(F.col("_lo") / WINDOW) == F.col("tile"))
    # A rest's first id is the document's id number doc_tokens - (its length).
    cuts = both.select(
        "doc_id", (F.col("doc_tokens") - (F.col("to") - F.col("from")) + F.col("_lo") - F.col("from")).alias("start"), (F.col("_hi") - F.col("_lo")).alias("length"),
        "doc_tokens", "sequence_id", (F.col("base") + F.col("_lo") - F.col("h_from")).alias("offset"), (F.col("_lo") - F.col("from")).alias("cut"), "ids",
    )
    filled = cuts.mapInArrow(
        _cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cut long, ids_crc32 long"
    )
    return placed.select(*final).unionByName(filled.select(*final))
