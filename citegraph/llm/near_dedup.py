"""Near-duplicates by ProbMinHash: weighted shingles, exponential arrivals, banding, exact verification.

A document is the multiset of its five-word shingles (lower-cased words of letters and digits; a
shorter text is one shingle). Each shingle sends points of a Poisson process whose rate is its count;
every point falls on a random register, which keeps its earliest shingle. Two documents agree on
a register with the probability Jaccard similarity of their weights, which is the plain Jaccard
similarity where no shingle repeats. A shingle stops as soon as its next arrival is later than the latest register:
nearly all stop after one arrival.

Registers are banded into keys. In a bucket a few centres are compared with all members of other
classes, never all members with each other; verified links are contracted to classes, and
buckets that still hold several classes go on with further centres (16, then 4096 and so on) until each
pair of a bucket either shares a class or was compared. A comparison is exact. A pair is spared it where it cannot or
all but cannot reach the threshold:

- its bit sketches differ by more than chance allows at the threshold;
- of the shingles of either too many are in no other text that is still compared. If a share 1 - s of the weight of x is
  its own, and 1 - r of that of y, the similarity is at most 1 / (1/s + 1/r - 1). Texts for which this alone
  rules out any partner leave. In a large group of copies of one text, each changed in places of its own, those near
  the first text are linked to it in the first rounds, and nearly all other pairs fall to this bound: it is exact, so no link is lost.

So the only links lost are those that no band proposes (one in 1,500 at similarity 0.8, fewer above) or whose sketches
mislead (one in 4,000).

Vertices are different texts (equal word sequences), named by the number of one of their rows.

Defined cases: rows are kept or dropped by row, one of each class of texts, with the smallest doc_id (a row without an id
only if the class has none); rows sharing a doc_id are of one class, but of its texts that are no copies each keeps a row; a
null text or one without words is a copy only of such rows of its doc_id; a null doc_id is compared like any other, and its
class is null if no document of it has an id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from citegraph.llm.common import bitmap_bits, bitmap_of, fresh_name, in_bitmap, mix, pieces, words_of
from citegraph.operators.identity import connected_components
from citegraph.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
#: Rows whose registers a worker holds at a time, and pairs whose shingles it holds.
PIECE_ROWS, PIECE_PAIRS = 1024, 512
#: Arrivals that are drawn at a time: about ten arrays of so many numbers are held.
PIECE_ARRIVALS = 1 << 20
#: All registers give one bit each to a sketch (eight longs: a longer comparison is no longer compiled); the first BANDS * ROWS make the band keys.
REGISTERS = 512
SKETCH = REGISTERS // 64
#: Registers on which sketches of a pair at the threshold agree: the mean less three and a half standard deviations.
_SAME = THRESHOLD + (1 - THRESHOLD) / 2
AGREEING = int(REGISTERS * _SAME - 3.5 * (REGISTERS * _SAME * (1 - _SAME)) ** 0.5)
_U = np.uint64


def shingles_of(words, row: int, grams: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of the shingles of one row, with repeats."""
    span = words.of(row)
    n = span.stop - span.start
    if not n:
        return np.zeros(0, _U)
    if n < SHINGLE:
        out = np.zeros(1, _U)
        for h in words.hashes[span]:
            out = mix(out + h)
        return out
    positions, hashes = grams if grams is not None else words.grams(SHINGLE)
    lo, hi = np.searchsorted(positions, (span.start, span.stop))
    return hashes[lo:hi]


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) element hashes: per owner and register the element of the earliest arrival.

    Owners of like size advance together, several arrivals of each element at a time. Arrival k of an element depends
    on (element, k) alone; an element goes on while its time is below its owner's latest register.
    """
    time = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, _U)
    needed = 1.2 * REGISTERS * (np.log(REGISTERS) + 0.6)
    level = np.log2(np.maximum(np.bincount(owner, minlength=n), 1)).astype(int)
    for at in np.unique(level[owner]):
        like, most = np.flatnonzero(level[owner] == at), max(2, int(np.ceil(needed / 2**at)))
        for piece in range(0, len(like), max(1, PIECE_ARRIVALS // most)):  # a piece may end within an owner: its registers hold the least so far
            alive, draws = like[piece : piece + max(1, PIECE_ARRIVALS // most)], most
            now, drawn = np.zeros(len(alive)), 0
            while len(alive):
                k = (np.arange(drawn + 1, drawn + draws + 1).astype(_U)) * _U(0x9E3779B97F4A7C15)
                h = mix(element[alive][:, None] + k[None])
                t = now[:, None] + np.cumsum(-np.log(_unit(h)) / weight[alive][:, None], axis=1)
                cell = (owner[alive] * REGISTERS)[:, None] + (mix(h) & _U(REGISTERS - 1)).astype(np.int64)
                better = t < time[cell]
                c, v = cell[better], t[better]
                e = np.broadcast_to(element[alive][:, None], t.shape)[better]
                np.minimum.at(time, c, v)
                first = time[c] == v
                winner[c[first]] = e[first]
                own, place = np.unique(owner[alive], return_inverse=True)
                limit = time.reshape(n, REGISTERS)[own].max(axis=1)
                on = t[:, -1] < limit[place]
                alive, now, drawn = alive[on], t[on, -1], drawn + draws
                draws = max(2, draws // 4)
    return winner.reshape(n, REGISTERS)


def sketch_bits(winner: np.ndarray) -> np.ndarray:
    """One bit of each register, packed: a hash of the winner and the register's number.

    Of the winner alone it would be one bit for each shingle, and a text of few shingles would have few independent bits.
    """
    register = mix(np.arange(1, REGISTERS + 1, dtype=_U))
    return np.packbits((mix(winner + register[None]) & _U(1)).astype(np.uint8), axis=1)


def _digest(words, row: int) -> bytes:
    return hashlib.blake2b(words.hashes[words.of(row)].tobytes(), digest_size=16).digest()


def _blank_digest(doc_id: int | None) -> bytes | None:
    """Rows without words are copies where they share an id."""
    return None if doc_id is None else hashlib.blake2b(b"blank" + str(doc_id).encode(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", rows=PIECE_ROWS):
            words = words_of(part.column("text"))
            n = part.num_rows
            counts = np.diff(words.first)
            positions, hashes = words.grams(SHINGLE)
            owner, element = [words.rows[positions]], [hashes]
            for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
                owner.append(np.array([row]))
                element.append(shingles_of(words, row))
            own, elem = np.concatenate(owner), np.concatenate(element)
            order = np.lexsort((elem, own))
            own, elem = own[order], elem[order]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (elem[1:] != elem[:-1])
            at = np.flatnonzero(fresh)
            weight = np.diff(np.append(at, len(own))).astype(np.float64)
            every = prob_minhash(own[at], elem[at], weight, n)
            winner = every[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), _U) + mix(np.arange(1, BANDS + 1, dtype=_U))
            for r in range(ROWS):
                key = mix(key + winner[:, :, r])
            ids = part.column("doc_id").to_pylist()
            digests = [_digest(words, i) if counts[i] else _blank_digest(ids[i]) for i in range(n)]
            band = pa.FixedSizeListArray.from_arrays(pa.array(key.reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            blank = pa.array(counts == 0)
            band = pc.if_else(blank, pa.scalar(None, band.type), band)
            bits = sketch_bits(every).reshape(-1)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64)), SKETCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(digests, pa.binary()), band, sketch], ["row", "doc_id", "digest", "bands", "sketch"]
            )


def _shingle_rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc, shingles) of the `n` texts in `wanted` (doc, doc_id, digest). A Bloom filter of their ids spares the other texts; texts are not shuffled."""
    bits = bitmap_bits(n)
    holder = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "doc_id", bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            may = in_bitmap(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), holder.value, bits)
            batch = batch.filter(pa.array(may | pc.is_null(ids).to_numpy(zero_copy_only=False)))
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"))
                grams = words.grams(SHINGLE)
                digests, code = [], []
                for i in np.flatnonzero(np.diff(words.first)):
                    digest = _digest(words, i)
                    if digest not in seen:  # a task gives each text once
                        seen.add(digest)
                        digests.append(digest)
                        code.append(np.sort(shingles_of(words, i, grams)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(code, pa.binary())], ["digest", "shingles"])

    found = docs.mapInArrow(rows, "digest binary, shingles binary").join(wanted.select("doc", "digest"), "digest")
    return found.select("doc", "shingles").dropDuplicates(["doc"])


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two sorted shingle multisets (weights are counts)."""
    if not len(a) or not len(b):
        return 0.0
    ka, wa = np.unique(a, return_counts=True)
    kb, wb = np.unique(b, return_counts=True)
    keys = np.union1d(ka, kb)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, ka)] = wa
    y[np.searchsorted(keys, kb)] = wb
    both = (x > 0) & (y > 0)
    ratio, times = np.unique(x[both] / y[both], return_counts=True)
    # Elements of one ratio r = x/y share the denominator sum(max(x, r*y)) / x.
    total = 0.0
    for r in ratio:
        total += x[both][x[both] / y[both] == r].sum() / np.maximum(x, r * y).sum()
    return float(total)


def _hashes(code: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(code.as_buffer(), _U)


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, doc, share of the doc's weight) of rows (doc, shingles)."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE_PAIRS):
            part = batch.slice(k, PIECE_PAIRS)
            found = [np.unique(_hashes(c), return_counts=True) for c in part.column("shingles")]
            row = np.repeat(np.arange(len(found)), [len(e) for e, _ in found])
            share = np.concatenate([c / c.sum() for _, c in found]) if found else np.zeros(0)
            element = np.concatenate([e for e, _ in found]).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(element), part.column("doc").take(pa.array(row)), pa.array(share)], ["shingle", "doc", "share"])


def own_shares(shingles: DataFrame) -> DataFrame:
    """(doc, excess) of rows (doc, shingles): 1/s - 1, where s is the share of a doc's weight in shingles that any other row has too.

    Two docs have a similarity of 1 / (1 + excess of one + excess of the other) at most; null where nothing is shared.
    """
    weights = shingles.select("doc", "shingles").mapInArrow(_weights, "shingle long, doc long, share double")
    single = weights.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.first("doc").alias("doc"), F.first("share").alias("share")).where("n = 1")
    own = single.groupBy("doc").agg(F.sum("share").alias("own"))
    shared = F.lit(1.0) - F.coalesce("own", F.lit(0.0))
    return shingles.select("doc").join(own, "doc", "left").select("doc", F.when(shared > 1e-9, 1.0 / shared - 1.0).alias("excess"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, PIECE_PAIRS):
            batch = whole.slice(k, PIECE_PAIRS)
            value = [probability_jaccard(_hashes(x), _hashes(y)) for x, y in zip(batch.column("a_shingles"), batch.column("b_shingles"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())], ["a", "b", "similarity"])


def signatures(docs: DataFrame, row: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its number, doc_id, a digest of its words (without words one of its doc_id, or null), the band keys (null without words) and the bit sketch."""
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_signatures, "row long, doc_id long, digest binary, bands array<long>, sketch array<long>")


def _centres(bucket: DataFrame, n: int) -> DataFrame:
    """Up to `n` members of each bucket that were not centres of it yet, those that meet most documents first.

    Spark limits groups before the shuffle.
    """
    order = W.partitionBy("key").orderBy(F.desc("meets"), "doc")
    first = bucket.where("NOT done").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return first.select("key", F.col("doc").alias("centre"), *[F.col(c).alias(f"centre_{c}") for c in ("cls", "sketch", "bands", "excess", "meets")])


def _meetings(bucket: DataFrame, centres: DataFrame, most: float) -> DataFrame:
    """Members of each bucket beside its centres of another class, where sketches and own shingles leave a similarity possible.

    A member before a centre in their order is a centre too: two centres meet as the later of them meets the earlier, once.
    """
    after = (F.col("meets") < F.col("centre_meets")) | ((F.col("meets") == F.col("centre_meets")) & (F.col("doc") > F.col("centre")))
    may = (F.col("excess") + F.col("centre_excess") <= most) & (_agreement("sketch", "centre_sketch") >= AGREEING)
    return bucket.where("NOT done").join(centres, "key").where(after & (F.col("cls") != F.col("centre_cls")) & may)


def _agreement(a: str, b: str) -> Column:
    """On how many bits two sketches agree."""
    return sum((F.lit(64) - F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH)), F.lit(0))


def _leaders(links: DataFrame, meets: DataFrame) -> DataFrame:
    """(doc, cls): a common leader of linked documents, found in two jumps to the neighbour that meets most.

    Documents with one leader are of one class. Those of one class may have different leaders: then they are
    only compared more often than needed; the classes in the result come from all links.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(meets.select(F.col("doc").alias("v"), F.col("meets").alias("_m")), "v")
    best = near.groupBy("u").agg(F.max(F.struct(F.col("_m").alias("meets"), (-F.col("v")).alias("minus"))).alias("best"))
    own = best.join(meets.withColumnRenamed("doc", "u"), "u")
    up = own.select(F.col("u").alias("doc"), F.when(F.col("best") > F.struct(F.col("meets").alias("meets"), (-F.col("u")).alias("minus")), -F.col("best.minus")).otherwise(F.col("u")).alias("cls"))
    for _ in range(2):
        onward = up.select(F.col("doc").alias("cls"), F.col("cls").alias("_up"))
        up = up.join(onward, "cls", "left").select("doc", F.coalesce("_up", "cls").alias("cls"))
    return up


def _row_verdicts(docs: DataFrame, row: Column, id_col: str, text: str, threshold: float) -> DataFrame:
    """(row, doc_id, class_id, is_kept) per row of `docs`; `row` gives the rows different numbers."""
    sig = cut_lineage(signatures(docs, row, id_col, text))
    # Nulls last: a row without an id is kept only where no other is.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    copies = cut_lineage(sig.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order).alias("first")).withColumn("rep", F.col("first.row")))
    # Band keys once per different text.
    own = sig.where("bands IS NOT NULL").withColumnRenamed("row", "doc").join(copies.select(F.col("rep").alias("doc")), "doc")
    keys = own.select("doc", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut_lineage(keys.join(met, "key"))
    meets = cut_lineage(buckets.groupBy("doc").agg(F.sum("n").alias("meets")))
    # Sketches and bands join only those that meet any other.
    buckets = cut_lineage(buckets.drop("n").join(own.select("doc", "bands", "sketch").join(meets, "doc"), "doc").withColumn("done", F.lit(False)))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = copies.select(F.col("rep").alias("doc"), F.col("first.doc_id").alias("doc_id"), "digest").join(meets, "doc", "left_semi")
    shingles = cut_lineage(_shingle_rows(source, wanted, meets.count()))

    links = compared = None
    most = 1 / threshold - 1 + 1e-9  # of the excess of both of a pair
    live, n = buckets.withColumn("cls", F.col("doc")).withColumn("excess", F.lit(0.0)), 1
    while True:
        picked = cut_lineage(_centres(live, n))
        if picked.isEmpty():
            break
        near = _meetings(live, picked, most)
        if n > 1:
            # Most links are known by now. A pair that meets in several buckets is left to the one of the smallest key,
            # which goes on until it has compared all its pairs or holds one class.
            near = near.where(F.array_min(F.array_intersect("bands", "centre_bands")) == F.col("key"))
        pairs = near.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        left, right = (shingles.select(F.col("doc").alias(c), F.col("shingles").alias(f"{c}_shingles")) for c in ("a", "b"))
        judged = cut_lineage(
            pairs.join(left, "a").join(right, "b").select("a", "b", "a_shingles", "b_shingles").mapInArrow(_similar, "a long, b long, similarity double")
        )
        found = judged.where(F.col("similarity") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = found if links is None else links.unionByName(found)
        classes = cut_lineage(_leaders(links, meets))
        compared = judged.select("a", "b") if compared is None else compared.unionByName(judged.select("a", "b"))
        was = picked.select("key", F.col("centre").alias("doc"), F.lit(True).alias("was"))
        live = live.drop("cls").join(was, ["key", "doc"], "left").withColumn("done", F.col("done") | F.col("was").isNotNull()).drop("was")
        live = live.join(classes, "doc", "left").withColumn("cls", F.coalesce("cls", "doc"))
        # Buckets that hold several classes still, and two members that were not centres.
        several = live.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.sum(F.when(F.col("done"), 0).otherwise(1)).alias("open"))
        live = cut_lineage(live.join(several.where("lo <> hi AND open > 1").select("key"), "key", "left_semi"))
        if n > 1:  # the centres have had their say; what is left is bounded by what each text has of its own
            left = shingles.join(live.select("doc").distinct(), "doc", "left_semi")
            live = cut_lineage(live.drop("excess").join(own_shares(left).where(F.col("excess") <= most), "doc"))
        n *= 16 if n == 1 else 256

    if links is None:
        links = meets.select(F.col("doc").alias("u"), F.col("doc").alias("v")).limit(0)
    # Rows are kept by the classes of texts; classes are named after the texts of an id are linked too.
    texts = connected_components(links)
    several = sig.where("doc_id IS NOT NULL").join(copies.select("digest", "rep"), "digest").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    several = cut_lineage(several.select("doc_id", "lo"))
    verdict = copies.join(_best(texts, copies, "kept"), "rep", "left").withColumn("kept", F.coalesce("kept", "first"))
    verdict = verdict.withColumn("named", F.col("kept"))
    if not several.isEmpty():
        same_id = sig.join(several, "doc_id").join(copies.select("digest", "rep"), "digest").select(F.col("rep").alias("u"), F.col("lo").alias("v")).distinct()
        groups = connected_components(links.unionByName(same_id))
        verdict = verdict.drop("named").join(_best(groups, copies, "named"), "rep", "left").withColumn("named", F.coalesce("named", "first"))
    verdict = verdict.select("digest", F.col("kept.row").alias("kept"), F.col("named.doc_id").alias("named"))
    out = sig.select("row", "doc_id", "digest").join(verdict, "digest", "left")
    return out.select("row", "doc_id", F.coalesce("named", "doc_id").alias("class_id"), F.coalesce(F.col("row") == F.col("kept"), F.lit(True)).alias("is_kept"))


def _best(classes: DataFrame, copies: DataFrame, name: str) -> DataFrame:
    """(rep, `name`): for texts of (vertex, root) the first row of their class."""
    linked = classes.join(copies.select(F.col("rep").alias("vertex"), "first"), "vertex")
    return linked.join(linked.groupBy("root").agg(F.min("first").alias(name)), "root").select(F.col("vertex").alias("rep"), name)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, is_kept) per row of `docs`: the class is named by its smallest doc_id."""
    return _row_verdicts(docs, F.monotonically_increasing_id(), id_col, text, threshold).drop("row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns kept. The rows are written with their numbers, so that these stay."""
    row = fresh_name(docs, "row")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = _row_verdicts(rows, F.col(row), id_col, text, THRESHOLD).where("NOT is_kept").select(F.col("row").alias("gone"))
    return rows.join(gone, rows[row] == gone["gone"], "left_anti").drop(row)
