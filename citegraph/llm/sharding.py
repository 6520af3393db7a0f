"""Balanced label propagation: linked documents move to their neighbours' shards while sizes stay even.

Links are equal texts (any key column may be given). Documents start in shards by a hash. In each round every group
of linked documents votes: the shard that holds most of them is where the others wish to go. How many bytes wish
to go from each shard to each other one is an 8 x 8 table; from it follow the shares that may move without
breaking the quotas, and a hash decides who does. State is kept per cell (group, chunk, first shard), not per document: a group
that is larger than a part of a shard is split into chunks that move on their own.

The last step makes sizes even (law `bytes`): overfull shards give documents, unlinked ones first and then groups
in one piece, to the others, along running sums. Shards end within about one document of each other.

Defined cases: a null text has no bytes (size 1) and is equal to the empty text; rows sharing a doc_id are
separate rows; a null doc_id is placed like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.llm.packing import BLOCK_ROWS, _running
from citegraph.session import Rounds, cut_lineage

SHARDS = 8
ROUNDS = 10
#: How far a shard may be above its even share while labels move.
SLACK = 0.05
#: A group is split into chunks of at most this part of a shard.
CHUNK = 1 / 16


def _unit(*columns: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def _loads(df: DataFrame, bytes_: str = "bytes") -> list[int]:
    out = [0] * SHARDS
    for row in df.groupBy("shard").agg(F.sum(bytes_).alias("b")).collect():  # at most SHARDS rows
        out[row["shard"]] = row["b"] or 0
    return out


def _propagate(cells: DataFrame, fixed: list[int], even: float) -> DataFrame:
    """Cells (digest, chunk, first, rows, bytes, shard) after label propagation under the quotas."""
    rounds = Rounds(cells.sparkSession)
    cells = rounds.step(cells)
    for k in range(ROUNDS):
        votes = cells.groupBy("digest", "shard").agg(F.sum("rows").alias("votes"))
        best = votes.groupBy("digest").agg(F.max_by("shard", F.struct("votes", F.xxhash64("digest", "shard"))).alias("best"))
        wish = cells.join(best, "digest")
        demand = {(r["shard"], r["best"]): r["b"] for r in wish.where("shard <> best").groupBy("shard", "best").agg(F.sum("bytes").alias("b")).collect()}
        if not demand:
            break
        load = [a + b for a, b in zip(fixed, _loads(cells))]
        share = {}
        for (i, j), b in demand.items():
            coming = sum(x for (_, t), x in demand.items() if t == j)
            going = sum(x for (s, _), x in demand.items() if s == j)
            share[i, j] = min(1.0, max(0.0, (1 + SLACK) * even - load[j] + 0.5 * going) / max(coming, 1))
        if max(share.values()) < 1e-3:
            break
        may = F.lit(0.0)
        for (i, j), p in share.items():
            may = F.when((F.col("shard") == i) & (F.col("best") == j), F.lit(p)).otherwise(may)
        moved = wish.withColumn("shard", F.when(_unit("digest", "chunk", F.lit(k)) < may, F.col("best")).otherwise(F.col("shard")))
        cells = rounds.step(moved.drop("best"))
    return cells


def _even_out(rows: DataFrame, n: int) -> DataFrame:
    """Move rows from overfull shards to the others until all hold their even share."""
    load = _loads(rows, "size")
    even = sum(load) / SHARDS
    surplus = {s: x - even for s, x in enumerate(load) if x > even}
    if not surplus:
        return rows
    blocks = max(1, ceil(n / BLOCK_ROWS))
    # Unlinked rows first; linked ones chunk by chunk.
    place = _unit(F.coalesce("digest", F.lit("")), F.coalesce("chunk", F.lit(0)), F.when(F.col("linked"), F.lit(0)).otherwise(F.col("row")))
    ordered = rows.withColumn("place", place + F.when(F.col("linked"), 1).otherwise(0)).withColumn("block", F.floor(F.col("place") * blocks))
    summed = cut_lineage(_running(ordered, "block", ["place", "row"], "size", "before", ("shard",)))
    give = F.lit(0.0)
    for s, x in surplus.items():
        give = F.when(F.col("shard") == s, F.lit(x)).otherwise(give)
    leaves = F.col("before") + F.col("size") / 2 <= give
    moving = summed.where(leaves)
    axis = _running(moving.withColumn("block", F.col("shard") * (2 * blocks + 2) + F.col("block")), "block", ["place", "row"], "size", "axis")
    # Shards with room take consecutive stretches of the axis.
    short = [s for s, x in enumerate(load) if x < even]
    target, upto = F.lit(short[-1]), 0.0
    bounds = []
    for s in short:
        upto += even - load[s]
        bounds.append((s, upto))
    for s, end in reversed(bounds[:-1]):
        target = F.when(F.col("axis") + F.col("size") / 2 < F.lit(end), F.lit(s)).otherwise(target)
    columns = rows.columns
    return summed.where(~leaves).select(*columns).unionByName(axis.withColumn("shard", target.cast("int")).select(*columns))


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        F.md5(value.cast("binary")).alias("digest"),
    )
    # Numbers of rows: repeated rows must differ. The table is written, so they stay.
    narrow = cut_lineage(narrow.withColumn("row", F.monotonically_increasing_id()))
    total = narrow.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    n, even = total["n"], (total["b"] or 0) / SHARDS
    groups = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).where("rows > 1")
    chunks = F.greatest(F.ceil(F.col("bytes") / F.lit(max(1.0, even * CHUNK))), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int").alias("chunks")
    rows = narrow.join(groups.select("digest", chunks), "digest", "left").select(
        "doc_id", "size", "text_crc32", "digest", "row", F.col("chunks").isNotNull().alias("linked"),
        F.pmod(F.xxhash64("row", F.lit("chunk")), F.col("chunks")).alias("chunk"), F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SHARDS)).cast("int").alias("first"),
    )
    rows = cut_lineage(rows)
    cells = rows.where("linked").groupBy("digest", "chunk", "first").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).withColumn("shard", F.col("first"))
    fixed = _loads(rows.where("NOT linked").withColumnRenamed("first", "shard"), "size")
    done = _propagate(cells, fixed, even).select("digest", "chunk", "first", F.col("shard").alias("moved"))
    placed = rows.join(done, ["digest", "chunk", "first"], "left").withColumn("shard", F.coalesce("moved", "first")).drop("moved", "first")
    evened = cut_lineage(_even_out(cut_lineage(placed), n))
    blocks = max(1, ceil(n / BLOCK_ROWS))
    slots = evened.withColumn("one", F.lit(1)).withColumn("block", F.floor(_unit("row") * blocks))
    slots = _running(slots, "block", ["row"], "one", "slot", ("shard",))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
