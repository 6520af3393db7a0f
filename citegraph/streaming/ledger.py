"""Tables that a stream writes together: a batch counts for all of them or for none.

Each committed batch leaves a *run*: for every table the rows it wrote, in folders of its own. A manifest names the runs that
count, oldest first, and the last batch; it is written after all of a run's files and put in place by one rename.
Readers take the newest manifest and the files it names: a batch that died between two tables is not seen, and one that comes
again is passed over.

A row replaces the row of its key in earlier runs, or takes it away (`gone`). Rows lie in parts by a hash of the columns
they are looked up by, as many parts as keep one to about `part_rows` rows. A lookup reads, of each run, the parts of its
keys alone. `compact` merges runs as soon as `fan` of one level stand side by side, so a row is written again once
per level, and there are fewer than `fan` runs of each level. A merge that dies leaves files that no manifest names;
`vacuum` removes such files.

One writer at a time; any number of readers. A part of one very frequent key is dealt over several files.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.functions.ranking import best_row
from citegraph.session import BROADCAST_BYTES, cut_lineage, measure

PART_ROWS = 100_000
FAN = 4
#: Hash values that parts are made of; a run has at most so many parts.
SLOTS = 1 << 14


@dataclass(frozen=True)
class Layout:
    """A table: its columns, the key whose last row counts, and the columns it is looked up by."""

    name: str
    schema: str
    key: tuple[str, ...]
    near: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]


@dataclass
class Run:
    """What one batch (or a merge of several) wrote: per table the number of its parts."""

    name: str
    level: int
    parts: dict[str, int]


@dataclass
class Manifest:
    version: int = 0
    batch: int = -1
    runs: list[Run] = field(default_factory=list)


def _slot(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(SLOTS)).cast("int")


class Ledger:
    def __init__(self, spark: SparkSession, root: str, layouts: Sequence[Layout], part_rows: int = PART_ROWS, fan: int = FAN) -> None:
        self.spark, self.root, self.part_rows, self.fan = spark, root.rstrip("/"), part_rows, fan
        self.layouts = {layout.name: layout for layout in layouts}

    # ── manifests ────────────────────────────────────────────────────────────

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        folder, fs = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        if not names:
            return Manifest()
        path, fs = self._path("manifests", names[-1])
        stream = fs.open(path)
        try:
            said = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(said["version"], said["batch"], [Run(**r) for r in said["runs"]])

    def _publish(self, new: Manifest) -> None:
        name = f"{new.version:020d}.json"
        draft, fs = self._path("manifests", f"_{name}.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": new.version, "batch": new.batch, "runs": [vars(r) for r in new.runs]}).encode()))
        stream.close()
        final, _ = self._path("manifests", name)
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{final} is there already: another writer is at work")

    # ── reading ──────────────────────────────────────────────────────────────

    def _rows(self, layout: Layout, run: Run, slots: list[int] | None = None) -> DataFrame:
        parts = run.parts[layout.name]
        rows = self.spark.read.schema(f"{layout.schema}, gone boolean, batch long, part int").parquet(f"{self.root}/runs/{run.name}/{layout.name}")
        if slots is not None:
            wanted = sorted({s % parts for s in slots})
            if len(wanted) < parts:
                rows = rows.where(F.col("part").isin(wanted))
        return rows.drop("part")

    def _newest(self, layout: Layout, runs: Sequence[Run], slots: list[int] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The last row of each key in `runs`, `gone` ones too."""
        found = [self._rows(layout, run, slots) for run in runs if run.parts.get(layout.name)]
        if not found:
            return self.spark.createDataFrame([], f"{layout.schema}, gone boolean, batch long")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        if keys is not None:
            rows = rows.join(keys, list(layout.near), "left_semi")
        return rows if len(found) == 1 else best_row(rows, layout.key, [F.desc("batch")])

    def read(self, name: str) -> DataFrame:
        """All rows that count now."""
        layout = self.layouts[name]
        return self._newest(layout, self.manifest().runs).where("NOT gone").select(*layout.columns)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows that count now whose `near` columns are among `keys`. At most `SLOTS` numbers come to the driver."""
        layout = self.layouts[name]
        keys = cut_lineage(keys.select(*layout.near).distinct())
        slots = [r["s"] for r in keys.select(_slot(layout.near).alias("s")).distinct().collect()]
        if not slots:
            return self.spark.createDataFrame([], layout.schema)
        small = measure(keys, *layout.near)[1] <= BROADCAST_BYTES
        rows = self._newest(layout, self.manifest().runs, slots, F.broadcast(keys) if small else keys)
        return rows.where("NOT gone").select(*layout.columns)

    # ── writing ──────────────────────────────────────────────────────────────

    def _write(self, layout: Layout, rows: DataFrame, run: str) -> int:
        """Lay rows out in parts; returns how many parts there are, 0 without rows. Rows are read twice: written ones are best."""
        rows = rows.select(*layout.columns, "gone", "batch")
        count = rows.count()
        if not count:
            return 0
        parts = min(SLOTS, 1 << math.ceil(math.log2(max(1, count / self.part_rows))))
        # `rebalance` lets Spark split the part of a very frequent key over several tasks.
        laid = rows.withColumn("part", _slot(layout.near) % parts).hint("rebalance", "part").sortWithinPartitions("part", *layout.near)
        laid.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/runs/{run}/{layout.name}")
        return parts

    def commit(self, batch: int, deltas: Mapping[str, DataFrame]) -> bool:
        """Write a batch's rows (columns of the layout, and `gone`), one per key; False if it was committed before."""
        now = self.manifest()
        if batch <= now.batch:
            return False
        name = f"{batch:012d}-{uuid.uuid4().hex[:8]}"
        parts, written = {}, {}
        for table, rows in deltas.items():
            columns = (*self.layouts[table].columns, "gone")
            if (id(rows), columns) not in written:  # rows that go into several layouts are computed once
                written[id(rows), columns] = cut_lineage(rows.select(*columns, F.lit(batch).cast("long").alias("batch")))
            parts[table] = self._write(self.layouts[table], written[id(rows), columns], name)
        self._publish(Manifest(now.version + 1, batch, [*now.runs, Run(name, 0, parts)]))
        return True

    def compact(self) -> int:
        """Merge the newest runs while `fan` of one level stand side by side; returns how many merges were made."""
        merges = 0
        while True:
            now = self.manifest()
            tail = now.runs[-self.fan :]
            if len(tail) < self.fan or len({r.level for r in tail}) > 1:
                return merges
            first = len(tail) == len(now.runs)
            name = f"merge-{now.version:012d}-{uuid.uuid4().hex[:8]}"
            parts = {}
            for layout in self.layouts.values():
                rows = self._newest(layout, tail)
                parts[layout.name] = self._write(layout, cut_lineage(rows.where("NOT gone") if first else rows), name)
            self._publish(Manifest(now.version + 1, now.batch, [*now.runs[: -self.fan], Run(name, tail[0].level + 1, parts)]))
            merges += 1

    def vacuum(self) -> list[str]:
        """Remove the runs that the newest manifest does not name, and older manifests. For times without readers or writers."""
        now = self.manifest()
        named = {r.name for r in now.runs}
        folder, fs = self._path("runs")
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named] if fs.exists(folder) else []
        folder, fs = self._path("manifests")
        old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() != f"{now.version:020d}.json"] if fs.exists(folder) else []
        for path in [*gone, *old]:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)
