import random

import pytest
from pyspark.sql import functions as F

from citegraph.operators import store_sync
from citegraph.sources.emission import Emission
from citegraph.streaming import emissions as em
from citegraph.streaming.ledger import Layout, Ledger
from tests.helpers import rows, rows_read



def a(text):
    scheme, value = text.split(":")
    return (scheme, value)


def emission(spark, records, edges):
    """records: (id, source, kind, aliases, attrs, time); edges: (src, dst, source, time)."""
    rec = [(i, s, k, [a(x) for x in al], attrs, at, n) for n, (i, s, k, al, attrs, at) in enumerate(records)]
    edg = [(a(x), a(y), "cites", s, f"{{{s}}}", at, n) for n, (x, y, s, at) in enumerate(edges)]
    schema = spark.createDataFrame([], em.ROW).schema
    return Emission(
        spark.createDataFrame(rec, schema["record"].dataType), spark.createDataFrame(edg, schema["edge"].dataType), spark.createDataFrame([], "reason string, count long")
    )


BATCHES = [
    ([("r1", "p", "work", ["doi:1"], "one", "2024-01"), ("r2", "p", "work", ["pmid:2"], "two", "2024-03"), ("r3", "q", "author", ["orcid:3"], "x", "1"),
      ("r9", "z", "work", [], "nobody", "1")],
     [("doi:1", "doi:9", "p", "1"), ("pmid:2", "doi:9", "p", "2"), ("doi:7", "doi:1", "p", "1")]),
    # doi:1 and pmid:2 are one work: claims, edges and aliases of the loser move, and the newer claim of p stands.
    ([("r5", "q", "work", ["doi:1", "pmid:2"], "both", "2023-01"), ("r4", "q", "venue", ["issn:4"], "v", "1")],
     [("doi:1", "doi:9", "p", "0"), ("doi:8", "pmid:2", "q", "1"), ("doi:1", "issn:4", "q", "5"), ("doi:9", "doi:1", "p", "3")]),
    # A late claim that replaces its provider's, stubs that get a record, and three nodes that become one.
    ([("r6", "p", "work", ["pmid:2"], "late", "2020-01"), ("r8", "s", "work", ["doi:7", "doi:8", "doi:9"], "all one", "9")], [("doi:7", "doi:9", "s", "1")]),
]
TABLES = ("nodes", "aliases", "assertions", "edge_assertions")


def empty_store(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    by_name = {x.name: x.schema for x in em.LAYOUTS}
    return store_sync.Store(none(by_name["nodes"]), none(by_name["aliases"]), none(by_name["assertions"]), none(by_name["edges_out"]), none(em.ARTIFACTS))


def same(ledger, store):
    now = em.current_store(ledger)
    for name in TABLES:
        want = getattr(store, name)
        assert rows(getattr(now, name), *want.columns) == rows(want, *want.columns), name
    assert rows(ledger.read("held"), "scheme", "value", "canonical_id") == rows(store.aliases, "scheme", "value", "canonical_id")
    columns = ["src_id", "dst_id", "relation", "source", "fetched_at", "attrs"]
    assert rows(ledger.read("edges_in"), *columns) == rows(store.edge_assertions, *columns)


def test_batches_equal_emissions_applied_to_the_whole_store(spark, tmp_path, monkeypatch):
    """Parts of one row and runs merged two by two; a batch dies between two tables before each is let through."""
    ledger, store, write = em.open_ledger(spark, str(tmp_path), part_rows=1, fan=2), empty_store(spark), Ledger._write
    for k, batch in enumerate(BATCHES):
        given = emission(spark, *batch)

        def dies(self, layout, df, run):
            if layout.name == "edges_in":
                raise OSError("lost")
            return write(self, layout, df, run)

        if k == 1:
            monkeypatch.setattr(Ledger, "_write", dies)
            with pytest.raises(OSError):
                em.ingest_emission(ledger, k, given)
            monkeypatch.setattr(Ledger, "_write", write)
            same(ledger, store)
        em.ingest_batch(em.stream_rows(given), k, ledger)
        store = store_sync.apply_emission(store, given).store
        same(ledger, store)
        assert not em.ingest_emission(ledger, k, given)  # came before
    assert store.nodes.where("merged_into IS NOT NULL").count() > 1
    by_record = {r["record_id"]: r["canonical_id"] for r in em.current_records(ledger).collect()}
    assert by_record["r1"] == by_record["r2"] == by_record["r5"] == by_record["r6"] != by_record["r8"]
    assert len(ledger.vacuum()) >= 3
    same(ledger, store)


KV = Layout("kv", "k string, v string", ("k",), ("k",))


def put(spark, ledger, batch, pairs):
    frame = spark.createDataFrame([(k, v, v is None) for k, v in pairs], "k string, v string, gone boolean")
    return ledger.commit(batch, {"kv": frame})


def test_runs_merge_by_levels_and_a_merge_that_dies_is_harmless(spark, tmp_path, monkeypatch):
    ledger, want, rng = Ledger(spark, str(tmp_path), [KV], part_rows=3, fan=3), {}, random.Random(1)
    for batch in range(13):
        pairs = {f"k{rng.randint(0, 20)}": None if rng.random() < 0.3 else f"v{batch}" for _ in range(6)}
        put(spark, ledger, batch, list(pairs.items()))
        want.update(pairs)
        if batch == 5:
            publish = Ledger._publish
            monkeypatch.setattr(Ledger, "_publish", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                ledger.compact()
            monkeypatch.setattr(Ledger, "_publish", publish)
        held = {k: v for k, v in want.items() if v is not None}
        assert dict(rows(ledger.read("kv"), "k", "v")) == held
        ledger.compact()
        assert dict(rows(ledger.read("kv"), "k", "v")) == held
        asked = [f"k{n}" for n in range(0, 24, 5)]
        got = ledger.lookup("kv", spark.createDataFrame([(k,) for k in asked], "k string"))
        assert dict(rows(got, "k", "v")) == {k: held[k] for k in asked if k in held}
    levels = [r.level for r in ledger.manifest().runs]
    assert levels == sorted(levels, reverse=True) and max(levels.count(n) for n in levels) < 3
    assert ledger.lookup("kv", spark.createDataFrame([], "k string")).collect() == []
    put(spark, ledger, 20, [])
    assert dict(rows(ledger.read("kv"), "k", "v")) == held
    assert not put(spark, ledger, 20, [("k1", "late")])


def test_another_writer_is_noticed(spark, tmp_path):
    one, two = (Ledger(spark, str(tmp_path), [KV]) for _ in range(2))
    stale = two.manifest()
    put(spark, one, 0, [("a", "1")])
    stale.version += 1
    with pytest.raises(RuntimeError):
        two._publish(stale)


def test_the_rows_a_batch_reads_do_not_grow_with_the_store(spark, tmp_path):
    """Batches of two works each: a lookup in the 27th run reads about what it read in the 9th."""
    ledger = Ledger(spark, str(tmp_path), [KV], part_rows=20, fan=3)
    cost = {}
    for batch in range(27):
        put(spark, ledger, batch, [(f"{batch}-{n}", "v") for n in range(60)])
        ledger.compact()
        if batch % 9 == 8:
            keys = spark.createDataFrame([(f"{batch // 2}-{n}",) for n in range(2)], "k string")
            found = []
            cost[batch] = rows_read(spark, lambda: found.append(ledger.lookup("kv", keys).count()))  # noqa: B023
            assert found == [2]
    assert ledger.read("kv").count() == 27 * 60
    assert cost[26] < 2 * cost[8] and cost[26] < 27 * 60 / 5


def test_the_stream_commits_every_batch(spark, tmp_path):
    whole = [emission(spark, *b) for b in BATCHES[:2]]
    for k, given in enumerate(whole):
        em.stream_rows(given).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    rows_in = spark.readStream.schema(em.ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ledger = em.open_ledger(spark, str(tmp_path / "ledger"))
    em.emission_stream(rows_in, ledger, str(tmp_path / "checkpoint")).awaitTermination()
    assert ledger.manifest().batch == 1
    assert ledger.read("records").count() == 6
    em.emission_stream(rows_in, ledger, str(tmp_path / "checkpoint")).awaitTermination()  # nothing new
    assert ledger.manifest().batch == 1
    live = em.current_store(ledger).live_nodes()
    assert rows(live.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))) == [("author", 1), ("venue", 1), ("work", 5)]
