"""Queries on tables where a reviewer found, or projected, them to fail."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citegraph.operators import graph, semantic, store_sync
from citegraph.operators.adjacency import Adjacency
from citegraph.plans import fixtures as fx
from citegraph.plans.queries_identity import merge_edges
from citegraph.sources import semanticscholar
from citegraph.sources.emission import Emission
from tests import test_emission_stream
from tests.helpers import rows, rows_read


def oracle_rows(sf_dir: str, name: str) -> set:
    import os

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{file}/*.parquet')")
    return set(con.execute(entry.oracle_sql()[name]).fetchall())


def test_lasting_anchors_that_look_drawn_are_no_difference(spark, tmp_path):
    """Conversation 22345: `r-22345x2` has the shape of a drawn anchor."""
    turns = [(c, t, "user", f"line {t}\nmore") for c in (22345, 7) for t in range(30)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = entry.queries()["G16_resolved_files"](spark, str(tmp_path)).select("slug", "rest").collect()
    assert {tuple(r) for r in rows} == oracle_rows(str(tmp_path), "G16_resolved_files") and len(rows) == 2


def test_citation_pages_are_parsed_once(spark):
    """Edges and the count of skipped ends read what one pass wrote; neither parses JSON again."""
    page = '{"data":[{"citingPaper":{"paperId":"a","externalIds":{"DOI":"10.1/x"}}},{"citingPaper":{"paperId":null}}]}'
    pages = spark.createDataFrame([('{"paperId":"s"}', page), (None, page), ('{"paperId":"t"}', None)], "seed string, value string")
    out = semanticscholar.parse_citation_pages(pages, "citingPaper", "now")
    assert [tuple(r) for r in out.edges.select("src.value", "dst.value").collect()] == [("10.1/x", "s")]
    assert [tuple(r) for r in out.skipped.collect()] == [("unknown_endpoint", 3)] and out.records.count() == 4
    for table in (out.edges, out.skipped):
        assert "from_json" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_several_layouts_are_computed_once(spark, tmp_path):
    """Edges lie by source and by target, but what they are derived from is read once."""
    pairs = [(f"a{i}", f"b{i % 7}", "cites") for i in range(500)]
    spark.createDataFrame(pairs, "src_id string, dst_id string, relation string").write.parquet(f"{tmp_path}/claims")
    derived = spark.read.parquet(f"{tmp_path}/claims").withColumn("src_id", F.upper("src_id"))
    layout = Adjacency(spark, f"{tmp_path}/graph")
    # 500 claims once, then the written edges twice for either layout (one count needs no rows of a file).
    assert rows_read(spark, lambda: layout.add(derived)) <= 500 + 2 * 2 * 500
    assert layout.at(spark.createDataFrame([("b3",)], "canonical_id string"), "backward").count() == len([i for i in range(500) if i % 7 == 3])


def test_json_lines_of_one_row_group_are_made_and_parsed_by_all_cores(spark, tmp_path):
    """The scan of the records reads files that were dealt out, not the table's one row group."""
    part = [(k, f"name {k}", 1, "T", "Brand#1") for k in range(4000)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size long, p_type string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = fx.spread(spark, str(tmp_path), "part", "p_partkey", "p_name")
    assert rows.columns == ["p_partkey", "p_name"] and rows.count() == 4000
    made = rows.where(F.from_json(F.concat(F.lit('{"a":'), "p_partkey", F.lit("}")), "a long")["a"] >= 0)
    assert str(tmp_path) not in made.inputFiles()[0] and "RepartitionByExpression" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_an_emission_are_computed_once(spark):
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    none = test_emission_stream.empty_store(spark)
    given = test_emission_stream.emission(spark, [("r1", "p", "work", ["doi:1"], "one", "1")], [("doi:1", "doi:9", "p", "1"), ("doi:8", "doi:1", "p", "2")])
    edges = given.edges.mapInArrow(counted, given.edges.schema)
    store = store_sync.apply_emission(none, Emission(given.records, edges, given.skipped)).store
    assert store.edges().count() == 2 and store.nodes.count() == 3 and store.aliases.count() == 3
    assert count.value == 2


def test_stubs_of_edges_are_found_without_joining_the_edges_again(spark):
    """One anti-join of the different ends, not both joins of all edges."""
    end = "struct<scheme:string,value:string>"
    edges = spark.createDataFrame(
        [(("a", "1"), ("a", "2"), "cites", "p", None, "t", 1), (("a", "2"), ("b", None), "cites", "p", None, "t", 2), (None, ("a", "3"), "cites", "p", None, "t", 3)],
        f"src {end}, dst {end}, relation string, source string, attrs string, fetched_at string, seq long",
    )
    known = spark.createDataFrame([("a", "1", "n1"), ("a", "3", None)], "scheme string, value string, canonical_id string")
    done = graph.put_edges(edges, known)
    assert rows(done.stub_aliases, "scheme", "value") == [(None, None), ("a", "2"), ("a", "3"), ("b", None)]
    claimed = {r[0] for r in done.claims.select(F.explode(F.array("src_id", "dst_id"))).collect()}
    assert claimed == {"n1"} | {r[0] for r in done.stub_nodes.select("canonical_id").collect()}
    assert done.stub_aliases._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_nearest_vectors_are_ranked_by_products_of_blocks(spark, monkeypatch):
    """Equal vectors, null and repeated ids, several blocks of queries and stretches of a group: the ranks of brute force."""
    monkeypatch.setattr(semantic, "QUERY_ROWS", 4)
    monkeypatch.setattr(semantic, "HELD", 100)
    random = np.random.default_rng(5)
    some = random.normal(size=(60, 7))
    table = [(None if k % 50 == 49 else k % 150, [float(x) for x in some[k % 60]]) for k in range(160)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 10 = 3")
    found = semantic.nearest(semantic.build(vectors), asked, top=5, probes=2, exact=True)
    unit = {k: some[k] / np.linalg.norm(some[k]) for k in range(60)}
    for query in range(13, 150, 10):  # 3 is the id of two different vectors
        near = sorted((-round(float(unit[query % 60] @ unit[k % 60]), 9), i is None, i or 0) for k, (i, _) in enumerate(table) if i != query)
        assert [r["id"] for r in found.where(F.col("query_id") == query).orderBy("rank").collect()] == [None if null else i for _, null, i in near[:5]]
    cells = semantic.build(vectors)
    best = semantic._best(cells, cells._near(semantic.unit_vectors(asked, "vec_id", "embedding"), 2).withColumn("least", F.lit(-2.0)), 3, 5)
    assert "FlatMapCoGroupsInArrow" in best._jdf.queryExecution().executedPlan().toString()


def test_edges_are_folded_once_in_a_merge(spark):
    """A fold before the merge and one after it hold the same edges twice in one task."""
    plan = merge_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [src_id" in line for line in plan.splitlines()) == 1
