import random

import pytest

from citegraph.operators import expand, graph
from citegraph.operators.adjacency import Adjacency
from tests.helpers import rows, rows_read

EDGE = "src_id string, dst_id string, relation string"


@pytest.fixture(scope="module")
def hub(spark):
    return spark.createDataFrame([(s, d, "cites") for s, d in (("a", "h"), ("b", "h"), ("c", "h"), ("a", "b"))], EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "canonical_id string")


def test_hub_ranks_first(spark, hub):
    found = graph.neighborhood(hub, seeds(spark, "a"), "forward", 2, 200)
    assert [tuple(r) for r in graph.ranked(found.nodes).select("canonical_id", "in_degree", "depth").collect()] == [("h", 2, 1), ("b", 1, 1), ("a", 0, 0)]
    assert not found.truncated
    assert rows(found.edges) == [("a", "b", "cites"), ("a", "h", "cites"), ("b", "h", "cites")]


def test_cap_truncates_and_stays_closed(spark, hub):
    found = graph.neighborhood(hub, seeds(spark, "a"), "forward", 2, 2)
    kept = {r["canonical_id"] for r in found.nodes.collect()}
    assert found.truncated and kept == {"a", "b"}
    assert all(r["src_id"] in kept and r["dst_id"] in kept for r in found.edges.collect())


def test_too_many_seeds_keep_the_smallest(spark, hub):
    found = graph.neighborhood(hub, seeds(spark, "c", "b", "a"), "forward", 0, 2)
    assert found.truncated and rows(found.nodes, "canonical_id") == [("a",), ("b",)]


def test_depth_zero_and_backward(spark, hub):
    assert rows(graph.neighborhood(hub, seeds(spark, "a"), "forward", 0).edges) == []
    back = graph.neighborhood(hub, seeds(spark, "h"), "backward", 1)
    assert rows(back.nodes, "canonical_id", "in_degree") == [("a", 0), ("b", 0), ("c", 0), ("h", 3)]
    with pytest.raises(ValueError):
        graph.neighborhood(hub, seeds(spark, "h"), "sideways")


def test_walk_matches_brute_force(spark):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(150)}
    found = graph.neighborhood(spark.createDataFrame([(a, b, "cites") for a, b in pairs], EDGE), seeds(spark, "n00", "n01"), "forward", 3, None)
    depth = {"n00": 0, "n01": 0}
    for hop in range(3):
        for a, b in pairs:
            if depth.get(a) == hop:
                depth.setdefault(b, hop + 1)
    assert dict(rows(found.nodes, "canonical_id", "depth")) == depth
    assert set(rows(found.edges, "src_id", "dst_id")) == {(a, b) for a, b in pairs if depth.get(a, 9) < 3 and b in depth}


def test_edge_keeps_every_provider_once(spark):
    claims = spark.createDataFrame(
        [("a", "b", "cites", "p", "1", None, 1), ("a", "b", "cites", "q", "1", None, 2), ("a", "b", "cites", "p", "0", "{}", 3)],
        EDGE + ", source string, fetched_at string, attrs string, seq int",
    )
    assert graph.distinct_edges(claims).count() == 1
    nested = graph.edges_with_sources(graph.edge_assertions(claims)).first()
    assert [(a["source"], a["attrs"]) for a in nested["assertions"]] == [("p", "{}"), ("q", None)]


def test_put_edges_makes_stubs(spark):
    inputs = spark.createDataFrame(
        [(("doi", "known"), ("doi", "new"), "cites", "p", None, "1", 1), (("doi", "new"), ("doi", "known"), "cites", "p", None, "1", 2)],
        "src struct<scheme:string,value:string>, dst struct<scheme:string,value:string>, relation string, source string, attrs string, fetched_at string, seq int",
    )
    done = graph.put_edges(inputs, spark.createDataFrame([("doi", "known", "n1")], "scheme string, value string, canonical_id string"))
    assert done.counted.first()["written"] == 2
    assert rows(done.stub_aliases, "value") == [("new",)] and rows(done.stub_nodes, "kind") == [("work",)]
    ends = {r["src_id"] for r in done.claims.collect()} | {r["dst_id"] for r in done.claims.collect()}
    assert len(ends) == 2 and "n1" in ends


def test_edges_of_a_node_are_paged_by_other_end(spark, hub):
    got = graph.edges_of(hub, seeds(spark, "a", "h"), "forward", 1)
    assert rows(got) == [("a", "b", "cites", 2)]
    assert graph.edges_of(hub, seeds(spark, "h"), "backward", None).count() == 3


def test_unknown_seeds_are_skipped(spark, hub):
    nodes = spark.createDataFrame([(n,) for n in "abch"], "canonical_id string")
    found = graph.neighborhood(hub, seeds(spark, "a", "nobody"), "forward", 1, 200, nodes)
    assert rows(found.nodes, "canonical_id") == [("a",), ("b",), ("h",)]
    assert rows(graph.neighborhood(hub, seeds(spark, "nobody"), "forward", 1, 200, nodes).nodes) == []


def test_described_nodes_have_kind_and_merged_fields(spark, hub):
    found = graph.neighborhood(hub, seeds(spark, "a"), "forward", 1, 200)
    nodes = spark.createDataFrame([("a", "work", None), ("h", "author", None), ("z", "work", None)], "canonical_id string, kind string, merged_into string")
    claims = spark.createDataFrame(
        [("a", "p", '{"title":"old"}', "1"), ("a", "q", '{"title":"new","year":3}', "2"), ("z", "p", '{"title":"no"}', "1")],
        "canonical_id string, source string, attrs string, fetched_at string",
    )
    got = {r["canonical_id"]: r for r in graph.describe(found.nodes, nodes, claims).collect()}
    assert got["a"]["attrs"] == {"title": '"new"', "year": "3"} and got["a"]["provenance"]["title"]["source"] == "q" and got["a"]["kind"] == "work"
    assert got["h"]["kind"] == "author" and got["h"]["attrs"] is None and got["b"]["kind"] is None and set(got) == {"a", "b", "h"}


def test_a_laid_out_graph_walks_as_a_table_and_reads_only_its_frontier(spark, tmp_path):
    rng = random.Random(3)
    ring = [(f"r{k:04d}", f"r{(k + 1) % 3000:04d}") for k in range(3000)] + [(f"r{k:04d}", "hub") for k in range(500)]
    pairs = sorted({(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(90)})
    layout = Adjacency(spark, str(tmp_path), part_rows=50)
    for part in (ring, pairs[:50], pairs[30:]):
        layout.add(spark.createDataFrame([(a, b, "cites") for a, b in part], EDGE))
    edges = spark.createDataFrame([(a, b, "cites") for a, b in ring + pairs], EDGE)
    for direction in ("forward", "backward"):
        for start, cap in ((("n00", "n01"), None), (("n00", "r0007"), 6)):
            plain, laid = (g.neighborhood(*more, seeds(spark, *start), direction, 2, cap) for g, more in ((graph, (edges,)), (layout, ())))
            assert plain.truncated == laid.truncated
            for name in ("nodes", "edges"):
                assert rows(getattr(laid, name)) == rows(getattr(plain, name))
    assert rows(layout.edges_of(seeds(spark, "hub"), "backward", 3)) == [(f"r{k:04d}", "hub", "cites", 500) for k in range(3)]
    one = rows_read(spark, lambda: layout.at(seeds(spark, "r0100")).collect())
    many = rows_read(spark, lambda: layout.at(seeds(spark, *[f"r{k:04d}" for k in range(0, 3000, 10)])).collect())
    assert one < 500 and one < many / 4  # of 3,500 edges
    assert layout.at(seeds(spark, "nobody")).collect() == []


def test_mass_spreads_without_loss_through_a_hub(spark):
    pairs = [("a", f"x{k:03d}") for k in range(300)] + [(f"x{k:03d}", "hub") for k in range(300)] + [("hub", f"y{k}") for k in range(7)] + [("b", "y0"), ("b", "a"), ("s", "s")]
    edges = spark.createDataFrame([(x, y, r) for x, y in pairs for r in ("cites", "contains")], EDGE)
    start = ["a", "b", "s", "nobody"]
    want, out = {i: expand.UNIT for i in start}, {}
    for x, y in pairs:
        out.setdefault(x, set()).add(y)
    for _ in range(3):
        new = {}
        for i, m in want.items():
            n = len(out.get(i, ()))
            part = m * expand.SPREAD // 100 // n if n else 0
            new[i] = new.get(i, 0) + m - n * part
            for y in out.get(i, ()):
                new[y] = new.get(y, 0) + part
        want = new
    got = dict(rows(expand.spread_mass(expand.steps_of(edges), seeds(spark, *start))))
    assert got == want and sum(got.values()) == 4 * expand.UNIT
    best = [tuple(r) for r in expand.proposals(expand.steps_of(edges), seeds(spark, *start), 9).collect()]
    assert best == sorted(((i, m) for i, m in want.items() if i not in start and m), key=lambda r: (-r[1], r[0]))[:9]


def test_edges_of_a_node_are_read_once(spark):
    """Nodes with mass stay in the state; only those that a round reached first have their edges read."""
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r"), ("d", "d", "r")], "src_id string, dst_id string, relation string")
    asked, leaving = [], expand.steps_of(edges)

    def noted(frontier, size):
        asked.append(sorted(r[0] for r in frontier.collect()))
        return leaving(frontier, size)

    got = dict(rows(expand.spread_mass(noted, seeds(spark, "a"), rounds=4)))
    assert asked == [["a"], ["b"], ["c"], ["d"]]
    assert sum(got.values()) == expand.UNIT and set(got) == set("abcd")
