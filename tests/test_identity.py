import random

import pytest
from pyspark.sql import functions as F

from citegraph.operators import identity
from tests.helpers import rows

RECORD = "record_id string, seq int, scheme string, value string"
ALIAS = "scheme string, value string, canonical_id string"
NODE = "canonical_id string, kind string, merged_into string"


def partition(resolution):
    groups = {}
    for r in resolution.record_nodes.collect():
        groups.setdefault(r["canonical_id"], set()).add(r["record_id"])
    return sorted(map(sorted, groups.values()))


def brute_components(edges, vertices):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in vertices}


def test_same_record_twice_is_one_node(spark):
    data = [("r1", 1, "doi", "x"), ("r2", 2, "doi", "x")]
    done = identity.resolve_identity(spark.createDataFrame(data, RECORD))
    assert partition(done) == [["r1", "r2"]]
    assert done.new_nodes.count() == 1 and done.redirects.count() == 0


def test_third_record_joins_two(spark):
    data = [("a", 1, "doi", "x"), ("b", 2, "pmid", "y"), ("c", 3, "doi", "x"), ("c", 3, "pmid", "y")]
    done = identity.resolve_identity(spark.createDataFrame(data, RECORD))
    assert partition(done) == [["a", "b", "c"]]
    assert len({r["canonical_id"] for r in done.aliases.collect()}) == 1


def test_case_of_a_doi_forks_identity_unless_normalised(spark):
    data = spark.createDataFrame([("a", 1, "doi", "10.1/X"), ("b", 2, "doi", "10.1/x")], RECORD)
    assert partition(identity.resolve_identity(data)) == [["a"], ["b"]]
    assert partition(identity.resolve_identity(identity.normalize_dois(data))) == [["a", "b"]]


def test_records_without_alias_stay_apart(spark):
    data = [("a", 1, None, None), ("b", 2, None, None), ("c", 3, "doi", "x")]
    done = identity.resolve_identity(spark.createDataFrame(data, RECORD))
    assert partition(done) == [["a"], ["b"], ["c"]]
    assert rows(done.aliases, "scheme", "value") == [("doi", "x")]


def test_known_nodes_merge_into_the_smallest(spark):
    known = spark.createDataFrame([("doi", "x", "g2"), ("pmid", "y", "g1"), ("mag", "other", "g0")], ALIAS)
    data = spark.createDataFrame([("r", 1, "doi", "x"), ("r", 1, "pmid", "y"), ("r", 1, "s2", "new")], RECORD)
    done = identity.resolve_identity(data, known)
    assert rows(done.record_nodes) == [("r", "g1")]
    assert rows(done.redirects) == [("g2", "g1")]
    assert done.new_nodes.count() == 0


def test_new_node_takes_kind_of_first_record(spark):
    data = spark.createDataFrame([("a", 2, "doi", "x"), ("b", 1, "doi", "x")], RECORD)
    kinds = spark.createDataFrame([("a", 2, "work"), ("b", 1, "author")], "record_id string, seq int, kind string")
    assert [r["kind"] for r in identity.resolve_identity(data, None, kinds).new_nodes.collect()] == ["author"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force_in_any_order(spark, seed):
    rng = random.Random(seed)
    vertices = [f"v{n:03d}" for n in range(120)]
    edges = [(rng.choice(vertices), rng.choice(vertices)) for _ in range(90)]
    want = brute_components(edges, vertices)
    for order in (edges, [(b, a) for a, b in reversed(edges)]):
        found = {r["vertex"]: r["root"] for r in identity.connected_components(spark.createDataFrame(order, "u string, v string")).collect()}
        touched = {v for e in edges if e[0] != e[1] for v in e}
        assert found == {v: want[v] for v in touched}


def test_long_chain_and_wide_star(spark):
    chain = [(f"c{n:04d}", f"c{n + 1:04d}") for n in range(1000)]
    star = [("s00000", f"s{n:05d}") for n in range(1, 5001)]
    found = identity.connected_components(spark.createDataFrame(chain + star, "u string, v string"))
    assert rows(found.groupBy("root").count()) == [("c0000", 1001), ("s00000", 5001)]


def test_first_claim_owns_an_alias(spark):
    known = spark.createDataFrame([("doi", "k", "n0")], ALIAS)
    claims = spark.createDataFrame([("doi", "k", "n1", 1), ("doi", "z", "n3", 3), ("doi", "z", "n2", 2)], ALIAS + ", seq int")
    assert rows(identity.get_or_create_aliases(known, claims)) == [("doi", "k", "n0"), ("doi", "z", "n2")]


def test_live_node_of_long_redirect_chain(spark):
    nodes = [(f"n{n}", "work", f"n{n + 1}" if n < 1000 else None) for n in range(1001)]
    live = identity.resolve_live(spark.createDataFrame(nodes, NODE))
    assert live.where("live_id <> 'n1000'").count() == 0 and live.count() == 1001


def test_redirect_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a", "work", "b"), ("b", "work", "a")], NODE)
    with pytest.raises(RuntimeError):
        identity.resolve_live(nodes)


def test_redirect_to_nowhere_is_reported(spark):
    nodes = spark.createDataFrame([("a", "work", "gone"), ("b", "work", None)], NODE)
    assert rows(identity.missing_targets(nodes), "canonical_id") == [("a",)]
    assert rows(identity.resolve_live(nodes)) == [("a", "gone"), ("b", "b")]


def test_merge_keeps_the_strictly_newer_claim(spark):
    claims = spark.createDataFrame(
        [("s", "crossref", "old", "2024-01"), ("l", "crossref", "new", "2024-06"), ("l", "openalex", "only", "2024-02"),
         ("s", "tie", "survivor", "2024-03"), ("l", "tie", "loser", "2024-03")],
        "canonical_id string, source string, attrs string, fetched_at string",
    )
    moves = spark.createDataFrame([("l", "s")], "loser_id string, canonical_id string")
    assert rows(identity.merge_node_assertions(claims, moves), "canonical_id", "source", "attrs") == [
        ("s", "crossref", "new"), ("s", "openalex", "only"), ("s", "tie", "survivor")
    ]


def test_merging_citing_and_cited_leaves_a_self_loop(spark):
    edges = spark.createDataFrame([("l", "s", "cites"), ("a", "l", "cites"), ("a", "s", "cites")], "src_id string, dst_id string, relation string")
    moves = spark.createDataFrame([("l", "s")], "loser_id string, canonical_id string")
    assert rows(identity.merge_edges(edges, moves)) == [("a", "s", "cites"), ("s", "s", "cites")]


def test_merged_artifacts_by_policy(spark):
    held = spark.createDataFrame(
        [("s", "fulltext", 1, True, None, None), ("l", "fulltext", 1, True, None, None), ("l", "chunks", 1, True, "fulltext", 1)],
        "canonical_id string, role string, version int, is_current boolean, derived_from_role string, derived_from_version int",
    )
    moves = spark.createDataFrame([("l", "s")], "loser_id string, canonical_id string")
    kept = identity.merge_artifacts(held, moves)
    assert rows(kept, "role", "version", "is_current", "derived_from_version") == [
        ("chunks", 1, True, 2), ("fulltext", 1, True, None), ("fulltext", 2, False, None)
    ]
    dropped = identity.merge_artifacts(held, moves, policy="drop")
    assert rows(dropped, "role", "version", "is_current") == [("chunks", 1, True), ("fulltext", 1, True)]


def test_alias_choices(spark):
    aliases = spark.createDataFrame(
        [("s2", "a", "n"), ("arxiv", "b", "n"), ("doi", "c", "n"), ("openalex", "d", "n"), ("zz", "1", "m"), ("aa", "2", "m")], ALIAS
    )
    assert rows(identity.preferred_alias(aliases)) == [("m", "zz", "1"), ("n", "doi", "c")]
    assert rows(identity.address_alias(aliases)) == [("m", "aa", "2"), ("n", "openalex", "d")]


def test_lookup_marks_unknown(spark):
    known = spark.createDataFrame([("doi", "x", "old")], ALIAS)
    live = spark.createDataFrame([("old", "new")], "canonical_id string, live_id string")
    asked = spark.createDataFrame([("doi", "x"), ("doi", "?")], "scheme string, value string")
    assert rows(identity.lookup(asked, known, live)) == [("doi", "?", None, False), ("doi", "x", "new", True)]
    assert rows(identity.have(known, asked.unionByName(asked))) == [("doi", "x")]
