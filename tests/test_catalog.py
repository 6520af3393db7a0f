import pytest

from citegraph.operators import catalog, store_sync
from citegraph.plans import queries_catalog
from citegraph.sources import snapshots
from tests.helpers import rows

CLAIM = "canonical_id string, source string, attrs string, fetched_at string"
NODE = "canonical_id string, kind string, merged_into string"


def claims(spark, *data):
    return spark.createDataFrame(list(data), CLAIM)


def test_newest_claim_wins_and_ties_go_to_the_smaller_name(spark):
    got = catalog.merge_assertions(
        claims(
            spark, ("n", "b", '{"title":"old","year":1}', "2024-01"), ("n", "a", '{"title":"new"}', "2024-02"),
            ("n", "d", '{"venue":"d"}', "2024-03"), ("n", "c", '{"venue":"c","year":null}', "2024-03"),
            ("n", "e", '["not","an","object"]', "2025-01"), ("n", "f", "not json", "2025-01"),
        )
    )
    assert rows(got, "key", "value", "source") == [("title", '"new"', "a"), ("venue", '"c"', "c"), ("year", "null", "c")]



def test_repeated_keys_and_broken_claims(spark):
    given = claims(spark, ("n", "a", '{"a":1,"a":2,"title":"x","title":"Kept"}', "2024"), ("n", "b", '{"a":', "2024"), ("n", "c", None, "2024"))
    assert rows(catalog.assertion_fields(given), "key", "value") == [("a", "2"), ("title", '"Kept"')]
    assert rows(catalog.assertion_rejects(given), "source") == [("b",)]
    assert rows(catalog.reject_counts(given)) == [("b", 1)]
    nodes = spark.createDataFrame([("n", "work", None)], NODE)
    assert rows(catalog.search_works(nodes, given, title="kept")) == [("n",)]


def test_times_compare_as_text_unless_cast(spark):
    data = claims(spark, ("n", "cli", '{"t":1}', "2024-01-01T00:00:00Z"), ("n", "ui", '{"t":2}', "2024-01-01T00:00:00.123Z"))
    assert rows(catalog.merge_assertions(data), "source") == [("cli",)]
    assert rows(catalog.merge_assertions(data, cast_time=True), "source") == [("ui",)]


def test_nested_view(spark):
    merged = catalog.merge_assertions(claims(spark, ("n", "a", '{"x":{"y":[1,2]},"z":"t"}', "2024")))
    row = catalog.nest_fields(merged).first()
    assert row["attrs"] == {"x": '{"y":[1,2]}', "z": '"t"'}
    assert row["provenance"]["x"]["source"] == "a"


def test_direct_put_overwrites_whatever_the_time(spark):
    data = spark.createDataFrame([("n", "a", "1", "2024-09", 1), ("n", "a", "2", "2024-01", 2)], CLAIM + ", seq int")
    assert rows(catalog.upsert_assertions(data), "attrs") == [("2",)]


@pytest.fixture(scope="module")
def library(spark):
    nodes = spark.createDataFrame([("w1", "work", None), ("w2", "work", None), ("w3", "work", "w1"), ("v", "venue", None)], NODE)
    held = claims(
        spark,
        ("w1", "p", '{"title":"A Thousand Fields","publication_year":1980,"authorships":[{"author":{"display_name":"Ana Lund"},"institutions":[{"display_name":"Lakeside"}]}]}', "1"),
        ("w1", "q", '{"display_name":"Other title","publication_year":"1999"}', "2"),
        ("w2", "p", '{"title":"River 100%","authors":["Bo Jacobs",{"name":"Cy Reed"}],"publication_year":1999}', "1"),
        ("w3", "p", '{"title":"A Thousand Fields"}', "1"),
    )
    return nodes, held


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({"author": "lund"}, ["w1"]), ({"author": "JACOBS"}, ["w2"]), ({"author": "reed"}, ["w2"]), ({"author": "lakeside"}, []),
        ({"author": "river"}, []), ({"title": "thousand"}, ["w1"]), ({"title": "other"}, ["w1"]), ({"title": "100%"}, ["w2"]),
        ({"title": "r_ver"}, []), ({"year": 1999}, ["w2"]), ({"year": 1980, "title": "other title"}, ["w1"]), ({"year": 1980, "title": "river"}, []),
    ],
)
def test_search(library, filters, want):
    nodes, held = library
    assert [r[0] for r in rows(catalog.search_works(nodes, held, **filters))] == want


def test_artifact_filter_comes_before_the_limit(spark, library):
    nodes, held = library
    artifacts = spark.createDataFrame([("w2", "fulltext", True), ("w1", "fulltext", False)], "canonical_id string, role string, is_current boolean")
    got = catalog.search_works(nodes, held, with_artifact="fulltext", artifacts=artifacts, limit=1)
    assert rows(got) == [("w2",)]
    with pytest.raises(ValueError):
        catalog.search_works(nodes, held)


def test_filter_keys_are_checked(spark):
    works = spark.createDataFrame([("w", "de", ["c1", "c2"]), ("x", "en", ["c3"])], "canonical_id string, language string, concepts_id array<string>")
    assert rows(catalog.filter_works(works, ["language:de|fr", "concepts.id:c2"]), "canonical_id") == [("w",)]
    with pytest.raises(ValueError, match="nope, also"):
        catalog.filter_works(works, ["nope:1", "language:de", "also:2"])
    with pytest.raises(ValueError, match="no filter"):
        catalog.filter_works(works, ["language"])


def test_stats_count_stubs_and_redirects(spark):
    nodes = spark.createDataFrame([("a", "work", None), ("b", "work", None), ("c", "work", "a"), ("d", "author", None)], NODE)
    edges = spark.createDataFrame([("a", "b", "cites")], "src_id string, dst_id string, relation string")
    artifacts = spark.createDataFrame([(3,), (4,)], "byte_size long")
    got = dict(rows(catalog.stats(nodes, claims(spark, ("a", "p", "{}", "1"), ("c", "p", "{}", "1")), edges, artifacts)))
    assert got == {"works": 2, "works_described": 1, "works_stub": 1, "nodes_total": 3, "merge_redirects": 1, "edges_total": 1, "library_bytes": 7}


def test_export_splits_a_crowded_node_into_parts(spark):
    nodes = spark.createDataFrame([("n", "work", None), ("m", "work", None), ("r", "work", "n")], NODE)
    aliases = spark.createDataFrame([("s", str(i), "n") for i in range(100)], "scheme string, value string, canonical_id string")
    parts = snapshots.export_nodes(nodes, aliases, claims(spark, ("n", "a", "{}", "1")), part_entries=10).collect()
    of_n = [r for r in parts if r["canonical_id"] == "n"]
    assert {r["canonical_id"] for r in parts} == {"n", "m"} and len(of_n) > 1
    assert sorted(a["value"] for r in of_n for a in r["aliases"] or []) == sorted(str(i) for i in range(100))
    assert sum(len(r["assertions"] or []) for r in of_n) == 1


def test_the_export_query_gives_one_row_for_a_crowded_node(spark, monkeypatch):
    n = snapshots.PART_ENTRIES + 500
    aliases = spark.range(n).selectExpr("'s' AS scheme", "lpad(id, 6, '0') AS value", "'n' AS canonical_id")
    given = {"nodes": spark.createDataFrame([("n", "work", None), ("m", "work", None)], NODE), "aliases": aliases, "work_assertions": claims(spark, ("n", "b", "{}", "1"), ("n", "a", "{}", "2"))}
    for name, df in given.items():
        monkeypatch.setattr(queries_catalog.fx, name, lambda spark, sf_dir, df=df: df)
    got = {r["canonical_id"]: (r["names"], r["sources"]) for r in queries_catalog.export_nodes(spark, "").collect()}
    assert queries_catalog.export_nodes(spark, "").count() == 2 and got["m"] == ("", "")
    assert got["n"] == (",".join(f"s:{i:06d}" for i in range(n)), "a,b")


def test_snapshot_is_switched_last(spark, tmp_path):
    for name, data in (("one", [("a",)]), ("two", [("b",)])):
        snapshots.publish(spark.createDataFrame(data, "x string"), str(tmp_path), "t", name)
        if name == "one":
            snapshots.set_current(spark, str(tmp_path), "t", name)
    assert rows(snapshots.read_current(spark, str(tmp_path), "t"), "x") == [("a",)]
    snapshots.set_current(spark, str(tmp_path), "t", "two")
    assert rows(snapshots.read_current(spark, str(tmp_path), "t"), "x") == [("b",)]


def make_store(spark, nodes, aliases, edges, artifacts=()):
    return store_sync.Store(
        spark.createDataFrame(nodes, NODE), spark.createDataFrame(aliases, "scheme string, value string, canonical_id string"),
        claims(spark, *[(n[0], "p", "{}", "2024-02") for n in nodes if n[1] == "work" and not n[2] and n[0] != "stub"]) if nodes else claims(spark),
        spark.createDataFrame(edges, "src_id string, dst_id string, relation string, source string, attrs string, fetched_at string"),
        spark.createDataFrame(list(artifacts), "canonical_id string, role string, version int, is_current boolean, byte_size long, key string"),
    )


def test_sync_sends_what_is_missing(spark):
    a = make_store(
        spark, [("w", "work", None), ("stub", "work", None), ("bare", "work", None), ("both", "work", None)],
        [("doi", "w", "w"), ("doi", "s", "stub"), ("doi", "b", "both")], [("w", "stub", "cites", "p", None, "1"), ("w", "bare", "cites", "p", None, "1")],
    )
    dest = spark.createDataFrame([("doi", "b")], "scheme string, value string")
    plan = store_sync.plan_works(a, dest)
    assert rows(plan, "canonical_id", "outcome") == [("bare", "no_alias"), ("both", "present"), ("stub", "push"), ("w", "push")]
    assert rows(store_sync.work_records(a, plan), "canonical_id", "source", "attrs") == [("stub", "migration", "{}"), ("w", "p", "{}")]
    stale = spark.createDataFrame([("both", "p", "2024-01")], "canonical_id string, source string, fetched_at string")
    assert ("both", "p") in rows(store_sync.work_records(a, plan, stale), "canonical_id", "source")
    edges = store_sync.plan_edges(a)
    assert rows(edges, "dst_id", "outcome") == [("bare", "no_alias"), ("stub", "push")]


def test_delete_takes_the_redirect_network(spark):
    store = make_store(
        spark, [("live", "work", None), ("gone", "work", "live"), ("other", "work", None)],
        [("doi", "1", "live"), ("doi", "2", "gone"), ("doi", "3", "other")], [("live", "other", "cites", "p", None, "1"), ("other", "other", "cites", "p", None, "1")],
        [("live", "fulltext", 1, True, 5, "live/fulltext/v1"), ("other", "fulltext", 1, True, 5, "other/fulltext/v1")],
    )
    asked = spark.createDataFrame([("gone",)], "canonical_id string")
    assert rows(store_sync.delete_plan(store, asked)) == [("live", 1, 2, 1, 1)]
    left, keys = store_sync.delete_works(store, asked)
    assert rows(keys) == [("live/fulltext/v1",)]
    assert rows(left.nodes, "canonical_id") == [("other",)] and left.edge_assertions.count() == 1 and left.aliases.count() == 1


def test_sketches_of_snapshots_merge_at_every_level(spark):
    nodes = spark.createDataFrame([(f"n{k}", "work" if k % 3 else "author", None) for k in range(3000)], "canonical_id string, kind string, merged_into string")
    claims = [(f"n{k}", source, "{}", "1") for k in range(3000) for source in (("p", "q") if k % 2 else ("p",))]
    parts = [spark.createDataFrame(claims[i::2] + claims[:100], "canonical_id string, source string, attrs string, fetched_at string") for i in range(2)]
    sketches = catalog.claim_sketches(nodes, parts[0]).unionByName(catalog.claim_sketches(nodes, parts[1]))
    got = {(r["kind"], r["source"]): r for r in catalog.level_counts(sketches).collect()}
    assert len(got) == 2 * 2 + 2 + 2 + 1
    kind = lambda i: "work" if int(i[1:]) % 3 else "author"
    every = claims + claims[:100] * 2
    for (k, s), row in got.items():
        own = [c for c in every if k in (None, kind(c[0])) and s in (None, c[1])]
        assert row["claims"] == len(own) and row["level"] == 2 * (k is None) + (s is None)
        assert abs(row["works"] - len({c[0] for c in own})) <= 0.05 * len(own)


def test_views_by_any_alias(spark):
    nodes = spark.createDataFrame([("a", "work", None), ("b", "work", "a"), ("c", "author", None)], "canonical_id string, kind string, merged_into string")
    aliases = spark.createDataFrame([("doi", "1", "a"), ("pmid", "2", "b"), ("orcid", "3", "c")], "scheme string, value string, canonical_id string")
    stated = claims(spark, ("a", "p", '{"title":"t"}', "1"), ("c", "p", '{"name":"n"}', "1"))
    held = spark.createDataFrame([("a", "fulltext", 2, True, "k2"), ("a", "fulltext", 1, False, "k1")], "canonical_id string, role string, version int, is_current boolean, key string")
    asked = spark.createDataFrame([("pmid", "2"), ("pmid", "2"), ("doi", "9")], "scheme string, value string")
    got = rows(catalog.views_by_alias(asked, nodes, stated, aliases, held), "scheme", "value", "canonical_id", "kind", "part", "key", "text")
    own = ("pmid", "2", "a", "work")
    assert got == sorted([(*own, "alias", "doi", "1"), (*own, "alias", "pmid", "2"), (*own, "artifact", "fulltext", '{"version":2,"is_current":true,"key":"k2"}'), (*own, "field", "title", '"t"')])
