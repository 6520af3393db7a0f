import json

from pyspark.sql import functions as F

from citegraph.sources import arxiv, emission, manual, openalex, references, semanticscholar
from citegraph.operators import identity
from tests.helpers import rows

NOW = "2024-01-01T00:00:00Z"
WORK = {
    "id": "https://openalex.org/W42", "doi": "https://doi.org/10.9999/abc.1", "display_name": "On measuring", "publication_year": 2020, "cited_by_count": 7,
    "ids": {"openalex": "https://openalex.org/W42", "doi": "https://doi.org/10.9999/abc.1", "mag": 4242, "pmid": "77"},
    "authorships": [{"author_position": "first", "author": {"id": "A1", "display_name": "Ada Byron", "orcid": None, "x": 1}, "institutions": [], "is_corresponding": True}],
    "primary_location": {"source": {"display_name": "Journal"}}, "abstract_inverted_index": {"Grow": [0], "fast": [2]},
    "referenced_works": ["https://openalex.org/W7", "W8"], "related_works": [],
}


def lines(spark, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "value string")


def test_openalex_work(spark, tmp_path):
    path = tmp_path / "works" / "part.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join(json.dumps(r) for r in (WORK, {"id": "https://openalex.org/I9"}, {"id": "bogus"})))
    out = openalex.read_openalex(spark, str(tmp_path), NOW)
    assert rows(out.records.select(F.explode("aliases").alias("a")).select("a.*")) == [
        ("doi", "10.9999/abc.1"), ("mag", "4242"), ("openalex", "W42"), ("pmid", "77")
    ]
    assert rows(out.edges, "src.value", "dst.value", "relation") == [("W42", "W7", "cites"), ("W42", "W8", "cites")]
    assert rows(out.skipped) == [("institutions", 1), ("unknown", 1)]


def test_openalex_shapes(spark):
    one = lines(spark, WORK)
    kept = json.loads(openalex.curate(one, "works").first()["value"])
    assert "referenced_works" not in kept and kept["authorships"][0] == {
        "author_position": "first", "author": {"id": "A1", "display_name": "Ada Byron"}, "institutions": []
    }
    assert rows(openalex.summarize(one), "title", "year", "authors", "venue") == [("On measuring", 2020, ["Ada Byron"], "Journal")]
    index = F.from_json(F.get_json_object("value", "$.abstract_inverted_index"), "map<string,array<int>>")
    got = one.select(openalex.reconstruct_abstract(index).alias("a"), openalex.reconstruct_abstract(index, keep_gaps=False).alias("b")).first()
    assert (got["a"], got["b"]) == ("Grow  fast", "Grow fast")
    empty = spark.createDataFrame([({},), (None,)], "m map<string,array<int>>").select(openalex.reconstruct_abstract(F.col("m")).alias("a"))
    assert rows(empty) == [(None,), (None,)]


def test_two_providers_meet_at_a_doi(spark):
    paper = {"paperId": "p1", "externalIds": {"DOI": "10.9999/abc.1", "CorpusId": 5}, "abstract": "long", "title": "On measuring"}
    records = openalex.parse(lines(spark, WORK), NOW).records.drop("seq").unionByName(semanticscholar.paper_records(lines(spark, paper), NOW))
    long = emission.record_aliases(emission.with_seq(records))
    assert len({r["canonical_id"] for r in identity.resolve_identity(long).record_nodes.collect()}) == 1
    assert "abstract" not in json.loads(semanticscholar.curate(lines(spark, paper)).first()["value"])



def empty_store(spark):
    from citegraph.operators import store_sync

    none = lambda schema: spark.createDataFrame([], schema)
    return store_sync.Store(
        none("canonical_id string, kind string, merged_into string"), none("scheme string, value string, canonical_id string"),
        none("canonical_id string, source string, attrs string, fetched_at string"),
        none("src_id string, dst_id string, relation string, source string, fetched_at string, attrs string"),
        none("canonical_id string, role string, version int, is_current boolean, derived_from_role string, derived_from_version int"),
    )


def test_an_emission_is_written_and_written_again(spark):
    from citegraph.operators import store_sync

    tables = ("nodes", "aliases", "assertions", "edge_assertions")
    read = lambda store: {t: sorted(map(str, rows(getattr(store, t)))) for t in tables}
    given = openalex.parse(lines(spark, WORK), NOW)
    first = store_sync.apply_emission(empty_store(spark), given)
    assert rows(first.store.assertions, "source") == [("openalex",)]
    assert first.store.edge_assertions.count() == len(WORK["referenced_works"])
    assert {r["canonical_id"] for r in first.store.aliases.collect()} <= {r["canonical_id"] for r in first.store.nodes.collect()}
    again = store_sync.apply_emission(first.store, given)
    assert read(again.store) == read(first.store)
    # A paper of another provider with the same DOI adds a claim to the node that is there.
    paper = {"paperId": "p1", "externalIds": {"DOI": "10.9999/abc.1"}, "title": "On measuring"}
    records = semanticscholar.paper_records(lines(spark, paper), NOW)
    more = store_sync.apply_emission(first.store, emission.Emission(records, given.edges, given.skipped))
    assert {r["source"] for r in more.store.assertions.collect()} == {"openalex", "semanticscholar"} and len({r["canonical_id"] for r in more.store.assertions.collect()}) == 1
    assert more.store.nodes.count() == first.store.nodes.count()


def test_citation_pages_quarantine_nameless_papers(spark):
    page = {"data": [{"citingPaper": {"paperId": "c1", "externalIds": {"DOI": "10.1/x"}}}, {"citingPaper": {"paperId": "c2"}}, {"citingPaper": {"paperId": None}}]}
    pages = spark.createDataFrame([(json.dumps({"paperId": "seed"}), json.dumps(page))], "seed string, value string")
    out = semanticscholar.parse_citation_pages(pages, "citingPaper", NOW)
    assert rows(out.edges, "src.scheme", "src.value", "dst.value") == [("doi", "10.1/x", "seed"), ("s2", "c2", "seed")]
    assert rows(out.skipped) == [("unknown_endpoint", 1)]


def test_reference_lists(spark):
    answer = {"message": {"reference": [{"DOI": "10.1/A"}, {"unstructured": "?"}, {"DOI": "10.2/b"}, {"key": "k"}]}}
    crossref = spark.createDataFrame([("10.0/me", json.dumps(answer))], "citing string, value string")
    other = spark.createDataFrame([("10.0/me", json.dumps([{"cited": "10.1/a"}, {"cited": "10.3/C"}]))], "citing string, value string")
    out = references.parse_crossref(crossref, NOW)
    assert rows(out.edges, "dst.value", "source") == [("10.1/a", "crossref"), ("10.2/b", "crossref")] and rows(out.skipped) == [("no_doi", 2)]
    both = references.union_references(references.crossref_pairs(crossref), references.opencitations_pairs(other), NOW)
    assert rows(both, "dst.value") == [("10.1/a",), ("10.2/b",), ("10.3/c",)]


FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
  <title>query</title>
  <entry><id>http://arxiv.org/abs/1234.56789v3</id><updated>u</updated><published>p</published>
    <title>Two
      lines</title><summary>  Text &amp; more. </summary><author><name>A B</name></author><author><name>C D</name></author>
    <arxiv:primary_category term="cs.XX"/><category term="cs.XX"/><category term="cs.YY"/><arxiv:doi>10.5/z</arxiv:doi>
    <link title="pdf" href="https://arxiv.org/pdf/1234.56789v3"/><link href="h" rel="alternate"/></entry>
  <entry><id>http://arxiv.org/abs/hep-th/9901001</id><title>Old</title><summary>s</summary><author><name>E</name></author><category term="hep-th"/></entry>
</feed>
"""


def test_arxiv_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    got = arxiv.entries(arxiv.read_feed(spark, str(tmp_path)))
    assert rows(got, "arxiv_id", "title", "abstract", "doi", "pdf_url", "primary_category") == [
        ("1234.56789", "Two lines", "Text & more.", "10.5/z", "https://arxiv.org/pdf/1234.56789v3", "cs.XX"), ("hep-th/9901001", "Old", "s", None, None, None)
    ]
    records = arxiv.read_arxiv(spark, str(tmp_path), NOW).records
    assert rows(records.select(F.explode("aliases").alias("a")).select("a.*")) == [("arxiv", "1234.56789"), ("arxiv", "hep-th/9901001"), ("doi", "10.5/z")]
    assert "abstract" not in arxiv.curate(got).columns


def test_hand_entries(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        "\n".join(json.dumps(r) for r in ({"aliases": ["isbn:97:8"], "title": "T", "authors": [], "kind": "WORK", "year": 2001}, {"aliases": ["x"], "title": "U", "kind": "work"}, {"aliases": [], "title": "V", "kind": "person"}))
    )
    records, rejects = manual.read_manual(spark, str(tmp_path), NOW)
    row = records.first()
    assert (row["kind"], row["source"], [tuple(a) for a in row["aliases"]]) == ("work", "manual", [("isbn", "97:8")])
    assert json.loads(row["attrs"]) == {"title": "T", "publication_year": 2001}
    assert rows(rejects, "reason") == [("invalid alias 'x'",), ("invalid kind 'person'",)]
