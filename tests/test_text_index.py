import random

import pytest
from pyspark.sql import functions as F

from citegraph.operators import catalog, text_index
from citegraph.operators.text_index import TextIndex
from tests.helpers import rows

CLAIM = "canonical_id string, source string, attrs string, fetched_at string"
NODE = "canonical_id string, kind string, merged_into string"


@pytest.fixture(scope="module")
def claims():
    rng = random.Random(5)
    words = ["graph", "the", "Über", "naïve", "ab", "tiling", "Rare", "spark", "of", "n"]
    out = []
    for k in range(120):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        author = rng.choice(["Ann Lee", "Bo", "ÉLISE", "Theo the Third"])
        out.append((f"w{k % 100:03d}", "p" if k < 100 else "q", f'{{"title":"{title}","publication_year":{1990 + k % 7},"authorships":[{{"author":{{"display_name":"{author}"}}}}]}}', str(k)))
    return [*out, ("w001", "r", "no json", "1"), ("w002", "r", '{"title":null,"authors":["Solo"]}', "1"), ("w003", "r", None, "1"), ("x", "p", '{"display_name":"the graph"}', "1")]


@pytest.fixture(scope="module")
def index(spark, claims, tmp_path_factory):
    made = TextIndex(spark, str(tmp_path_factory.mktemp("index")), part_rows=200, fan=2)
    for part in (claims[:60], claims[50:]):  # overlapping batches
        made.add(spark.createDataFrame(part, CLAIM))
    return made


ASKED = [
    {"title": "graph"}, {"title": "THE"}, {"title": "über na"}, {"title": "b"}, {"title": "ab"}, {"title": "nowhere"}, {"author": "lee"}, {"author": "éLi"}, {"author": "the"},
    {"title": "rare", "author": "bo", "year": 1991}, {"year": 1993}, {"author": "solo"}, {"title": "the", "limit": 5}, {"title": ""}, {"title": "%"},
]


def test_answers_equal_the_scan(spark, index, claims):
    table = spark.createDataFrame(claims, CLAIM)
    nodes = spark.createDataFrame([(f"w{k:03d}", "work", "w000" if k == 7 else None) for k in range(100)] + [("x", "author", None)], NODE)
    for filters in ASKED:
        assert rows(index.search_works(nodes, **filters)) == rows(catalog.search_works(nodes, table, **filters)), filters
    held = spark.createDataFrame([("w010", "fulltext", True), ("w011", "fulltext", False)], "canonical_id string, role string, is_current boolean")
    assert rows(index.search_works(nodes, year=1990 + 10 % 7, with_artifact="fulltext", artifacts=held)) == [("w010",)]
    with pytest.raises(ValueError):
        index.search_works(nodes)


def test_a_query_parses_no_claim_and_reads_the_rarest_trigram(index):
    plan = index.matches("title", "graph")._jdf.queryExecution().toString()
    assert "parse_json" not in plan and "variant" not in plan
    gram, n = index.rarest("title", "the tiling")
    assert n < index.rarest("title", "the")[1] and gram in "the tiling"
    assert index.rarest("title", "zzz") == ("zzz", 0) and index.rarest("title", "ab") is None
    held = index.candidates("title", "the tiling").where(F.contains("text", F.lit("tiling"))).count()
    assert index.candidates("title", "the tiling").count() <= held + n


def test_claims_of_one_file_are_parsed_by_many_tasks(spark, claims, tmp_path, monkeypatch):
    seen, fields = [], text_index.search_fields
    monkeypatch.setattr(text_index, "search_fields", lambda rows: (seen.append(rows), fields(rows))[1])
    made = TextIndex(spark, str(tmp_path))
    made.add(spark.createDataFrame(claims, CLAIM).coalesce(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert seen[0].rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
