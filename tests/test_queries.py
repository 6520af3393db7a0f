import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from citegraph.plans import all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("A2_openalex_aliases", "B1_resolve_identity_by_line", "C1_merge_assertions", "D6_neighborhood_ranked", "E4_derivation_tree", "F6_detect_folios", "G7_links", "H7_merge_actions")


def test_every_query_has_sql():
    own = set(all_queries().queries)
    assert own <= set(entry.queries())
    assert own <= set(entry.oracle_sql())


def test_flagship_runs(spark, sf_dir):
    assert entry.entry(spark).columns == ["canonical_id", "depth", "in_degree"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf_dir) / table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in sorted(names)]).collect()) == want
