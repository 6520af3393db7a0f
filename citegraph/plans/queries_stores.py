"""Registered queries for store comparison, synchronisation and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.operators import graph, store_sync
from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import with_views
from citegraph.plans.queries_catalog import HELD_SQL, _held_artifacts
from citegraph.plans.registry import Registry

REG = Registry()


def _store(spark: SparkSession, sf_dir: str) -> store_sync.Store:
    held = _held_artifacts(spark, sf_dir)
    keyed = held.withColumn("key", F.concat_ws("/", "canonical_id", "role", F.lit("v1"))).withColumn(
        "byte_size", F.length("canonical_id").cast("long")
    )
    return store_sync.Store(
        fx.nodes(spark, sf_dir), fx.aliases(spark, sf_dir), fx.work_assertions(spark, sf_dir),
        graph.edge_assertions(fx.edge_in(spark, sf_dir)), keyed,
    )


def _other(spark: SparkSession, sf_dir: str) -> store_sync.Store:
    """A second store: the small parts (full texts only), filled orders and all suppliers, under other ids."""
    small = fx.table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("value"))
    filled = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("value"))
    suppliers = fx.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"))
    rows = (
        small.select(F.lit("mpn").alias("scheme"), "value", F.lit("work").alias("kind"))
        .unionByName(filled.select(F.lit("openalex").alias("scheme"), "value", F.lit("topic").alias("kind")))
        .unionByName(suppliers.select(F.lit("openalex").alias("scheme"), "value", F.lit("author").alias("kind")))
        .withColumn("canonical_id", F.concat(F.lit("z"), "value"))
    )
    nodes = rows.select("canonical_id", "kind", F.lit(None).cast("string").alias("merged_into"))
    none = fx.work_assertions(spark, sf_dir).where("false")
    held = small.select(
        F.concat(F.lit("z"), "value").alias("canonical_id"), F.lit("fulltext").alias("role"), F.lit(1).alias("version"),
        F.lit(True).alias("is_current"), F.lit(1).cast("long").alias("byte_size"), F.lit("k").alias("key"),
    )
    edges = graph.edge_assertions(fx.edge_in(spark, sf_dir)).where("false")
    return store_sync.Store(nodes, rows.select("scheme", "value", "canonical_id"), none, edges, held)


OTHER_SQL = """other AS (
  SELECT 'mpn' AS scheme, CAST(p_partkey AS VARCHAR) AS value FROM part WHERE p_size <= 25
  UNION ALL SELECT 'openalex', 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'openalex', s_name FROM supplier),
seen AS (
  SELECT n.canonical_id, n.kind, count(a.value) AS n_aliases, count(o.value) AS n_found
  FROM nodes n LEFT JOIN aliases a ON a.canonical_id = n.canonical_id
  LEFT JOIN other o ON o.scheme = a.scheme AND o.value = a.value
  WHERE n.merged_into IS NULL GROUP BY 1, 2)"""

ADDRESS_SQL = """address AS (
  SELECT canonical_id, scheme || ':' || value AS name FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.canonical_id ORDER BY
      CASE a.scheme WHEN 'openalex' THEN 0 WHEN 'doi' THEN 1 ELSE 2 END, a.scheme, a.value) AS rn
    FROM aliases a JOIN nodes n ON n.canonical_id = a.canonical_id AND n.merged_into IS NULL) WHERE rn = 1)"""


@REG.query(
    "H1_diff",
    with_views(
        "nodes aliases edge",
        """SELECT 'a' AS side, metric, value FROM (
             SELECT 'only_here' AS metric, count(*) AS value FROM seen WHERE n_aliases > 0 AND n_found = 0
             UNION ALL SELECT 'works_only_here', count(*) FROM seen WHERE n_aliases > 0 AND n_found = 0 AND kind = 'work'
             UNION ALL SELECT 'unaddressable', count(*) FROM seen WHERE n_aliases = 0
             UNION ALL SELECT 'artifacts', count(*) FROM held
             UNION ALL SELECT 'works', count(*) FROM nodes WHERE merged_into IS NULL AND kind = 'work'
             UNION ALL SELECT 'works_described', count(*) FROM part
             UNION ALL SELECT 'works_stub', count(*) FROM nodes WHERE merged_into IS NULL AND canonical_id LIKE 'd%'
             UNION ALL SELECT 'nodes_total', count(*) FROM nodes WHERE merged_into IS NULL
             UNION ALL SELECT 'merge_redirects', count(*) FROM nodes WHERE merged_into IS NOT NULL
             UNION ALL SELECT 'edges_total', count(*) FROM edge
             UNION ALL SELECT 'library_bytes', CAST(sum(length(canonical_id)) AS BIGINT) FROM held)
           UNION ALL
           SELECT 'b', metric, value FROM (
             SELECT 'only_here' AS metric, count(*) AS value FROM other ANTI JOIN aliases USING (scheme, value)
             UNION ALL SELECT 'works_only_here', count(*) FROM (SELECT * FROM other WHERE scheme = 'mpn') ANTI JOIN aliases USING (scheme, value)
             UNION ALL SELECT 'unaddressable', 0
             UNION ALL SELECT 'artifacts', count(*) FROM part WHERE p_size <= 25
             UNION ALL SELECT 'works', count(*) FROM part WHERE p_size <= 25
             UNION ALL SELECT 'works_described', 0
             UNION ALL SELECT 'works_stub', count(*) FROM part WHERE p_size <= 25
             UNION ALL SELECT 'nodes_total', count(*) FROM other
             UNION ALL SELECT 'merge_redirects', 0
             UNION ALL SELECT 'edges_total', 0
             UNION ALL SELECT 'library_bytes', count(*) FROM part WHERE p_size <= 25)""",
        extra=HELD_SQL + "," + OTHER_SQL,
    ),
)
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_sync.diff(_store(spark, sf_dir), _other(spark, sf_dir))


@REG.query(
    "H1_diff_examples",
    with_views(
        "nodes aliases",
        "SELECT d.name AS address FROM seen s JOIN address d USING (canonical_id) WHERE n_found = 0 AND n_aliases > 0 ORDER BY 1 LIMIT 5",
        extra=OTHER_SQL + "," + ADDRESS_SQL,
    ),
)
def diff_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report names at most five."""
    return store_sync.diff_examples(_store(spark, sf_dir), _other(spark, sf_dir).aliases)


PLAN_SQL = """plan AS (
  SELECT canonical_id, kind, CASE WHEN n_aliases = 0 THEN 'no_alias' WHEN n_found = n_aliases THEN 'present' ELSE 'push' END AS outcome
  FROM seen)"""


@REG.query("H2_sync_plan", with_views("nodes aliases", "SELECT canonical_id, kind, outcome FROM plan", extra=OTHER_SQL + "," + PLAN_SQL))
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_sync.plan_works(_store(spark, sf_dir), _other(spark, sf_dir).aliases)


@REG.query(
    "H2_sync_records",
    with_views(
        "nodes aliases",
        """SELECT p.canonical_id, p.kind, coalesce(c.source, 'migration') AS source, c.fetched_at
           FROM plan p LEFT JOIN (SELECT DISTINCT canonical_id, source, fetched_at FROM (
             SELECT 'p' || p_partkey AS canonical_id, 'alpha' AS source, '2024-01-01T00:00:00Z' AS fetched_at FROM part
             UNION ALL SELECT 'p' || p_partkey, 'beta', '2024-06-01T00:00:00Z' FROM part)) c USING (canonical_id)
           WHERE p.outcome = 'push'""",
        extra=OTHER_SQL + "," + PLAN_SQL,
    ),
)
def sync_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _store(spark, sf_dir)
    plan = store_sync.plan_works(source, _other(spark, sf_dir).aliases)
    return store_sync.work_records(source, plan).drop("attrs")


@REG.query(
    "H3_sync_edges",
    with_views(
        "nodes aliases edge_assertion",
        """SELECT s.name AS src, d.name AS dst, e.relation, e.source, 'push' AS outcome FROM edge_assertion e
           JOIN address s ON s.canonical_id = e.src_id JOIN address d ON d.canonical_id = e.dst_id""",
        extra=ADDRESS_SQL,
    ),
)
def sync_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_sync.plan_edges(_store(spark, sf_dir)).select("src", "dst", "relation", "source", "outcome")


ARTIFACT_PLAN_SQL = """aplan AS (
  SELECT h.canonical_id, h.role,
         CASE WHEN h.role = 'fulltext' AND o.value IS NOT NULL THEN 'present'
              WHEN h.role = 'abstract' THEN 'missing_blob' ELSE 'push' END AS outcome
  FROM held h JOIN address a ON a.canonical_id = h.canonical_id
  LEFT JOIN other o ON o.scheme || ':' || o.value = a.name)"""


@REG.query(
    "H4_sync_artifacts",
    with_views(
        "nodes aliases", "SELECT canonical_id, role, outcome FROM aplan",
        extra=HELD_SQL + "," + OTHER_SQL + "," + ADDRESS_SQL + "," + ARTIFACT_PLAN_SQL,
    ),
)
def sync_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only full texts have a blob at the source."""
    source = _store(spark, sf_dir)
    blobs = source.artifacts.where("role = 'fulltext'").select("key")
    return store_sync.plan_artifacts(source, _other(spark, sf_dir), blobs).drop("version")


@REG.query(
    "H5_sync_report",
    with_views(
        "nodes aliases edge_assertion",
        """SELECT 'works' AS category, outcome, count(*) AS count FROM plan GROUP BY outcome
           UNION ALL SELECT 'records', 'push', (SELECT count(*) FROM plan WHERE outcome = 'push')
                            + (SELECT count(*) FROM plan WHERE outcome = 'push' AND canonical_id LIKE 'p%')
           UNION ALL SELECT 'edges', 'push', count(*) FROM edge_assertion
           UNION ALL SELECT 'artifacts', outcome, count(*) FROM aplan GROUP BY outcome""",
        extra=HELD_SQL + "," + OTHER_SQL + "," + PLAN_SQL + "," + ADDRESS_SQL + "," + ARTIFACT_PLAN_SQL,
    ),
)
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, dest = _store(spark, sf_dir), _other(spark, sf_dir)
    plan = store_sync.plan_works(source, dest.aliases)
    blobs = source.artifacts.where("role = 'fulltext'").select("key")
    return store_sync.sync_report(
        plan, store_sync.work_records(source, plan), store_sync.plan_edges(source), store_sync.plan_artifacts(source, dest, blobs)
    )


def _doc_store(spark: SparkSession, sf_dir: str) -> store_sync.Store:
    """Documents as works with redirects; each cites the one its redirect names and the first of its source."""
    docs = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("canonical_id"), "doc_id", "source", "lang", "n_chars"
    )
    first = docs.groupBy("source").agg(F.concat(F.lit("d"), F.min("doc_id").cast("string")).alias("dst_id"))
    edges = docs.join(first, "source").select(
        F.col("canonical_id").alias("src_id"), "dst_id", F.lit("cites").alias("relation"), F.col("lang").alias("source")
    )
    held = docs.select(
        "canonical_id", F.col("lang").alias("role"), F.lit(1).alias("version"), F.lit(True).alias("is_current"),
        F.concat_ws("/", "canonical_id", "lang", F.lit("v1")).alias("key"),
    )
    nodes = fx.document_redirects(spark, sf_dir).withColumn("kind", F.lit("work"))
    named = docs.select(F.lit("doc").alias("scheme"), F.col("doc_id").cast("string").alias("value"), "canonical_id")
    claims = docs.select("canonical_id", F.col("lang").alias("source"), F.lit("{}").alias("attrs"))
    return store_sync.Store(nodes, named, claims, edges, held)


DELETE_SQL = """live(canonical_id, live_id, hop) AS (
  SELECT canonical_id, coalesce(merged_into, canonical_id), 0 FROM redirects
  UNION ALL SELECT l.canonical_id, n.merged_into, hop + 1 FROM live l JOIN redirects n ON n.canonical_id = l.live_id WHERE n.merged_into IS NOT NULL),
ends AS (SELECT canonical_id, arg_max(live_id, hop) AS root FROM live GROUP BY canonical_id),
asked AS (SELECT DISTINCT root FROM ends JOIN (SELECT 'd' || doc_id AS canonical_id FROM labels WHERE toxic = 1) USING (canonical_id)),
net AS (SELECT canonical_id, root FROM ends WHERE root IN (SELECT root FROM asked)),
cites AS (SELECT 'd' || doc_id AS src_id, 'd' || min(doc_id) OVER (PARTITION BY source) AS dst_id, lang FROM documents)"""


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("canonical_id")
    )


@REG.query(
    "H12_delete_plan",
    with_views(
        "redirects",
        """SELECT n.root AS root_id, count(*) - 1 AS redirects, count(*) AS aliases, count(*) AS artifacts,
                  (SELECT count(DISTINCT (src_id, dst_id)) FROM cites c
                   WHERE c.src_id IN (SELECT canonical_id FROM net m WHERE m.root = n.root)
                      OR c.dst_id IN (SELECT canonical_id FROM net m WHERE m.root = n.root)) AS edges
           FROM net n GROUP BY n.root""",
        extra=DELETE_SQL, recursive=True,
    ),
)
def delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_sync.delete_plan(_doc_store(spark, sf_dir), _toxic(spark, sf_dir))


@REG.query(
    "H13_delete_cascade",
    with_views(
        "redirects",
        """SELECT 'nodes' AS tab, canonical_id AS key FROM redirects WHERE canonical_id NOT IN (SELECT canonical_id FROM net)
           UNION ALL SELECT 'aliases', 'doc:' || doc_id FROM documents WHERE 'd' || doc_id NOT IN (SELECT canonical_id FROM net)
           UNION ALL SELECT 'assertions', 'd' || doc_id || '@' || lang FROM documents WHERE 'd' || doc_id NOT IN (SELECT canonical_id FROM net)
           UNION ALL SELECT 'edges', src_id || '>' || dst_id FROM cites
             WHERE src_id NOT IN (SELECT canonical_id FROM net) AND dst_id NOT IN (SELECT canonical_id FROM net)
           UNION ALL SELECT 'artifacts', 'd' || doc_id || '/' || lang || '/v1' FROM documents WHERE 'd' || doc_id NOT IN (SELECT canonical_id FROM net)
           UNION ALL SELECT 'blobs to remove', 'd' || doc_id || '/' || lang || '/v1' FROM documents WHERE 'd' || doc_id IN (SELECT canonical_id FROM net)""",
        extra=DELETE_SQL, recursive=True,
    ),
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, keys = store_sync.delete_works(_doc_store(spark, sf_dir), _toxic(spark, sf_dir))
    row = lambda df, tab, key: df.select(F.lit(tab).alias("tab"), key.alias("key"))
    return (
        row(left.nodes, "nodes", F.col("canonical_id"))
        .unionByName(row(left.aliases, "aliases", F.concat_ws(":", "scheme", "value")))
        .unionByName(row(left.assertions, "assertions", F.concat_ws("@", "canonical_id", "source")))
        .unionByName(row(left.edge_assertions, "edges", F.concat_ws(">", "src_id", "dst_id")))
        .unionByName(row(left.artifacts, "artifacts", F.col("key")))
        .unionByName(row(keys, "blobs to remove", F.col("key")))
    )
