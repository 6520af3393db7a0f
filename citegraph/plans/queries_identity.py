"""Registered queries for identity and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.operators import graph, identity
from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import with_views
from citegraph.plans.registry import Registry

REG = Registry()

# For the oracle: min-label walk over shared aliases, by repeated squaring of labels in a recursive query.
COMPONENT_SQL = """
pairs AS (SELECT DISTINCT record_id AS r, scheme || ':' || value AS a FROM records),
groups AS (SELECT a, min(r) AS m FROM pairs GROUP BY a HAVING count(*) > 1),
links AS (SELECT DISTINCT p.r AS x, g.m AS y FROM pairs p JOIN groups g USING (a) WHERE p.r <> g.m),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (
  SELECT x, y FROM sym
  UNION
  SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
labels AS (SELECT p.r AS record_id, least(p.r, coalesce(min(q.y), p.r)) AS root
           FROM (SELECT DISTINCT r FROM pairs) p LEFT JOIN reach q ON q.x = p.r GROUP BY p.r)"""

RECORDS_SQL = """records AS (
  SELECT 'd' || doc_id AS record_id, 'doc' AS scheme, CAST(doc_id AS VARCHAR) AS value FROM documents
  UNION ALL SELECT 'd' || doc_id, 'sha', sha256(text) FROM documents)"""

RECORDS_LINE_SQL = """records AS (
  SELECT 'd' || doc_id AS record_id, 'doc' AS scheme, CAST(doc_id AS VARCHAR) AS value FROM documents
  UNION ALL SELECT 'd' || doc_id, 'sha', sha256(text) FROM documents
  UNION ALL SELECT DISTINCT 'd' || doc_id, 'line', sha256(line)
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40)"""


def _partition(resolution: identity.Resolution) -> DataFrame:
    """Compare partitions, never ids: each record with the smallest record of its node."""
    pairs = resolution.record_nodes
    least = pairs.groupBy("canonical_id").agg(F.min("record_id").alias("root"), F.count(F.lit(1)).alias("members"))
    return pairs.join(least, "canonical_id").select("record_id", "root", "members")


PARTITION_SQL = "SELECT record_id, root, count(*) OVER (PARTITION BY root) AS members FROM labels"


@REG.query("B1_resolve_identity", with_views("", PARTITION_SQL, extra=RECORDS_SQL + "," + COMPONENT_SQL, recursive=True))
def resolve_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partition(identity.resolve_identity(fx.records(spark, sf_dir)))


@REG.query(
    "B1_resolve_identity_by_line",
    with_views("", PARTITION_SQL, extra=RECORDS_LINE_SQL + "," + COMPONENT_SQL, recursive=True),
)
def resolve_identity_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partition(identity.resolve_identity(fx.records(spark, sf_dir, lines=True)))


@REG.query(
    "B1_resolve_against_catalog",
    with_views(
        "",
        """SELECT record_id, CASE WHEN known THEN survivor END AS survivor FROM (
             SELECT record_id, bool_or(k) OVER (PARTITION BY text) AS known, min(g) OVER (PARTITION BY text) AS survivor
             FROM (SELECT 'd' || doc_id AS record_id, text, lang = 'en' AS k,
                          CASE WHEN lang = 'en' THEN 'd' || doc_id END AS g FROM documents))""",
    ),
)
def resolve_against_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are already nodes; all documents arrive again as records."""
    english = fx.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("value"))
    known = english.select(F.lit("doc").alias("scheme"), "value", F.concat(F.lit("d"), "value").alias("canonical_id"))
    done = identity.resolve_identity(fx.records(spark, sf_dir), known)
    is_new = done.new_nodes.select("canonical_id", F.lit(True).alias("is_new"))
    return done.record_nodes.join(is_new, "canonical_id", "left").select(
        "record_id", F.when(F.col("is_new").isNull(), F.col("canonical_id")).alias("survivor")
    )


@REG.query(
    "B1_merge_redirects",
    with_views(
        "",
        """SELECT g AS loser_id, survivor AS canonical_id FROM (
             SELECT 'd' || doc_id AS g, min('d' || doc_id) OVER (PARTITION BY text) AS survivor
             FROM documents WHERE lang = 'en') WHERE g <> survivor""",
    ),
)
def merge_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = fx.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("value"))
    known = english.select(F.lit("doc").alias("scheme"), "value", F.concat(F.lit("d"), "value").alias("canonical_id"))
    return identity.resolve_identity(fx.records(spark, sf_dir), known).redirects


@REG.query(
    "B1_alias_load",
    with_views(
        "",
        "SELECT scheme, value, count(DISTINCT record_id) AS records FROM records GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= 5",
        extra=RECORDS_LINE_SQL,
    ),
)
def alias_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.alias_load(fx.records(spark, sf_dir, lines=True), 5)


@REG.query(
    "B2_get_or_create_alias",
    with_views(
        "",
        """SELECT scheme, value, canonical_id FROM known UNION ALL
           SELECT 'sha', sha256(text), 'd' || arg_min(doc_id, doc_id) FROM documents
           WHERE sha256(text) NOT IN (SELECT value FROM known) GROUP BY text""",
        extra="""known AS (SELECT 'sha' AS scheme, sha256(text) AS value, 'old' || min(doc_id) AS canonical_id
                           FROM documents WHERE lang = 'en' GROUP BY text)""",
    ),
)
def get_or_create_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select(
        F.lit("sha").alias("scheme"), F.sha2("text", 256).alias("value"), F.col("doc_id").alias("seq"), "lang"
    )
    known = docs.where("lang = 'en'").groupBy("scheme", "value").agg(
        F.concat(F.lit("old"), F.min("seq").cast("string")).alias("canonical_id")
    )
    claims = docs.select("scheme", "value", "seq", F.concat(F.lit("d"), F.col("seq").cast("string")).alias("canonical_id"))
    return identity.get_or_create_aliases(known, claims)


LIVE_SQL = """live(canonical_id, live_id, hop) AS (
  SELECT canonical_id, coalesce(merged_into, canonical_id), 0 FROM nodes
  UNION ALL
  SELECT l.canonical_id, n.merged_into, hop + 1 FROM live l JOIN nodes n ON n.canonical_id = l.live_id
  WHERE n.merged_into IS NOT NULL),
ends AS (SELECT canonical_id, arg_max(live_id, hop) AS live_id FROM live GROUP BY canonical_id)"""


@REG.query("B3_resolve_live", with_views("nodes", "SELECT canonical_id, live_id FROM ends", extra=LIVE_SQL, recursive=True))
def resolve_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve_live(fx.nodes(spark, sf_dir))


def _part_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name and brand are merged into the one with the smallest id text."""
    parts = fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("loser_id"), "p_name", "p_brand"
    )
    least = parts.groupBy("p_name", "p_brand").agg(F.min("loser_id").alias("canonical_id"))
    return parts.join(least, ["p_name", "p_brand"]).where("loser_id <> canonical_id").select("loser_id", "canonical_id")


MERGED_SQL = """moves AS (
  SELECT loser_id, canonical_id AS survivor FROM (
    SELECT 'p' || p_partkey AS loser_id, min('p' || p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical_id FROM part)
  WHERE loser_id <> canonical_id)"""


@REG.query(
    "B4_merge_redirect_and_aliases",
    with_views(
        "aliases",
        """SELECT a.scheme, a.value, coalesce(m.survivor, a.canonical_id) AS canonical_id
           FROM aliases a LEFT JOIN moves m ON m.loser_id = a.canonical_id""",
        extra=MERGED_SQL,
    ),
)
def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.merge_aliases(fx.aliases(spark, sf_dir), _part_redirects(spark, sf_dir))


@REG.query(
    "B4_merge_nodes",
    with_views(
        "nodes",
        """SELECT n.canonical_id, n.kind, coalesce(m.survivor, n.merged_into) AS merged_into
           FROM nodes n LEFT JOIN moves m ON m.loser_id = n.canonical_id""",
        extra=MERGED_SQL,
    ),
)
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.merge_nodes(fx.nodes(spark, sf_dir), _part_redirects(spark, sf_dir))


@REG.query(
    "B5_merge_node_assertions",
    with_views(
        "",
        """SELECT canonical_id, source, fetched_at FROM (
             SELECT coalesce(m.survivor, s.id) AS canonical_id, s.source, s.fetched_at,
                    row_number() OVER (PARTITION BY coalesce(m.survivor, s.id), s.source
                      ORDER BY s.fetched_at DESC, CASE WHEN m.survivor IS NULL THEN 0 ELSE 1 END, s.id) AS rn
             FROM (SELECT 'p' || l_partkey AS id, l_linestatus AS source,
                          max(strftime(l_shipdate, '%Y-%m-%d')) AS fetched_at FROM lineitem GROUP BY 1, 2) s
             LEFT JOIN moves m ON m.loser_id = s.id) WHERE rn = 1""",
        extra=MERGED_SQL,
    ),
)
def merge_node_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fx.table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("canonical_id"), F.col("l_linestatus").alias("source")
    ).agg(F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("fetched_at"))
    return identity.merge_node_assertions(held, _part_redirects(spark, sf_dir))


MOVED_EDGE_SQL = """moved AS (
  SELECT coalesce(a.survivor, e.src_id) AS src_id, coalesce(b.survivor, e.dst_id) AS dst_id, e.relation, e.source,
         e.fetched_at, a.survivor IS NULL AND b.survivor IS NULL AS in_place, e.src_id AS os, e.dst_id AS od
  FROM edge_assertion e LEFT JOIN moves a ON a.loser_id = e.src_id LEFT JOIN moves b ON b.loser_id = e.dst_id)"""


@REG.query(
    "B6_merge_edges",
    with_views("edge_assertion", "SELECT DISTINCT src_id, dst_id, relation FROM moved", extra=MERGED_SQL + "," + MOVED_EDGE_SQL),
)
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Folded once, after the merge: a fold before it holds as many edges again in the same task.
    return identity.merge_edges(fx.edge_in(spark, sf_dir).select(*graph.EDGE_KEY), _part_redirects(spark, sf_dir))


@REG.query(
    "B6_merge_edge_assertions",
    with_views(
        "edge_assertion",
        """SELECT src_id, dst_id, relation, source, fetched_at FROM (
             SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, relation, source
               ORDER BY fetched_at DESC, CASE WHEN in_place THEN 0 ELSE 1 END, os, od) AS rn FROM moved) WHERE rn = 1""",
        extra=MERGED_SQL + "," + MOVED_EDGE_SQL,
    ),
)
def merge_edge_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = graph.edge_assertions(fx.edge_in(spark, sf_dir))
    return identity.merge_edge_assertions(held, _part_redirects(spark, sf_dir)).drop("attrs")


VERSIONED_SQL = """held AS (
  SELECT 'w' || p_partkey AS canonical_id, p_brand AS role, v.v AS version, v.v = 2 AS is_current,
         CASE WHEN v.v = 2 THEN p_brand END AS derived_from_role, CASE WHEN v.v = 2 THEN 1 END AS derived_from_version
  FROM part, (SELECT unnest([1, 2]) AS v) v),
wmoves AS (
  SELECT loser_id, canonical_id AS survivor FROM (
    SELECT 'w' || p_partkey AS loser_id, min('w' || p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical_id FROM part)
  WHERE loser_id <> canonical_id),
placed AS (
  SELECT coalesce(m.survivor, h.canonical_id) AS canonical_id, h.canonical_id AS was, h.role, h.version,
         CASE WHEN m.survivor IS NULL THEN 0 ELSE 1 END AS rk, h.is_current, h.derived_from_role, h.derived_from_version
  FROM held h LEFT JOIN wmoves m ON m.loser_id = h.canonical_id)"""


def _versioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("canonical_id"), F.col("p_brand").alias("role"), "p_name"
    )
    held = parts.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "canonical_id", "role", "version", (F.col("version") == 2).alias("is_current"),
        F.when(F.col("version") == 2, F.col("role")).alias("derived_from_role"),
        F.when(F.col("version") == 2, F.lit(1)).alias("derived_from_version"),
    )
    least = parts.groupBy("p_name", "role").agg(F.min("canonical_id").alias("survivor"))
    moves = parts.join(least, ["p_name", "role"]).where("canonical_id <> survivor").select(
        F.col("canonical_id").alias("loser_id"), F.col("survivor").alias("canonical_id")
    )
    return held, moves


@REG.query(
    "B7_merge_artifacts",
    with_views(
        "",
        """SELECT canonical_id, role, CAST(version + 2 * (dense_rank() OVER w - 1) AS INTEGER) AS version,
                  is_current AND dense_rank() OVER w = 1 AS is_current, derived_from_role,
                  CAST(derived_from_version + 2 * (dense_rank() OVER w - 1) AS INTEGER) AS derived_from_version
           FROM placed WINDOW w AS (PARTITION BY canonical_id, role ORDER BY rk, was)""",
        extra=VERSIONED_SQL,
    ),
)
def merge_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, moves = _versioned(spark, sf_dir)
    return identity.merge_artifacts(held, moves).select(
        "canonical_id", "role", "version", "is_current", "derived_from_role", "derived_from_version"
    )


@REG.query(
    "B7_merge_artifacts_drop",
    with_views(
        "",
        """SELECT canonical_id, role, CAST(version AS INTEGER) AS version, is_current FROM (
             SELECT *, row_number() OVER (PARTITION BY canonical_id, role, version ORDER BY rk, was) AS rn FROM placed) WHERE rn = 1""",
        extra=VERSIONED_SQL,
    ),
)
def merge_artifacts_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, moves = _versioned(spark, sf_dir)
    return identity.merge_artifacts(held, moves, policy="drop").select("canonical_id", "role", "version", "is_current")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases asked for: the id of every order line's part and of its supplier number as a part that may not exist."""
    lines = fx.table(spark, sf_dir, "lineitem")
    return lines.select(
        F.explode(
            F.array(
                F.struct(F.lit("mpn").alias("scheme"), F.col("l_partkey").cast("string").alias("value")),
                F.struct(F.lit("doc").alias("scheme"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string").alias("value")),
            )
        ).alias("a")
    ).select("a.*")


WANTED_SQL = """wanted AS (
  SELECT DISTINCT scheme, value FROM (
    SELECT 'mpn' AS scheme, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
    UNION ALL SELECT 'doc', CAST(l_partkey + l_suppkey AS VARCHAR) FROM lineitem))"""


@REG.query(
    "B8_have",
    with_views("aliases", "SELECT scheme, value FROM wanted SEMI JOIN aliases USING (scheme, value)", extra=WANTED_SQL),
)
def have(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.have(fx.aliases(spark, sf_dir), _wanted(spark, sf_dir))


@REG.query(
    "B9_lookup_by_alias",
    with_views(
        "aliases nodes",
        """SELECT w.scheme, w.value, e.live_id, a.canonical_id IS NOT NULL AS is_known
           FROM wanted w LEFT JOIN aliases a USING (scheme, value) LEFT JOIN ends e ON e.canonical_id = a.canonical_id""",
        extra=LIVE_SQL + "," + WANTED_SQL, recursive=True,
    ),
)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = identity.resolve_live(fx.nodes(spark, sf_dir))
    return identity.lookup(_wanted(spark, sf_dir).distinct(), fx.aliases(spark, sf_dir), live)


@REG.query(
    "B10_preferred_alias",
    with_views(
        "aliases",
        """SELECT canonical_id, scheme, value FROM (
             SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY
               CASE scheme WHEN 'doi' THEN 0 WHEN 'pmid' THEN 1 WHEN 'pmcid' THEN 2 WHEN 'openalex' THEN 3
                           WHEN 'semantic_scholar' THEN 4 WHEN 'arxiv' THEN 5 ELSE 255 END, value, scheme) AS rn
             FROM aliases) WHERE rn = 1""",
    ),
)
def preferred_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.preferred_alias(fx.aliases(spark, sf_dir))


@REG.query(
    "B11_address_alias",
    with_views(
        "aliases",
        """SELECT canonical_id, scheme, value FROM (
             SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY
               CASE scheme WHEN 'openalex' THEN 0 WHEN 'doi' THEN 1 ELSE 2 END, scheme, value) AS rn
             FROM aliases) WHERE rn = 1""",
    ),
)
def address_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.address_alias(fx.aliases(spark, sf_dir))
