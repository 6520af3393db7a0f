"""Registered queries for the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.operators import expand, graph
from citegraph.operators.adjacency import Adjacency
from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import with_views
from citegraph.plans.registry import Registry
from citegraph.session import cut_lineage, work_folder

REG = Registry()

SEEDS_SQL = """seeds AS (
  SELECT 'o' || o_orderkey AS canonical_id FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'AUTOMOBILE')"""

WALK_FORWARD = SEEDS_SQL + """,
steps AS (SELECT DISTINCT src_id AS near, dst_id AS far FROM edge),
walk(id, depth) AS (
  SELECT canonical_id, 0 FROM seeds
  UNION
  SELECT far, depth + 1 FROM walk JOIN steps ON near = id WHERE depth < 2),
visited AS (SELECT id AS canonical_id, min(depth) AS depth FROM walk GROUP BY id),
closed AS (
  SELECT DISTINCT e.src_id, e.dst_id, e.relation FROM edge e
  JOIN visited a ON a.canonical_id = e.src_id AND a.depth < 2
  JOIN visited b ON b.canonical_id = e.dst_id)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fx.table(spark, sf_dir, "customer").where("c_mktsegment = 'AUTOMOBILE'").select("c_custkey")
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey, "left_semi").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("canonical_id")
    )


def _walk(spark: SparkSession, sf_dir: str, **kw) -> graph.Neighborhood:
    # The catalog stores its edges; here they are derived, so they are written once for the walk.
    edges = cut_lineage(graph.distinct_edges(fx.edge_in(spark, sf_dir)))
    return graph.neighborhood(edges, _seeds(spark, sf_dir), depth=2, **kw)


@REG.query(
    "D6_neighborhood_ranked",
    with_views(
        "edge",
        """SELECT v.canonical_id, v.depth, count(c.src_id) AS in_degree
           FROM visited v LEFT JOIN closed c ON c.dst_id = v.canonical_id GROUP BY 1, 2""",
        extra=WALK_FORWARD, recursive=True,
    ),
)
def neighborhood_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked(_walk(spark, sf_dir, max_nodes=None).nodes)


@REG.query(
    "D5_closed_subgraph",
    with_views("edge", "SELECT src_id, dst_id, relation FROM closed", extra=WALK_FORWARD, recursive=True),
)
def closed_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, max_nodes=None).edges


@REG.query(
    "D4_neighborhood_capped",
    with_views(
        "edge",
        "SELECT canonical_id, depth, true AS truncated FROM v2",
        extra=SEEDS_SQL + """,
v0 AS (SELECT canonical_id, 0 AS depth FROM seeds),
c1 AS (SELECT DISTINCT dst_id AS canonical_id FROM edge JOIN v0 ON src_id = v0.canonical_id
       WHERE dst_id NOT IN (SELECT canonical_id FROM v0)),
v1 AS (SELECT * FROM v0 UNION ALL
       (SELECT canonical_id, 1 FROM c1 ORDER BY canonical_id LIMIT (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) // 2 ))),
c2 AS (SELECT DISTINCT dst_id AS canonical_id FROM edge JOIN v1 ON src_id = v1.canonical_id AND v1.depth = 1
       WHERE dst_id NOT IN (SELECT canonical_id FROM v1)),
v2 AS (SELECT * FROM v1 UNION ALL
       (SELECT canonical_id, 2 FROM c2 ORDER BY canonical_id
        LIMIT (SELECT (SELECT count(*) FROM seeds) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) // 2 - (SELECT count(*) FROM v1))))""",
    ),
)
def neighborhood_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the feature: all seeds, then room for every part and half of the suppliers."""
    parts = fx.table(spark, sf_dir, "part").count()
    suppliers = fx.table(spark, sf_dir, "supplier").count()
    cap = _seeds(spark, sf_dir).count() + parts + suppliers // 2
    walked = _walk(spark, sf_dir, max_nodes=cap)
    return walked.nodes.select("canonical_id", "depth", F.lit(walked.truncated).alias("truncated"))


@REG.query(
    "D4_neighborhood_backward",
    with_views(
        "edge",
        "SELECT id AS canonical_id, min(depth) AS depth FROM walk GROUP BY id",
        extra="""seeds AS (SELECT 's' || s_suppkey AS canonical_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
                           WHERE n_regionkey = 1),
steps AS (SELECT DISTINCT dst_id AS near, src_id AS far FROM edge),
walk(id, depth) AS (SELECT canonical_id, 0 FROM seeds
  UNION SELECT far, depth + 1 FROM walk JOIN steps ON near = id WHERE depth < 2)""",
        recursive=True,
    ),
)
def neighborhood_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = fx.table(spark, sf_dir, "nation").where("n_regionkey = 1")
    suppliers = fx.table(spark, sf_dir, "supplier")
    seeds = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey, "left_semi").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("canonical_id")
    )
    edges = cut_lineage(graph.distinct_edges(fx.edge_in(spark, sf_dir)))
    return graph.neighborhood(edges, seeds, "backward", 2, None).nodes.select("canonical_id", "depth")


@REG.query(
    "D2_edge_assertions",
    with_views("edge_assertion", "SELECT src_id, dst_id, relation, source, fetched_at, attrs FROM edge_assertion"),
)
def edge_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_assertions(fx.edge_in(spark, sf_dir))


@REG.query(
    "D2_edges_with_sources",
    with_views(
        "edge_assertion",
        """SELECT src_id, dst_id, relation, string_agg(source || '@' || fetched_at, ',' ORDER BY source) AS asserted_by,
                  count(*) AS n_sources FROM edge_assertion GROUP BY 1, 2, 3""",
    ),
)
def edges_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = graph.edges_with_sources(graph.edge_assertions(fx.edge_in(spark, sf_dir)))
    label = F.transform("assertions", lambda a: F.concat_ws("@", a["source"], a["fetched_at"]))
    return nested.select(
        *graph.EDGE_KEY, F.array_join(label, ",").alias("asserted_by"), F.size("assertions").cast("long").alias("n_sources")
    )


def _edge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders citing part names (known to the catalog) and ship dates (never seen before)."""
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate")
    alias = lambda s, v: F.struct(F.lit(s).alias("scheme"), v.alias("value"))
    rest = [
        F.lit("cites").alias("relation"), F.col("l_returnflag").alias("source"), F.lit(None).cast("string").alias("attrs"),
        F.date_format("l_shipdate", fx.ISO_SECONDS).alias("fetched_at"), F.struct("l_linenumber", "l_shipdate").alias("seq"),
    ]
    order = alias("openalex", F.concat(F.lit("O"), F.col("l_orderkey")))
    known = lines.select(order.alias("src"), alias("mpn", F.col("l_partkey").cast("string")).alias("dst"), *rest)
    new = lines.select(order.alias("src"), alias("day", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("dst"), *rest)
    return known.unionByName(new)


@REG.query(
    "D1_put_edges",
    with_views(
        "aliases",
        """SELECT CASE WHEN k.canonical_id IS NULL THEN 'stub' ELSE 'known' END AS dst_state, i.scheme, i.value,
                  count(*) AS claims, count(DISTINCT i.src) AS sources
           FROM inputs i LEFT JOIN aliases k ON k.scheme = i.scheme AND k.value = i.value GROUP BY 1, 2, 3""",
        extra="""inputs AS (
  SELECT 'o' || l_orderkey AS src, 'mpn' AS scheme, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'o' || l_orderkey, 'day', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)""",
    ),
)
def put_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = cut_lineage(fx.aliases(spark, sf_dir))
    written = graph.put_edges(_edge_inputs(spark, sf_dir), known)
    labels = known.where("scheme = 'mpn'").withColumn("dst_state", F.lit("known")).unionByName(
        written.stub_aliases.withColumn("dst_state", F.lit("stub"))
    )
    per_target = written.claims.groupBy("dst_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_distinct("src_id").alias("sources")
    )
    return per_target.join(labels, per_target.dst_id == labels.canonical_id).select(
        "dst_state", "scheme", "value", "claims", "sources"
    )


@REG.query(
    "D3_edges_of_node",
    with_views(
        "edge",
        """SELECT src_id, dst_id, relation, total FROM (
             SELECT e.*, row_number() OVER (PARTITION BY src_id ORDER BY dst_id, relation) AS rn, count(*) OVER (PARTITION BY src_id) AS total
             FROM edge e WHERE src_id IN (SELECT 'p' || p_partkey FROM part)) WHERE rn <= 20""",
    ),
)
def edges_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.distinct_edges(fx.edge_in(spark, sf_dir))
    ids = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("canonical_id"))
    return graph.edges_of(edges, ids, "forward", 20)


@REG.query(
    "D3_edges_of_node_backward",
    with_views(
        "edge",
        """SELECT src_id, dst_id, relation, total FROM (
             SELECT e.*, row_number() OVER (PARTITION BY dst_id ORDER BY src_id, relation) AS rn, count(*) OVER (PARTITION BY dst_id) AS total
             FROM edge e WHERE dst_id IN (SELECT 's' || s_suppkey FROM supplier)) WHERE rn <= 200""",
    ),
)
def edges_of_node_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.distinct_edges(fx.edge_in(spark, sf_dir))
    ids = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("canonical_id"))
    return graph.edges_of(edges, ids, "backward", 200)


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("canonical_id"), F.col("p_name").alias("title")
    )


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    tags = F.array("p_type", F.element_at(F.split("p_name", " "), 1))
    return parts.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("canonical_id"), F.explode(tags).alias("concept"))


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -cites-> part: a part cites the one whose key is the supplier key of its lines."""
    return fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src_id"), F.concat(F.lit("p"), F.col("l_suppkey")).alias("dst_id"),
        F.lit("cites").alias("relation"),
    ).distinct()


PART_SQL = """works AS (SELECT 'p' || p_partkey AS canonical_id, p_name AS title FROM part),
concepts AS (SELECT 'p' || p_partkey AS canonical_id, unnest([p_type, split_part(p_name, ' ', 1)]) AS concept FROM part),
cites AS (SELECT DISTINCT 'p' || l_partkey AS src_id, 'p' || l_suppkey AS dst_id FROM lineitem)"""


@REG.query(
    "D7_cited_by_in_concept",
    with_views(
        "",
        """SELECT DISTINCT dst_id AS requested_id, w.canonical_id, title
           FROM cites JOIN works w ON w.canonical_id = src_id
           JOIN concepts a ON a.canonical_id = dst_id JOIN concepts b ON b.canonical_id = src_id AND b.concept = a.concept""",
        extra=PART_SQL,
    ),
)
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work asks for its citing works that share one of its concepts."""
    concepts = _concepts(spark, sf_dir)
    found = graph.cited_by(_part_edges(spark, sf_dir), _works(spark, sf_dir), concepts, concepts)
    return found.select("requested_id", "canonical_id", "title")


@REG.query(
    "D8_references",
    with_views(
        "",
        """SELECT l.src AS requested_id, l.href AS canonical_id, w.n AS linked_from FROM links l
           JOIN (SELECT href, count(DISTINCT src) AS n FROM links GROUP BY href) w ON w.href = l.href""",
        extra="""links AS (SELECT DISTINCT page_id AS src, href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))""",
    ),
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    links = pages.select(
        F.col("page_id").alias("src_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst_id")
    ).distinct()
    works = links.groupBy(F.col("dst_id").alias("canonical_id")).agg(F.count(F.lit(1)).alias("linked_from"))
    requests = pages.select(F.col("page_id").alias("canonical_id"))
    return graph.references(links, works, requests).select("requested_id", "canonical_id", "linked_from")


@REG.query(
    "D9_field_canon",
    with_views(
        "",
        """SELECT t.concept, t.canonical_id, count(e.src_id) AS in_degree
           FROM (SELECT DISTINCT * FROM concepts) t
           LEFT JOIN (SELECT c.concept, e.src_id, e.dst_id FROM cites e JOIN (SELECT DISTINCT * FROM concepts) c ON c.canonical_id = e.src_id) e
             ON e.dst_id = t.canonical_id AND e.concept = t.concept GROUP BY 1, 2""",
        extra=PART_SQL,
    ),
)
def field_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.field_canon(_part_edges(spark, sf_dir), _concepts(spark, sf_dir))


@REG.query(
    "D4_adjacency_walk",
    with_views("edge", "SELECT canonical_id, depth FROM visited", extra=WALK_FORWARD, recursive=True),
)
def adjacency_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over edges laid out by their ends; customers are seeds too, but no nodes of this graph, and are skipped."""
    layout = Adjacency(spark, work_folder(spark, "adjacency"))
    layout.add(fx.edge_in(spark, sf_dir))
    strangers = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("canonical_id"))
    nodes = fx.nodes(spark, sf_dir).where("kind <> 'venue'")
    found = layout.neighborhood(_seeds(spark, sf_dir).unionByName(strangers), "forward", 2, None, nodes)
    return found.nodes.select("canonical_id", "depth")


@REG.query(
    "D3_adjacency_edges",
    with_views(
        "edge",
        """SELECT src_id, dst_id, relation, total FROM (
             SELECT e.*, row_number() OVER (PARTITION BY dst_id ORDER BY src_id, relation) AS rn, count(*) OVER (PARTITION BY dst_id) AS total
             FROM edge e WHERE dst_id IN (SELECT 's' || s_suppkey FROM supplier)) WHERE rn <= 200""",
    ),
)
def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that enter each supplier, from the layout by target; they were added in two batches that overlap."""
    layout = Adjacency(spark, work_folder(spark, "adjacency"))
    edges = cut_lineage(graph.distinct_edges(fx.edge_in(spark, sf_dir)))
    layout.add(edges.where("src_id LIKE 'o%'"))
    layout.add(edges)
    ids = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("canonical_id"))
    return layout.edges_of(ids, "backward", 200)


@REG.query(
    "D6_neighborhood_described",
    with_views(
        "edge",
        """SELECT v.canonical_id, v.depth, count(c.src_id) AS in_degree, any_value(p_name) AS title, any_value(CASE WHEN p_partkey IS NULL THEN 0 ELSE 5 END) AS n_fields,
                  CASE left(v.canonical_id, 1) WHEN 'o' THEN 'topic' WHEN 'p' THEN 'work' ELSE 'author' END AS kind
           FROM visited v LEFT JOIN closed c ON c.dst_id = v.canonical_id LEFT JOIN part ON 'p' || p_partkey = v.canonical_id GROUP BY v.canonical_id, v.depth""",
        extra=WALK_FORWARD, recursive=True,
    ),
)
def neighborhood_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked walk with each node's kind and its merged fields."""
    found = graph.describe(_walk(spark, sf_dir, max_nodes=None).nodes, fx.nodes(spark, sf_dir), fx.work_assertions(spark, sf_dir))
    title = F.try_element_at("attrs", F.lit("title"))
    return found.select(
        "canonical_id", "depth", "in_degree", F.substring(title, F.lit(2), F.length(title) - 2).alias("title"), F.coalesce(F.size("attrs"), F.lit(0)).alias("n_fields"), "kind"
    ).withColumn("n_fields", F.greatest("n_fields", F.lit(0)))


def _mass_sql(rounds: int) -> str:
    """The rounds of `expand.spread_mass`, one table each."""
    out = [f"m0 AS (SELECT canonical_id AS id, {expand.UNIT}::BIGINT AS mass FROM seeds)", "steps AS (SELECT DISTINCT src_id AS near, dst_id AS far FROM edge)",
           "degree AS (SELECT near, count(*) AS n FROM steps GROUP BY near)"]
    for k in range(rounds):
        part = f"(mass * {expand.SPREAD} // 100) // n"
        out.append(f"""m{k + 1} AS (SELECT id, sum(mass)::BIGINT AS mass FROM (
          SELECT id, mass - coalesce(n, 0) * coalesce({part}, 0) AS mass FROM m{k} LEFT JOIN degree ON near = id
          UNION ALL SELECT far, {part} FROM m{k} JOIN degree ON near = id JOIN steps USING (near)) GROUP BY id)""")
    return ", ".join(out)


@REG.query(
    "D10_expand",
    with_views(
        "edge",
        f"SELECT id AS canonical_id, mass FROM m{expand.ROUNDS} WHERE mass > 0 AND id NOT IN (SELECT canonical_id FROM seeds) ORDER BY mass DESC, id LIMIT 500",
        extra=SEEDS_SQL + ", " + _mass_sql(expand.ROUNDS),
    ),
)
def expand_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget is the feature: five hundred nodes to read next, for a segment's orders."""
    edges = cut_lineage(graph.distinct_edges(fx.edge_in(spark, sf_dir)))
    return expand.proposals(expand.steps_of(edges), _seeds(spark, sf_dir), 500)
