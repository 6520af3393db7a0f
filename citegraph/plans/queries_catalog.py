"""Registered queries for catalog reads, search, counts and export snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.operators import artifacts, catalog, graph, semantic
from citegraph.operators.text_index import TextIndex
from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import with_views
from citegraph.plans.registry import Registry
from citegraph.session import cut_lineage, work_folder
from citegraph.sources import snapshots

REG = Registry()

LATEST_SQL = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, source ORDER BY seq DESC) AS rn FROM assertion_in) WHERE rn = 1)"""

FIELDS_SQL = """fields AS (
  SELECT canonical_id, source, fetched_at, 'k' AS key, k AS value FROM base
  UNION ALL SELECT canonical_id, source, fetched_at, 'event', '"' || event_type || '"' FROM base
  UNION ALL SELECT canonical_id, source, fetched_at, event_type || '_id', CAST(event_id AS VARCHAR) FROM base)"""

WINNERS_SQL = """SELECT canonical_id, key, value, source, fetched_at FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_id, key ORDER BY fetched_at DESC, source) AS rn FROM fields) WHERE rn = 1"""


@REG.query(
    "C1_merge_assertions",
    with_views("assertion_in", WINNERS_SQL, extra="base AS (SELECT * FROM assertion_in)," + FIELDS_SQL),
)
def merge_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a claim; the newest claim per user and field wins."""
    return catalog.merge_assertions(fx.assertion_in(spark, sf_dir))


@REG.query(
    "C1_merged_record",
    with_views(
        "assertion_in",
        f"""SELECT canonical_id, string_agg(key || '=' || value || '@' || source, ';' ORDER BY key) AS record
            FROM ({WINNERS_SQL}) GROUP BY canonical_id""",
        extra=LATEST_SQL + ", base AS (SELECT * FROM latest)," + FIELDS_SQL,
    ),
)
def merged_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = catalog.upsert_assertions(fx.assertion_in(spark, sf_dir))
    nested = catalog.nest_fields(catalog.merge_assertions(held))
    entries = F.transform(
        F.array_sort(F.map_keys("attrs")),
        lambda k: F.concat(k, F.lit("="), F.col("attrs")[k], F.lit("@"), F.col("provenance")[k]["source"]),
    )
    return nested.select("canonical_id", F.array_join(entries, ";").alias("record"))


def _odd_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per part that repeats a key; one part in seven states broken JSON."""
    part = fx.table(spark, sf_dir, "part")
    stated = F.concat(F.lit('{"a":'), "p_size", F.lit(',"b":"'), "p_brand", F.lit('","a":'), "p_partkey")
    return part.select(
        F.concat(F.lit("p"), "p_partkey").alias("canonical_id"), F.concat(F.lit("s"), F.col("p_partkey") % 3).alias("source"), F.lit("2024-01-01").alias("fetched_at"),
        F.when(F.col("p_partkey") % 7 == 0, stated).otherwise(F.concat(stated, F.lit("}"))).alias("attrs"),
    )


@REG.query(
    "C1_duplicate_keys",
    """SELECT 'p' || p_partkey AS canonical_id, k.key, CASE k.key WHEN 'a' THEN CAST(p_partkey AS VARCHAR) ELSE '"' || p_brand || '"' END AS value
       FROM part, (VALUES ('a'), ('b')) k(key) WHERE p_partkey % 7 <> 0""",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal keys the last counts, and the other keys of the object stay."""
    return catalog.assertion_fields(_odd_claims(spark, sf_dir)).select("canonical_id", "key", "value")


@REG.query("C1_rejects", "SELECT 's' || (p_partkey % 3) AS source, count(*) AS rejects FROM part WHERE p_partkey % 7 = 0 GROUP BY 1")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken claims are counted per provider."""
    return catalog.reject_counts(_odd_claims(spark, sf_dir))


@REG.query(
    "C3_upsert_node_assertion",
    with_views("assertion_in", "SELECT canonical_id, source, fetched_at, seq FROM latest", extra=LATEST_SQL),
)
def upsert_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert_assertions(fx.assertion_in(spark, sf_dir)).select("canonical_id", "source", "fetched_at", "seq")


ARTIFACT_SQL = """recorded AS (
  SELECT canonical_id, role, byte_size, content_hash, CAST(row_number() OVER w AS INTEGER) AS version,
         row_number() OVER w = count(*) OVER (PARTITION BY canonical_id, role) AS is_current
  FROM artifact_in WINDOW w AS (PARTITION BY canonical_id, role ORDER BY seq))"""

WORK_SQL = """claims AS (
  SELECT 'p' || p_partkey AS canonical_id, 'alpha' AS source, 'title' AS key, '"' || p_name || '"' AS value, '2024-01-01T00:00:00Z' AS fetched_at FROM part
  UNION ALL SELECT 'p' || p_partkey, 'alpha', 'publication_year', CAST(p_size + 1980 AS VARCHAR), '2024-01-01T00:00:00Z' FROM part
  UNION ALL SELECT 'p' || p_partkey, 'alpha', 'authorships', '[{"author":{"display_name":"' || p_brand || '"}}]', '2024-01-01T00:00:00Z' FROM part
  UNION ALL SELECT 'p' || p_partkey, 'beta', 'display_name', '"' || upper(p_name) || '"', '2024-06-01T00:00:00Z' FROM part
  UNION ALL SELECT 'p' || p_partkey, 'beta', 'authors', '[{"name":"Maker ' || p_size || '"},"' || lower(p_type) || '"]', '2024-06-01T00:00:00Z' FROM part)"""


def _held_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part holds `fulltext` when its size is odd and `abstract` when it is large."""
    parts = fx.table(spark, sf_dir, "part")
    roles = F.filter(
        F.array(F.when(F.col("p_size") % 2 == 1, F.lit("fulltext")), F.when(F.col("p_size") >= 30, F.lit("abstract"))),
        lambda r: r.isNotNull(),
    )
    return parts.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("canonical_id"), F.explode(roles).alias("role"),
        F.lit(1).alias("version"), F.lit(True).alias("is_current"),
    )


HELD_SQL = """held AS (
  SELECT 'p' || p_partkey AS canonical_id, 'fulltext' AS role FROM part WHERE p_size % 2 = 1
  UNION ALL SELECT 'p' || p_partkey, 'abstract' FROM part WHERE p_size >= 30)"""


@REG.query(
    "C2_work_view",
    with_views(
        "aliases nodes",
        """SELECT canonical_id, 'work' AS kind, 'field' AS part, key, value, source, fetched_at FROM claims
           UNION ALL SELECT canonical_id, n.kind, 'alias', scheme, value, NULL, NULL FROM aliases JOIN nodes n USING (canonical_id) WHERE n.merged_into IS NULL
           UNION ALL SELECT canonical_id, 'work', 'artifact', role, '1', NULL, NULL FROM held""",
        extra=WORK_SQL + "," + HELD_SQL,
    ),
)
def work_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.work_views(
        fx.nodes(spark, sf_dir), fx.work_assertions(spark, sf_dir), fx.aliases(spark, sf_dir), _held_artifacts(spark, sf_dir)
    )


def _search(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return catalog.search_works(fx.nodes(spark, sf_dir), fx.work_assertions(spark, sf_dir), **filters)


@REG.query(
    "C4_search_author",
    "SELECT 'p' || p_partkey AS canonical_id FROM part WHERE p_brand ILIKE '%brand#1%' OR ('Maker ' || p_size) ILIKE '%brand#1%' OR p_type ILIKE '%brand#1%'",
)
def search_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, author="bRaNd#1")


@REG.query("C4_search_author_bare", "SELECT 'p' || p_partkey AS canonical_id FROM part WHERE p_type ILIKE '%econ%' OR p_brand ILIKE '%econ%'")
def search_author_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare author strings count; the same text in a title would not."""
    return _search(spark, sf_dir, author="ECON")


@REG.query("C5_search_title", "SELECT 'p' || p_partkey AS canonical_id FROM part WHERE p_name ILIKE '%red%'")
def search_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, title="Red")


@REG.query("C6_search_year", "SELECT 'p' || p_partkey AS canonical_id FROM part WHERE p_size = 11")
def search_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, year=1991)


@REG.query(
    "C7_search_combined",
    "SELECT 'p' || p_partkey AS canonical_id FROM part WHERE p_name ILIKE '%ring%' AND 'Maker ' || p_size ILIKE '%maker 1%'",
)
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title from one provider, author from the other."""
    return _search(spark, sf_dir, title="ring", author="maker 1")


@REG.query(
    "C8_search_with_artifact",
    "SELECT 'p' || p_partkey AS canonical_id FROM part WHERE p_name ILIKE '%b%' AND p_size % 2 = 1 ORDER BY canonical_id LIMIT 200",
)
def search_with_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first page of works by id, after the artifact filter."""
    return _search(
        spark, sf_dir, title="b", with_artifact="fulltext", artifacts=_held_artifacts(spark, sf_dir), limit=200
    )


@REG.query(
    "C9_filter_works",
    """SELECT 'p' || p_partkey AS canonical_id, p_name AS title FROM part
       WHERE p_size + 1980 IN (1990, 1995, 2001) AND p_type IN ('PROMO', 'LARGE')""",
)
def filter_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("canonical_id"), F.col("p_name").alias("title"),
        (F.col("p_size") + 1980).alias("publication_year"), F.array("p_type", "p_brand").alias("concepts_id"),
    )
    found = catalog.filter_works(works, ["publication_year:1990|1995|2001", "concepts.id:PROMO|LARGE"])
    return found.select("canonical_id", "title")


def recorded_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.record_artifacts(fx.artifact_in(spark, sf_dir))


@REG.query(
    "C10_stats",
    with_views(
        "nodes edge assertion_in artifact_in",
        """SELECT 'works' AS metric, count(*) AS value FROM nodes WHERE kind = 'work' AND merged_into IS NULL
           UNION ALL SELECT 'works_described', count(*) FROM nodes WHERE kind = 'work' AND merged_into IS NULL AND canonical_id IN (SELECT canonical_id FROM described)
           UNION ALL SELECT 'works_stub', count(*) FROM nodes WHERE kind = 'work' AND merged_into IS NULL AND canonical_id NOT IN (SELECT canonical_id FROM described)
           UNION ALL SELECT 'nodes_total', count(*) FROM nodes WHERE merged_into IS NULL
           UNION ALL SELECT 'merge_redirects', count(*) FROM nodes WHERE merged_into IS NOT NULL
           UNION ALL SELECT 'edges_total', count(*) FROM edge
           UNION ALL SELECT 'library_bytes', CAST(sum(byte_size) AS BIGINT) FROM artifact_in""",
        extra="described AS (SELECT 'd' || doc_id AS canonical_id FROM labels UNION SELECT 's' || s_suppkey FROM supplier)",
    ),
)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works are parts and documents; documents with a label and all suppliers are described."""
    described = fx.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("canonical_id")
    ).unionByName(fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("canonical_id")))
    edges = graph.distinct_edges(fx.edge_in(spark, sf_dir))
    return catalog.stats(fx.nodes(spark, sf_dir), described, edges, fx.artifact_in(spark, sf_dir))


@REG.query(
    "C11_tallies",
    with_views(
        "nodes edge assertion_in",
        """SELECT 'kind' AS dimension, kind AS key, count(*) AS count FROM nodes WHERE merged_into IS NULL GROUP BY kind
           UNION ALL SELECT 'relation', relation, count(*) FROM edge GROUP BY relation
           UNION ALL SELECT 'source', source, count(*) FROM latest GROUP BY source""",
        extra=LATEST_SQL,
    ),
)
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = catalog.upsert_assertions(fx.assertion_in(spark, sf_dir))
    return catalog.tallies(fx.nodes(spark, sf_dir), held, graph.distinct_edges(fx.edge_in(spark, sf_dir)))


@REG.query(
    "C12_works_without_alias",
    with_views(
        "nodes aliases",
        "SELECT canonical_id, kind FROM nodes WHERE merged_into IS NULL AND canonical_id NOT IN (SELECT canonical_id FROM aliases)",
    ),
)
def without_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.without_alias(fx.nodes(spark, sf_dir), fx.aliases(spark, sf_dir)).select("canonical_id", "kind")


@REG.query(
    "A16_export_nodes",
    with_views(
        "nodes aliases",
        """SELECT n.canonical_id, n.kind, coalesce(a.names, '') AS names, coalesce(c.sources, '') AS sources
           FROM nodes n
           LEFT JOIN (SELECT canonical_id, string_agg(scheme || ':' || value, ',' ORDER BY scheme, value) AS names FROM aliases GROUP BY 1) a USING (canonical_id)
           LEFT JOIN (SELECT DISTINCT canonical_id, 'alpha,beta' AS sources FROM claims) c USING (canonical_id)
           WHERE n.merged_into IS NULL""",
        extra=WORK_SQL,
    ),
)
def export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node at every size, as the SQL gives it: the parts of a crowded node are put together again."""
    parts = snapshots.export_nodes(fx.nodes(spark, sf_dir), fx.aliases(spark, sf_dir), fx.work_assertions(spark, sf_dir))
    whole = lambda column: F.array_sort(F.flatten(F.collect_list(column))).alias(column)
    rows = parts.groupBy("canonical_id", "kind").agg(whole("aliases"), whole("assertions"))
    label = lambda column, text: F.coalesce(F.array_join(F.transform(column, text), ","), F.lit(""))
    return rows.select(
        "canonical_id", "kind", label("aliases", lambda a: F.concat_ws(":", a["scheme"], a["value"])).alias("names"),
        label("assertions", lambda a: a["source"]).alias("sources"),
    )


@REG.query("A17_export_edge_assertions", with_views("edge_assertion", "SELECT src_id, dst_id, relation, source, fetched_at, attrs FROM edge_assertion"))
def export_edge_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.export_edge_assertions(graph.edge_assertions(fx.edge_in(spark, sf_dir)))


@REG.query(
    "A18_export_artifacts",
    with_views("artifact_in", "SELECT canonical_id, role, version, content_hash FROM recorded WHERE is_current", extra=ARTIFACT_SQL),
)
def export_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.export_artifacts(recorded_artifacts(spark, sf_dir)).select("canonical_id", "role", "version", "content_hash")


# ── artifacts ────────────────────────────────────────────────────────────────


@REG.query(
    "E1_record_artifact",
    with_views(
        "artifact_in",
        """SELECT canonical_id, role, version, is_current, canonical_id || '/' || role || '/v' || version AS key, byte_size
           FROM recorded""",
        extra=ARTIFACT_SQL,
    ),
)
def record_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded_artifacts(spark, sf_dir).select("canonical_id", "role", "version", "is_current", "key", "byte_size")


@REG.query(
    "E1_record_artifact_on_held",
    with_views(
        "",
        """SELECT canonical_id, role, content_hash, CAST(h.n + row_number() OVER (PARTITION BY d.source ORDER BY d.seq) AS INTEGER) AS version
           FROM (SELECT source, doc_id AS seq, source AS canonical_id, 'text' AS role, sha256(text) AS content_hash FROM documents WHERE lang <> 'en') d
           JOIN (SELECT source, count(*) FILTER (WHERE lang = 'en') AS n FROM documents GROUP BY source) h ON h.source = d.source""",
    ),
)
def record_artifact_on_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts are held already; the others arrive after them in the same role."""
    docs = fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("canonical_id"), F.lit("text").alias("role"), F.sha2("text", 256).alias("content_hash"),
        F.col("doc_id").alias("seq"), "lang",
    )
    held = artifacts.record_artifacts(docs.where("lang = 'en'").drop("lang"))
    both = artifacts.record_artifacts(docs.where("lang <> 'en'").withColumn("late", F.lit(True)).drop("lang"), held)
    return both.where("late").select("canonical_id", "role", "content_hash", "version")


@REG.query(
    "E2_list_artifacts",
    with_views(
        "artifact_in",
        """SELECT canonical_id, role, version FROM recorded
           WHERE role = 'fr' AND canonical_id IN (SELECT DISTINCT source FROM documents WHERE lang = 'de')""",
        extra=ARTIFACT_SQL,
    ),
)
def list_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("canonical_id"))
    return artifacts.list_artifacts(recorded_artifacts(spark, sf_dir), asked, "fr", all_versions=True).select(
        "canonical_id", "role", "version"
    )


@REG.query(
    "E3_content_outcome",
    with_views(
        "",
        """SELECT 'd' || d.doc_id AS canonical_id, r.role,
                  CASE WHEN r.role = 'abstract' AND l.doc_id IS NULL THEN 'absent' WHEN r.role = 'fulltext' AND d.lang = 'en' THEN 'pending'
                       WHEN r.role = 'abstract' THEN 'pending' ELSE 'bytes' END AS outcome,
                  CASE WHEN r.role = 'fulltext' AND d.lang <> 'en' THEN CAST(octet_length(encode(d.text)) AS BIGINT) END AS length,
                  CASE WHEN r.role = 'fulltext' AND d.lang <> 'en' THEN 'application/octet-stream' END AS mime
           FROM documents d CROSS JOIN (SELECT unnest(['abstract', 'fulltext']) AS role) r
           LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
)
def content_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has a full-text descriptor, labelled ones an abstract; only non-English full texts have a blob."""
    docs = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("canonical_id"), "doc_id", "lang", "text"
    )
    descriptor = lambda df, role: df.select(
        "canonical_id", F.lit(role).alias("role"), F.concat_ws("/", "canonical_id", F.lit(role), F.lit("v1")).alias("key"),
        F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("mime"),
    )
    labelled = docs.join(fx.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    held = descriptor(docs, "fulltext").unionByName(descriptor(labelled, "abstract"))
    content = F.encode(F.col("text"), "UTF-8")
    blobs = docs.where("lang <> 'en'").select(
        F.concat_ws("/", "canonical_id", F.lit("fulltext"), F.lit("v1")).alias("key"),
        F.octet_length(content).cast("long").alias("length"), artifacts.sniff_mime(content).alias("sniffed"),
    )
    asked = docs.select("canonical_id", F.explode(F.array(F.lit("abstract"), F.lit("fulltext"))).alias("role"))
    return artifacts.content_outcome(asked, held, blobs).drop("key")


DERIVED_SQL = ARTIFACT_SQL + """,
derived AS (
  SELECT canonical_id, role, version, CASE WHEN version > 1 THEN role END AS prole,
         CASE WHEN version > 1 THEN CASE WHEN version % 97 = 0 THEN version + 100000 ELSE version - 1 END END AS pversion FROM recorded),
tree(canonical_id, role, version, depth, dangling) AS (
  SELECT d.canonical_id, d.role, d.version, 0, d.prole || ' v' || d.pversion FROM derived d
  WHERE NOT EXISTS (SELECT 1 FROM derived p WHERE p.canonical_id = d.canonical_id AND p.role = d.prole AND p.version = d.pversion)
  UNION ALL
  SELECT d.canonical_id, d.role, d.version, depth + 1, NULL FROM derived d
  JOIN tree t ON t.canonical_id = d.canonical_id AND t.role = d.prole AND t.version = d.pversion)"""


@REG.query(
    "E4_derivation_tree",
    with_views("artifact_in", "SELECT canonical_id, role, version, depth, dangling, FALSE AS cycle FROM tree", extra=DERIVED_SQL, recursive=True),
)
def derivation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version v derives from v - 1, so chains are deep; multiples of 97 name a parent that is not there."""
    v = F.col("version")
    parent = F.when(v % 97 == 0, v + 100000).otherwise(v - 1)
    derived = recorded_artifacts(spark, sf_dir).select(
        "canonical_id", "role", "version", F.when(v > 1, F.col("role")).alias("derived_from_role"),
        F.when(v > 1, parent).alias("derived_from_version"),
    )
    return artifacts.derivation_tree(derived).drop("path")


@REG.query(
    "C7_search_indexed",
    """WITH found AS (
         SELECT 'author' AS search, p_partkey FROM part WHERE p_brand ILIKE '%brand#1%' OR ('Maker ' || p_size) ILIKE '%brand#1%' OR p_type ILIKE '%brand#1%'
         UNION ALL SELECT 'bare author', p_partkey FROM part WHERE p_type ILIKE '%econ%' OR p_brand ILIKE '%econ%'
         UNION ALL SELECT 'title', p_partkey FROM part WHERE p_name ILIKE '%red%'
         UNION ALL SELECT 'combined', p_partkey FROM part WHERE p_name ILIKE '%ring%' AND 'Maker ' || p_size ILIKE '%maker 1%'
         UNION ALL SELECT 'short', p_partkey FROM part WHERE p_name ILIKE '%b%' AND p_size = 11)
       SELECT search, 'p' || p_partkey AS canonical_id FROM found""",
)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches above through an index of trigrams: claims are parsed when they are added, not when they are searched."""
    index = TextIndex(spark, work_folder(spark, "text-index"))
    index.add(fx.work_assertions(spark, sf_dir))
    nodes = cut_lineage(fx.nodes(spark, sf_dir))
    asked = {
        "author": {"author": "bRaNd#1"}, "bare author": {"author": "ECON"}, "title": {"title": "Red"}, "combined": {"title": "ring", "author": "maker 1"},
        "short": {"title": "B", "year": 1991},
    }
    found = [index.search_works(nodes, **filters).select(F.lit(name).alias("search"), "canonical_id") for name, filters in asked.items()]
    return reduce(DataFrame.unionByName, found)


@REG.query(
    "E5_fnv1a",
    """SELECT p_partkey, 'fnv1a:' || lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT,
              list_transform(range(0, octet_length(encode(p_name))), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i::INT + 1, 2))::INT::HUGEINT)),
              lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616)::UBIGINT)), 16, '0') AS content_hash FROM part""",
)
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", artifacts.fnv1a(F.encode(F.col("p_name"), "UTF-8")).alias("content_hash"))


@REG.query("E5_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", artifacts.content_hash(F.encode(F.col("text"), "UTF-8")).alias("content_hash")
    )


STOP_SQL = ", ".join(f"'{w}'" for w in artifacts.TITLE_STOP_WORDS)


@REG.query(
    "E6_bibliographic_key",
    with_views(
        "",
        """SELECT canonical_id, stem || CASE WHEN n = 1 THEN '' WHEN n <= 26 THEN chr(CAST(n + 96 AS INTEGER)) ELSE '-' || n END AS key
           FROM (SELECT canonical_id, stem, row_number() OVER (PARTITION BY stem ORDER BY canonical_id) AS n FROM stems)""",
        extra=f"""titles AS (
  SELECT item_id, regexp_split_to_array(strip_accents(text), '[[:space:]-]+') AS names,
         list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '') AS words
  FROM (SELECT item_id, replace(text, 'ß', 'ss') AS text FROM benchmark UNION ALL SELECT 1000000 + doc_id, replace(split_part(text, chr(10), 1), 'ß', 'ss') FROM documents)),
stems AS (
  SELECT 'b' || item_id AS canonical_id,
         (SELECT string_agg(upper(w[1]) || lower(w[2:]), '' ORDER BY i) FROM (SELECT regexp_replace(unnest(names[1:2]), '[^A-Za-z0-9]', '', 'g') AS w, unnest(range(2)) AS i))
         || CASE WHEN item_id % 2 = 1 THEN 'EtAl' ELSE '' END || '2001-'
         || coalesce(nullif(array_to_string(list_filter(words, lambda w: w NOT IN ({STOP_SQL}))[1:5], '-'), ''), words[1], 'untitled') AS stem
  FROM titles)""",
    ),
)
def bibliographic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are first lines of documents and benchmark texts; authors are the first two words."""
    docs = fx.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1000000).alias("item_id"),
        F.substring_index("text", "\n", 1).alias("text"),
    )
    titles = fx.table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(docs)
    works = titles.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("canonical_id"),
        F.array_join(F.slice(F.split("text", r"[\s-]+"), 1, 2), " ").alias("first_author"),
        (F.col("item_id") % 2 + 1).alias("n_authors"), F.lit(2001).alias("year"), F.col("text").alias("title"),
    )
    return artifacts.bibliographic_keys(works)


@REG.query(
    "S1_semantic_search",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
       SELECT query_id, rank::INTEGER AS rank, id FROM (
         SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS rank
         FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors by cosine, for every vector whose id is divisible by 100."""
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return semantic.nearest(semantic.build(vectors), vectors.where("vec_id % 100 = 0"), exact=True).select("query_id", "rank", "id")


@REG.query(
    "C11_level_counts",
    with_views(
        "nodes",
        """SELECT grouping_id(kind, source) AS level, kind, source, count(*) AS claims, true AS works_within_error
           FROM (SELECT 'p' || p_partkey AS canonical_id, unnest(['alpha', 'beta']) AS source FROM part) JOIN nodes USING (canonical_id)
           GROUP BY GROUPING SETS ((kind, source), (kind), (source), ())""",
    ),
)
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of claims that overlap, each sketched and then merged; the estimate of different works is held against the count."""
    nodes, claims = fx.nodes(spark, sf_dir), fx.work_assertions(spark, sf_dir)
    parts = [claims.where("source = 'alpha'"), claims.where("source = 'beta'")]
    merged = catalog.level_counts(reduce(DataFrame.unionByName, [catalog.claim_sketches(nodes, part) for part in parts]))
    works = fx.table(spark, sf_dir, "part").agg(F.count_distinct("p_partkey").alias("exact"))
    within = F.abs(F.col("works") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (catalog.LG_K / 2) * F.col("exact"))
    return merged.crossJoin(F.broadcast(works)).select("level", "kind", "source", "claims", within.alias("works_within_error"))


@REG.query(
    "C2_view_by_alias",
    with_views(
        "aliases nodes",
        """SELECT r.scheme, r.value, v.* FROM asked r JOIN (
             SELECT canonical_id, 'field' AS part, key, value AS text, source FROM claims
             UNION ALL SELECT canonical_id, 'alias', scheme, value, NULL FROM aliases
             UNION ALL SELECT canonical_id, 'artifact', role, 'descriptor', NULL FROM held) v USING (canonical_id)""",
        extra=WORK_SQL + "," + HELD_SQL + """,
asked AS (SELECT scheme, value, canonical_id FROM aliases WHERE scheme = 'doi' OR (scheme = 'openalex' AND canonical_id LIKE 's%'))""",
    ),
)
def view_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their `doi` and suppliers by their id, and an alias that nobody has."""
    aliases = fx.aliases(spark, sf_dir)
    asked = aliases.where("scheme = 'doi' OR (scheme = 'openalex' AND canonical_id LIKE 's%')").select("scheme", "value")
    asked = asked.unionByName(spark.createDataFrame([("doi", "nobody's")], "scheme string, value string"))
    views = catalog.views_by_alias(asked, fx.nodes(spark, sf_dir), fx.work_assertions(spark, sf_dir), aliases, _held_artifacts(spark, sf_dir))
    text = F.when((F.col("part") == "artifact") & F.col("text").contains('"version":1'), "descriptor").otherwise(F.col("text"))
    return views.select("scheme", "value", "canonical_id", "part", "key", text.alias("text"), "source")


@REG.query(
    "A16_export_flat",
    with_views(
        "nodes aliases",
        """SELECT 'node' AS what, canonical_id, kind AS a, '' AS b FROM nodes WHERE merged_into IS NULL
           UNION ALL SELECT 'alias', canonical_id, scheme, value FROM aliases SEMI JOIN (SELECT * FROM nodes WHERE merged_into IS NULL) USING (canonical_id)
           UNION ALL SELECT 'assertion', 'p' || p_partkey, unnest(['alpha', 'beta']), unnest(['2024-01-01T00:00:00Z', '2024-06-01T00:00:00Z']) FROM part""",
    ),
)
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, aliases and assertions as rows of their own."""
    out = snapshots.export_flat(fx.nodes(spark, sf_dir), fx.aliases(spark, sf_dir), fx.work_assertions(spark, sf_dir))
    label = lambda table, what, a, b: table.select(F.lit(what).alias("what"), "canonical_id", F.col(a).alias("a"), b.alias("b"))
    return label(out["nodes"], "node", "kind", F.lit("")).unionByName(label(out["aliases"], "alias", "scheme", F.col("value"))).unionByName(
        label(out["assertions"], "assertion", "source", F.col("fetched_at"))
    )
