"""Registered queries for provider sources: the driver's tables written as provider records, then read back.

Part = work W…, supplier = author A…, customer = source S…, region = topic T…, nation = institution I….
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.functions import id_columns
from citegraph.operators import store_sync
from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import with_views
from citegraph.plans.registry import Registry
from citegraph.session import cut_lineage
from citegraph.sources import arxiv, emission, manual, openalex, references, semanticscholar

REG = Registry()
NOW = "2024-01-01T00:00:00Z"


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _url(letter: str, column: str) -> Column:
    return F.concat(F.lit(f"https://openalex.org/{letter}"), _text(column))


def openalex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value) records of five entities, with the mag id a number for even parts and a string for odd ones."""
    t = lambda name: fx.table(spark, sf_dir, name)
    doi = F.concat(F.lit("https://doi.org/10.1/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), _text("p_partkey"))
    mag = F.when(F.col("p_partkey") % 2 == 0, _text("p_partkey")).otherwise(F.concat(F.lit('"'), _text("p_partkey"), F.lit('"')))
    spread = lambda name, *columns: fx.spread(spark, sf_dir, name, *columns)
    works = spread("part", "p_partkey", "p_name", "p_size", "p_type", "p_brand").select(
        F.concat(
            F.lit('{"id":"'), _url("W", "p_partkey"), F.lit('","ids":{"doi":"'), doi, F.lit('","mag":'), mag,
            F.lit('},"display_name":"'), "p_name", F.lit('","publication_year":'), (F.col("p_size") + 1980).cast("string"),
            F.lit(',"type":"'), "p_type", F.lit('","cited_by_count":'), _text("p_size"),
            F.lit(',"authorships":[{"author_position":"first","author":{"id":"a","display_name":"'), "p_brand",
            F.lit('","extra":1},"institutions":[{"id":"i","country_code":"XX","type":"t"}],"is_corresponding":true},{"author":{"display_name":""}}]'),
            F.lit(',"primary_location":{"source":{"display_name":"'), "p_type", F.lit('"}},"secret":"dropped"'),
            F.lit(',"referenced_works":["'), _url("W", "p_size"), F.lit('","W'), (F.col("p_partkey") + 1).cast("string"), F.lit('"]}'),
        ).alias("value")
    )
    orcid = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(',"orcid":"https://orcid.org/0000-'), _text("s_suppkey"), F.lit('"'))).otherwise("")
    authors = spread("supplier", "s_suppkey", "s_name").select(
        F.concat(F.lit('{"id":"'), _url("A", "s_suppkey"), F.lit('","display_name":"'), "s_name", F.lit('"'), orcid, F.lit("}")).alias("value")
    )
    venues = spread("customer", "c_custkey", "c_nationkey").select(
        F.concat(
            F.lit('{"id":"'), _url("S", "c_custkey"), F.lit('","issn_l":"L'), _text("c_custkey"), F.lit('","issn":["L'), _text("c_custkey"),
            F.lit('","M'), _text("c_nationkey"), F.lit('"]}'),
        ).alias("value")
    )
    topics = t("region").select(F.concat(F.lit('{"id":"'), _url("T", "r_regionkey"), F.lit('"}')).alias("value"))
    places = t("nation").select(F.concat(F.lit('{"id":"'), _url("I", "n_nationkey"), F.lit('"}')).alias("value"))
    return works.unionByName(authors).unionByName(venues).unionByName(topics).unionByName(places)


def _of_entity(lines: DataFrame, entity: str) -> DataFrame:
    return lines.where(id_columns.openalex_entity(F.get_json_object("value", "$.id"))["entity"] == entity)


@REG.query(
    "A1_read_openalex",
    """SELECT 'record' AS what, 'work' AS name, count(*) AS count FROM part UNION ALL SELECT 'record', 'author', count(*) FROM supplier
       UNION ALL SELECT 'record', 'venue', count(*) FROM customer UNION ALL SELECT 'record', 'topic', count(*) FROM region
       UNION ALL SELECT 'skipped', 'institutions', count(*) FROM nation UNION ALL SELECT 'edge', 'cites', 2 * count(*) FROM part""",
)
def read_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = openalex.parse(openalex_lines(spark, sf_dir), NOW)
    tally = lambda df, what, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(what).alias("what"), "name", "count"
    )
    skipped = out.skipped.select(F.lit("skipped").alias("what"), F.col("reason").alias("name"), "count")
    return tally(out.records, "record", "kind").unionByName(tally(out.edges, "edge", "relation")).unionByName(skipped)


@REG.query(
    "A2_openalex_aliases",
    """SELECT 'openalex:W' || p_partkey AS record_id, unnest(['openalex', 'doi', 'mag']) AS scheme,
              unnest(['W' || p_partkey, '10.1/' || replace(p_name, ' ', '.') || '.' || p_partkey, '' || p_partkey]) AS value FROM part
       UNION ALL SELECT 'openalex:A' || s_suppkey, 'openalex', 'A' || s_suppkey FROM supplier
       UNION ALL SELECT 'openalex:A' || s_suppkey, 'orcid', '0000-' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0
       UNION ALL SELECT 'openalex:S' || c_custkey, unnest(['openalex', 'issn_l', 'issn', 'issn']), unnest(['S' || c_custkey, 'L' || c_custkey, 'L' || c_custkey, 'M' || c_nationkey]) FROM customer
       UNION ALL SELECT 'openalex:T' || r_regionkey, 'openalex', 'T' || r_regionkey FROM region""",
)
def openalex_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = openalex.parse(openalex_lines(spark, sf_dir), NOW).records
    return records.select("record_id", F.explode("aliases").alias("a")).select("record_id", "a.*")


@REG.query(
    "A3_openalex_cites",
    """SELECT 'W' || p_partkey AS src, unnest(['W' || p_size, 'W' || (p_partkey + 1)]) AS dst FROM part
       UNION ALL SELECT 'W' || p_partkey, 'W' || p_size FROM part""",
)
def openalex_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of referenced works, and in from the results of cited-by requests."""
    lines = openalex_lines(spark, sf_dir)
    works = _of_entity(lines, "works")
    answers = works.select("value", F.get_json_object("value", "$.referenced_works[0]").alias("cited"))
    incoming = openalex.cites_edges(openalex.citing_pairs(answers), NOW)
    edges = openalex.parse(lines, NOW).edges.unionByName(emission.with_seq(incoming))
    return edges.select(F.col("src.value").alias("src"), F.col("dst.value").alias("dst"))


def _empty_store(spark: SparkSession) -> store_sync.Store:
    none = lambda schema: spark.createDataFrame([], schema)
    return store_sync.Store(
        none("canonical_id string, kind string, merged_into string"), none("scheme string, value string, canonical_id string"),
        none("canonical_id string, source string, attrs string, fetched_at string"),
        none("src_id string, dst_id string, relation string, source string, fetched_at string, attrs string"),
        none("canonical_id string, role string, version int, is_current boolean, derived_from_role string, derived_from_version int"),
    )


@REG.query(
    "B1_apply_emission",
    """WITH refs AS (SELECT DISTINCT p_partkey AS src, unnest([p_size, p_partkey + 1]) AS dst FROM part),
            stubs AS (SELECT DISTINCT dst FROM refs WHERE dst NOT IN (SELECT p_partkey FROM part)),
            venues AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer)
       SELECT 'node work' AS metric, (SELECT count(*) FROM part) + (SELECT count(*) FROM stubs) AS n
       UNION ALL SELECT 'node author', count(*) FROM supplier UNION ALL SELECT 'node venue', n FROM venues UNION ALL SELECT 'node topic', count(*) FROM region
       UNION ALL SELECT 'aliases', 3 * (SELECT count(*) FROM part) + (SELECT count(*) FROM stubs) + (SELECT count(*) + count(*) FILTER (s_suppkey % 3 = 0) FROM supplier)
                 + (SELECT 3 * count(*) + count(DISTINCT c_nationkey) FROM customer) + (SELECT count(*) FROM region)
       UNION ALL SELECT 'assertions', (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT n FROM venues) + (SELECT count(*) FROM region)
       UNION ALL SELECT 'edges', count(*) FROM refs""",
)
def apply_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's records and edges are written into an empty store, twice; sources that share an ISSN become one venue."""
    given = openalex.parse(openalex_lines(spark, sf_dir), NOW)
    given = emission.Emission(cut_lineage(given.records), cut_lineage(given.edges), given.skipped)  # parsed once for both
    once = store_sync.apply_emission(_empty_store(spark), given).store
    store = store_sync.apply_emission(once, given).store
    kinds = store.live_nodes().groupBy(F.concat(F.lit("node "), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    for name, table in (("aliases", store.aliases), ("assertions", store.assertions), ("edges", store.edges())):
        kinds = kinds.unionByName(table.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("n")))
    return kinds


def _paper(id_: Column, doi: Column, extra: Column | None = None) -> Column:
    """A paper's JSON; a null id or DOI leaves the field out."""
    ids = F.concat(F.lit('"externalIds":{'), F.coalesce(F.concat(F.lit('"DOI":"'), doi, F.lit('",')), F.lit("")), F.lit('"CorpusId":7}'))
    return F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"paperId":"'), id_, F.lit('",')), F.lit("")), extra if extra is not None else F.lit(""), ids, F.lit("}"))


@REG.query(
    "A4_read_semanticscholar",
    """SELECT 'work' AS kind, 'p' || p_partkey AS first_value, unnest(['s2', 'doi', 'corpusid']) AS scheme,
              unnest(['p' || p_partkey, '10.2/' || p_partkey, '7']) AS value FROM part WHERE p_size % 2 = 1
       UNION ALL SELECT 'work', 'p' || p_partkey, unnest(['s2', 'corpusid']), unnest(['p' || p_partkey, '7']) FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT 'author', '' || s_suppkey, unnest(['s2author', 'orcid']), unnest(['' || s_suppkey, '0-' || s_suppkey]) FROM supplier""",
)
def read_semanticscholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("https://doi.org/10.2/"), _text("p_partkey")))
    papers = fx.table(spark, sf_dir, "part").select(_paper(F.concat(F.lit("p"), _text("p_partkey")), doi).alias("value"))
    authors = fx.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit('{"authorId":"'), _text("s_suppkey"), F.lit('","externalIds":{"ORCID":"0-'), _text("s_suppkey"), F.lit('"}}')).alias("value")
    )
    records = semanticscholar.paper_records(papers, NOW).unionByName(semanticscholar.author_records(authors, NOW))
    first = F.get("aliases", F.lit(0))["value"]
    return records.select("kind", first.alias("first_value"), F.explode("aliases").alias("a")).select("kind", "first_value", "a.*")


def _citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order line: the part is cited by the order (with a DOI on odd orders) and by a paper without any id."""
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    doi = F.when(F.col("l_orderkey") % 2 == 1, F.concat(F.lit("10.3/"), _text("l_orderkey")))
    citing = _paper(F.concat(F.lit("o"), _text("l_orderkey")), doi)
    nameless = _paper(F.lit(None).cast("string"), F.lit(None).cast("string"))
    page = F.concat(F.lit('{"offset":0,"data":[{"citingPaper":'), citing, F.lit('},{"citingPaper":'), nameless, F.lit("}]}"))
    return lines.select(_paper(F.concat(F.lit("p"), _text("l_partkey")), F.lit(None).cast("string")).alias("seed"), page.alias("value"))


@REG.query(
    "A5_s2_citation_pages",
    """SELECT CASE WHEN l_orderkey % 2 = 1 THEN 'doi:10.3/' || l_orderkey ELSE 's2:o' || l_orderkey END AS src, 's2:p' || l_partkey AS dst, count(*) AS n
       FROM lineitem GROUP BY 1, 2
       UNION ALL SELECT 'skipped', 'unknown_endpoint', count(*) FROM lineitem""",
)
def s2_citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semanticscholar.parse_citation_pages(_citation_pages(spark, sf_dir), "citingPaper", NOW)
    end = lambda c: F.concat_ws(":", f"{c}.scheme", f"{c}.value").alias(c)
    edges = out.edges.select(end("src"), end("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return edges.unionByName(out.skipped.select(F.lit("skipped").alias("src"), F.col("reason").alias("dst"), F.col("count").alias("n")))


def _crossref_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links as references, in mixed case, and one entry without a DOI."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    refs = F.array_join(F.transform(links, lambda l: F.concat(F.lit('{"DOI":"10.9'), l, F.lit('"}'))), ",")
    value = F.concat(F.lit('{"message":{"reference":[{"unstructured":"x"}'), F.when(refs != "", F.concat(F.lit(","), refs)).otherwise(""), F.lit("]}}"))
    return fx.table(spark, sf_dir, "pages").select(_text("page_id").alias("citing"), value.alias("value"))


LINK_SQL = """links AS (SELECT '' || page_id AS citing, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


@REG.query(
    "A6_read_crossref_refs",
    with_views(
        "",
        """SELECT citing, lower('10.9' || href) AS cited, count(*) AS n FROM links GROUP BY 1, 2
           UNION ALL SELECT 'skipped', 'no_doi', count(*) FROM pages""",
        extra=LINK_SQL,
    ),
)
def read_crossref_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_counts(references.parse_crossref(_crossref_answers(spark, sf_dir), NOW))


def _edge_counts(out: emission.Emission) -> DataFrame:
    pairs = out.edges.select(F.col("src.value").alias("citing"), F.col("dst.value").alias("cited"))
    skipped = out.skipped.select(F.lit("skipped").alias("citing"), F.col("reason").alias("cited"), F.col("count").alias("n"))
    return pairs.groupBy("citing", "cited").agg(F.count(F.lit(1)).alias("n")).unionByName(skipped)


def _opencitations_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page cites its own address and the first of its links."""
    first = F.regexp_extract("html", 'href="([^"]*)"', 1)
    value = F.concat(F.lit('[{"cited":"10.8/'), _text("page_id"), F.lit('A"},{"cited":"10.9'), first, F.lit('"}]'))
    return fx.table(spark, sf_dir, "pages").select(_text("page_id").alias("citing"), value.alias("value"))


@REG.query(
    "A7_read_opencitations_refs",
    """SELECT '' || page_id AS citing, unnest(['10.8/' || page_id || 'a', lower('10.9' || regexp_extract(html, 'href="([^"]*)"', 1))]) AS cited, CAST(1 AS BIGINT) AS n FROM pages
       UNION ALL SELECT 'skipped', 'no_doi', 0""",
)
def read_opencitations_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_counts(references.parse_opencitations(_opencitations_answers(spark, sf_dir), NOW))


@REG.query(
    "A8_union_references",
    with_views(
        "",
        """SELECT citing, lower('10.9' || href) AS cited, 'crossref+opencitations' AS source FROM links
           UNION SELECT '' || page_id, '10.8/' || page_id || 'a', 'crossref+opencitations' FROM pages
           UNION SELECT '' || page_id, lower('10.9' || regexp_extract(html, 'href="([^"]*)"', 1)), 'crossref+opencitations' FROM pages""",
        extra=LINK_SQL,
    ),
)
def union_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = references.union_references(
        references.crossref_pairs(_crossref_answers(spark, sf_dir)), references.opencitations_pairs(_opencitations_answers(spark, sf_dir)), NOW
    )
    return edges.select(F.col("src.value").alias("citing"), F.col("dst.value").alias("cited"), "source")


@REG.query(
    "A9_read_arxiv",
    r"""SELECT 'd' || doc_id AS arxiv_id, trim(regexp_replace(title, '[\s\pZ]+', ' ', 'g')) AS title, length(trim(text, ' ' || chr(10) || chr(9))) AS abstract_length,
              source AS author, lang AS primary_category, CASE WHEN doc_id % 2 = 0 THEN '10.48550/' || doc_id END AS doi,
              'https://arxiv.org/pdf/d' || doc_id AS pdf_url
       FROM (SELECT *, regexp_replace(split_part(text, '.', 1), '[\s\pZ]', chr(10) || '  ', 'g') AS title FROM documents)""",
)
def read_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Atom entries: the first sentence, spread over lines, is the title, the text the summary."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = fx.table(spark, sf_dir, "documents")
    title = F.regexp_replace(F.substring_index("text", ".", 1), r"(?U)\s", "\n  ")
    doi = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<arxiv:doi> 10.48550/"), _text("doc_id"), F.lit(" </arxiv:doi>"))).otherwise("")
    entry = F.concat(
        F.lit('<entry xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/d'), _text("doc_id"), F.lit("v2</id><title>"), escape(title),
        F.lit("</title><summary>"), escape(F.col("text")), F.lit("</summary><author><name>"), "source",
        F.lit('</name></author><arxiv:primary_category term="'), "lang", F.lit('"/><category term="'), "lang", F.lit('"/><category term="x"/>'), doi,
        F.lit('<link href="http://arxiv.org/abs/d" rel="alternate"/><link title="pdf" href="https://arxiv.org/pdf/d'), _text("doc_id"), F.lit('"/></entry>'),
    )
    feed = docs.select(F.from_xml(entry, arxiv.ENTRY_SCHEMA).alias("e")).select("e.*")
    return arxiv.entries(feed).select(
        "arxiv_id", "title", F.length("abstract").cast("long").alias("abstract_length"), F.get("authors", F.lit(0))["name"].alias("author"),
        "primary_category", "doi", "pdf_url",
    )


@REG.query(
    "A10_manual_records",
    """SELECT 'record' AS outcome, lower(c_mktsegment[1:1]) || '' AS tag, 'isbn' AS scheme, c_custkey || ':' || c_name AS value, CASE c_nationkey % 5 WHEN 0 THEN 'work' WHEN 1 THEN 'author' WHEN 2 THEN 'venue' ELSE 'topic' END AS kind
       FROM customer WHERE c_nationkey % 5 <> 4 AND c_mktsegment <> 'BUILDING'
       UNION ALL SELECT 'reject', lower(c_mktsegment[1:1]), NULL, CASE WHEN c_nationkey % 5 = 4 THEN 'invalid kind ''Person''' ELSE 'invalid alias ''' || c_name || '''' END, NULL
       FROM customer WHERE c_nationkey % 5 = 4 OR c_mktsegment = 'BUILDING'""",
)
def manual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hand entries: one nation in five names no known kind, one segment's alias has no scheme."""
    n = F.col("c_nationkey") % 5
    kind = F.when(n == 0, "WORK").when(n == 1, "Author").when(n == 2, "venue").when(n == 3, "Topic").otherwise("Person")
    alias = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(F.concat(F.lit("isbn:"), _text("c_custkey"), F.lit(":"), "c_name"))
    rows = fx.table(spark, sf_dir, "customer").select(
        F.array(alias).alias("aliases"), F.lower(F.substring("c_mktsegment", 1, 1)).alias("title"), F.array("c_name").alias("authors"),
        F.lit(2000).alias("year"), kind.alias("kind"),
    )
    records, rejects = manual.validate(rows, NOW)
    none = F.lit(None).cast("string")
    good = records.select(
        F.lit("record").alias("outcome"), F.get_json_object("attrs", "$.title").alias("tag"), F.explode("aliases").alias("a"), "kind"
    ).select("outcome", "tag", "a.scheme", "a.value", "kind")
    return good.unionByName(
        rejects.select(F.lit("reject").alias("outcome"), F.col("title").alias("tag"), none.alias("scheme"), F.col("reason").alias("value"), none.alias("kind"))
    )


RAW_ID_SQL = """raw AS (
  SELECT url AS id FROM pages UNION ALL SELECT 'https://doi.org/10.5/' || page_id FROM pages UNION ALL SELECT 'http://dx.doi.org/10.5/X' || page_id FROM pages
  UNION ALL SELECT 'PMID:' || page_id FROM pages UNION ALL SELECT '10.7/' || page_id FROM pages UNION ALL SELECT 'plain' || page_id FROM pages
  UNION ALL SELECT 'https://openalex.org/' || ['W', 'A', 'S', 'I', 'T', 'P', 'F', 'C', 'Z'][CAST(page_id % 9 + 1 AS INTEGER)] || page_id FROM pages
  UNION ALL SELECT ['pmid:', 'orcid:', 'issn:', 'ror:', 'keywords/', 's2:', 's2author:', 'corpusid:', 'ACL:'][CAST(page_id % 9 + 1 AS INTEGER)] || page_id FROM pages
  UNION ALL SELECT md5('' || page_id) || '01234567' FROM pages UNION ALL SELECT 'arxiv:2301.' || page_id || 'v3' FROM pages)"""


def _raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = _text("page_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    forms = F.array(
        F.col("url"), F.concat(F.lit("https://doi.org/10.5/"), id_), F.concat(F.lit("http://dx.doi.org/10.5/X"), id_), F.concat(F.lit("PMID:"), id_),
        F.concat(F.lit("10.7/"), id_), F.concat(F.lit("plain"), id_),
        F.concat(F.lit("https://openalex.org/"), pick(["W", "A", "S", "I", "T", "P", "F", "C", "Z"]), id_),
        F.concat(pick(["pmid:", "orcid:", "issn:", "ror:", "keywords/", "s2:", "s2author:", "corpusid:", "ACL:"]), id_),
        F.concat(F.md5(id_), F.lit("01234567")), F.concat(F.lit("arxiv:2301."), id_, F.lit("v3")),
    )
    return fx.table(spark, sf_dir, "pages").select(F.explode(forms).alias("id"))


@REG.query(
    "A11_parse_aliases",
    with_views(
        "",
        """SELECT id, CASE WHEN regexp_matches(id, '^https?://(dx\\.)?doi\\.org/') THEN 'doi' WHEN id LIKE '%:%' THEN lower(split_part(id, ':', 1))
                      WHEN id LIKE '10.%/%' THEN 'doi' END AS scheme,
                  CASE WHEN regexp_matches(id, '^https?://(dx\\.)?doi\\.org/') THEN regexp_replace(id, '^https?://(dx\\.)?doi\\.org/', '')
                       WHEN id LIKE '%:%' THEN substr(id, instr(id, ':') + 1) WHEN id LIKE '10.%/%' THEN id END AS value FROM raw""",
        extra=RAW_ID_SQL,
    ),
)
def parse_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_ids(spark, sf_dir).withColumn("a", id_columns.parse_alias(F.col("id"))).select("id", "a.scheme", "a.value")


@REG.query(
    "A11_infer_entities",
    with_views(
        "",
        r"""SELECT id,
              CASE WHEN regexp_matches(bare, '^[WASITPFC][0-9]+$') THEN
                     CASE bare[1] WHEN 'W' THEN 'works' WHEN 'A' THEN 'authors' WHEN 'S' THEN 'sources' WHEN 'I' THEN 'institutions' WHEN 'T' THEN 'topics'
                                  WHEN 'P' THEN 'publishers' WHEN 'F' THEN 'funders' ELSE 'concepts' END
                   WHEN regexp_matches(bare, '^(doi:|https://doi\.org/|pmid:|pmcid:|mag:)') THEN 'works' WHEN bare LIKE 'orcid:%' THEN 'authors'
                   WHEN bare LIKE 'issn:%' THEN 'sources' WHEN bare LIKE 'ror:%' THEN 'institutions' WHEN bare LIKE 'keywords/%' THEN 'keywords' END AS openalex,
              CASE WHEN id LIKE 'pmid:%' THEN 'papers PMID:' || substr(id, 6) WHEN id LIKE 'corpusid:%' THEN 'papers CorpusId:' || substr(id, 10)
                   WHEN id LIKE 'arxiv:%' THEN 'papers ARXIV:' || substr(id, 7) WHEN id LIKE 's2:%' THEN 'papers ' || substr(id, 4)
                   WHEN id LIKE 's2author:%' THEN 'authors ' || substr(id, 10) WHEN id LIKE 'ACL:%' OR id LIKE 'PMID:%' THEN 'papers ' || id
                   WHEN regexp_matches(id, '^[0-9a-f]{40}$') THEN 'papers ' || id END AS s2,
              CASE WHEN id LIKE 'arxiv:%' THEN regexp_replace(substr(id, 7), 'v[0-9]+$', '') ELSE regexp_replace(id, 'v[0-9]+$', '') END AS arxiv
            FROM (SELECT id, regexp_replace(id, '^https://openalex\.org/', '') AS bare FROM raw)""",
        extra=RAW_ID_SQL,
    ),
)
def infer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _raw_ids(spark, sf_dir)
    s2 = id_columns.s2_entity(F.col("id"))
    return ids.select(
        "id", id_columns.openalex_entity(F.col("id"))["entity"].alias("openalex"),
        F.when(s2.isNotNull(), F.concat(s2["entity"], F.lit(" "), s2["id"])).alias("s2"), id_columns.arxiv_id(F.col("id")).alias("arxiv"),
    )


@REG.query(
    "A12_curated_works",
    """SELECT 'https://openalex.org/W' || p_partkey AS id, false AS has_secret, false AS has_refs, p_brand AS first_author,
              '{"id":"i","country_code":"XX"}' AS institution, CAST(NULL AS VARCHAR) AS extra FROM part""",
)
def curated_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _of_entity(openalex_lines(spark, sf_dir), "works")
    at = lambda path: F.get_json_object("value", path)
    return openalex.curate(works, "works").select(
        at("$.id").alias("id"), F.contains("value", F.lit("secret")).alias("has_secret"), F.contains("value", F.lit("referenced_works")).alias("has_refs"),
        at("$.authorships[0].author.display_name").alias("first_author"), at("$.authorships[0].institutions[0]").alias("institution"),
        at("$.authorships[0].author.extra").alias("extra"),
    )


@REG.query(
    "A13_reconstruct_abstract",
    r"""SELECT conv_id, turn, nullif(trim(array_to_string(list_transform(w, lambda x: CASE WHEN length(x) = 2 THEN '' ELSE x END), ' ')), '') AS abstract,
               nullif(array_to_string(list_filter(w, lambda x: length(x) <> 2), ' '), '') AS without_gaps
        FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[\s\pZ]+') AS w FROM conversations)""",
)
def reconstruct_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is inverted to word → positions without its two-letter words, and put together again."""
    words = F.split("text", r"(?U)\s+")
    kept = F.array_distinct(F.filter("words", lambda w: F.length(w) != 2))
    places = lambda w: F.filter(F.transform("words", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))
    inverted = turns.withColumn("index", F.map_from_entries(F.transform(kept, lambda w: F.struct(w, places(w)))))
    return inverted.select(
        "conv_id", "turn", openalex.reconstruct_abstract(F.col("index")).alias("abstract"),
        openalex.reconstruct_abstract(F.col("index"), keep_gaps=False).alias("without_gaps"),
    )


@REG.query(
    "A14_open_access_urls",
    """SELECT 'w' || page_id AS canonical_id,
              CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '#oa' WHEN 2 THEN url || '#best' ELSE url || '#unpaywall' END AS url,
              CASE WHEN page_id % 5 < 3 THEN 'openalex' ELSE 'unpaywall' END AS url_source FROM pages WHERE page_id % 5 <> 4""",
)
def open_access_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address stands in another place for each page number modulo five; in the last nowhere."""
    m = F.col("page_id") % 5
    q = lambda suffix: F.concat(F.lit('"'), "url", F.lit(suffix + '"'))
    attrs = (
        F.when(m == 0, F.concat(F.lit('{"primary_location":{"pdf_url":'), q(""), F.lit('},"open_access":{"oa_url":"later"}}')))
        .when(m == 1, F.concat(F.lit('{"primary_location":{"pdf_url":""},"open_access":{"oa_url":'), q("#oa"), F.lit("}}")))
        .when(m == 2, F.concat(F.lit('{"best_oa_location":{"pdf_url":'), q("#best"), F.lit("}}")))
        .otherwise("{}")
    )
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "url", _text("page_id").alias("doi"), attrs.alias("attrs"))
    works = pages.select(F.concat(F.lit("w"), "doi").alias("canonical_id"), "attrs", "doi")
    answer = F.concat(F.lit('{"best_oa_location":{"url_for_pdf":"","url":'), q("#unpaywall"), F.lit("}}"))
    unpaywall = pages.where(m != 4).select("doi", answer.alias("answer"))
    return openalex.to_fetch(works, unpaywall)


@REG.query(
    "A15_work_summary",
    """SELECT 'https://openalex.org/W' || p_partkey AS id, p_name AS title, p_name AS label, p_size + 1980 AS year, p_brand AS authors, p_type AS venue,
              CAST(p_size AS BIGINT) AS cited_by_count FROM part""",
)
def work_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _of_entity(openalex_lines(spark, sf_dir), "works")
    return openalex.summarize(works).withColumn("authors", F.array_join("authors", "; "))
