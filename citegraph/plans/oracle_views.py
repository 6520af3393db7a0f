"""The fixture views of `fixtures.py` as DuckDB SQL, and a helper that prefixes a query with them."""

from __future__ import annotations

ISO_SECONDS = "'%Y-%m-%dT%H:%M:%SZ'"
ISO_MICROS = "'%Y-%m-%dT%H:%M:%S.%fZ'"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "edge_in": (
        (),
        f"""
        SELECT 'o' || l_orderkey AS src_id, 'p' || l_partkey AS dst_id, 'contains' AS relation,
               l_returnflag AS source, strftime(l_shipdate, {ISO_SECONDS}) AS fetched_at,
               '{{"qty":' || CAST(l_quantity AS BIGINT) || '}}' AS attrs,
               l_linenumber AS s1, l_shipdate AS s2, l_quantity AS s3, l_orderkey AS s4
        FROM lineitem
        UNION ALL
        SELECT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by', l_returnflag,
               strftime(l_shipdate, {ISO_SECONDS}), '{{"qty":' || CAST(l_quantity AS BIGINT) || '}}',
               l_linenumber, l_shipdate, l_quantity, l_orderkey
        FROM lineitem""",
    ),
    "edge_assertion": (
        ("edge_in",),
        """
        SELECT src_id, dst_id, relation, source, fetched_at, attrs FROM (
          SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, relation, source
                                       ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC) AS rn
          FROM edge_in) WHERE rn = 1""",
    ),
    "edge": (("edge_in",), "SELECT DISTINCT src_id, dst_id, relation FROM edge_in"),
    "redirects": (
        (),
        """
        SELECT 'd' || doc_id AS canonical_id,
               'd' || CASE WHEN doc_id <> near THEN near WHEN doc_id <> same THEN same
                           WHEN doc_id <> size THEN size END AS merged_into
        FROM (SELECT doc_id,
                     min(doc_id) OVER (PARTITION BY text, source) AS near,
                     min(doc_id) OVER (PARTITION BY text) AS same,
                     min(doc_id) OVER (PARTITION BY n_chars, lang) AS size
              FROM documents)""",
    ),
    "nodes": (
        ("redirects",),
        """
        SELECT 'p' || p_partkey AS canonical_id, 'work' AS kind, CAST(NULL AS VARCHAR) AS merged_into FROM part
        UNION ALL SELECT 's' || s_suppkey, 'author', NULL FROM supplier
        UNION ALL SELECT 'c' || c_custkey, 'venue', NULL FROM customer
        UNION ALL SELECT 'o' || o_orderkey, 'topic', NULL FROM orders
        UNION ALL SELECT canonical_id, 'work', merged_into FROM redirects""",
    ),
    "assertion_in": (
        (),
        f"""
        SELECT 'u' || user_id AS canonical_id, event_type AS source, event_id AS seq,
               json_extract_string(props, '$.k') AS k, event_type, event_id,
               strftime(ts, {ISO_MICROS}) AS fetched_at
        FROM events""",
    ),
    "aliases": (
        (),
        """
        SELECT 'mpn' AS scheme, CAST(p_partkey AS VARCHAR) AS value, 'p' || p_partkey AS canonical_id FROM part
        UNION ALL SELECT 'doi', p_name || '/' || p_brand, 'p' || min(p_partkey) FROM part GROUP BY p_name, p_brand
        UNION ALL SELECT 'openalex', s_name, 's' || s_suppkey FROM supplier
        UNION ALL SELECT 'openalex', 'O' || o_orderkey, 'o' || o_orderkey FROM orders
        UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), 'd' || doc_id FROM documents""",
    ),
    "artifact_in": (
        (),
        """
        SELECT source AS canonical_id, lang AS role, n_chars AS byte_size, sha256(text) AS content_hash, doc_id AS seq
        FROM documents""",
    ),
    "page_table": (
        (),
        r"""
        SELECT conv_id AS doc, CAST(turn + 1 AS INTEGER) AS page_index,
               text || CASE WHEN (turn + 1) % 5 = 0 THEN ''
                            WHEN (turn + 1) % 7 = 0 THEN chr(10) || (turn + 1) * 3
                            ELSE chr(10) || (turn + 1 + conv_id) END AS text
        FROM conversations""",
    ),
    "outline": (
        (),
        """
        SELECT conv_id AS doc, s.ord AS ord, s.id AS id, CAST(s.a AS INTEGER) AS start_page_index, CAST(s.b AS INTEGER) AS end_page_index
        FROM (SELECT conv_id, unnest([
                {'ord': 1, 'id': 'intro', 'a': 1, 'b': 1}, {'ord': 2, 'id': 'body', 'a': 2, 'b': n},
                {'ord': 3, 'id': CASE WHEN conv_id % 3 = 0 THEN 'body' ELSE 'notes' END, 'a': n - 1, 'b': n},
                {'ord': 4, 'id': 'index', 'a': n + 1, 'b': n + 1 - conv_id % 4}]) AS s
              FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id))""",
    ),
}


def with_views(names: str, body: str, *, extra: str = "", recursive: bool = False) -> str:
    """`WITH` the named views (and what they need) plus `extra` CTEs, then `body`."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body
