"""Registered queries for page, folio, outline, chunk and locator jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.operators import pages
from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import with_views
from citegraph.plans.registry import Registry

REG = Registry()


def _form_fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every paragraph break turned into a page break."""
    return fx.page_text(spark, sf_dir).withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\f")))


@REG.query(
    "F1_paginate_form_feed",
    """SELECT doc, CAST(i AS INTEGER) AS page_index, text FROM (
         SELECT doc_id AS doc, unnest(p) AS text, unnest(range(1, len(p) + 1)) AS i, len(p) AS n
         FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(12)), chr(12)) AS p FROM documents))
       WHERE NOT (i = n AND text = '')""",
)
def paginate_form_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paginate(_form_fed(spark, sf_dir))


LINES_SQL = """cells AS (SELECT doc_id AS doc, {text} AS text FROM documents),
lines AS (
  SELECT doc, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n, text
  FROM (SELECT doc, text, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc, text, string_split(text, chr(10)) AS l FROM cells)))"""

CUT_SQL = """SELECT doc, CAST(page_no AS INTEGER) AS page_index,
  string_agg(line, chr(10) ORDER BY i) || CASE WHEN max(i) < max(n) OR any_value(text) LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS text
FROM (SELECT *, 1 + sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS page_no FROM marked) GROUP BY doc, page_no"""

SPACED = "regexp_replace(text, '[!?.]\\n', '.' || chr(10) || chr(10) || chr(10), 'g')"


@REG.query(
    "F2_paginate_blank_lines",
    with_views(
        "", CUT_SQL,
        extra=LINES_SQL.format(text=SPACED) + r""",
runs AS (SELECT *, regexp_matches(line, '\S') AS full_line FROM lines),
seen AS (SELECT *, max(CASE WHEN full_line THEN i END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_full FROM runs),
marked AS (SELECT *, full_line AND last_full IS NOT NULL AND i - last_full - 1 >= 2 AS starts FROM seen WHERE regexp_matches(text, '\S'))""",
    ),
)
def paginate_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = fx.page_text(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[!?.]\n", ".\n\n\n"))
    return pages.paginate(spaced, "blank-lines:2")


@REG.query(
    "F3_paginate_regex",
    with_views(
        "", CUT_SQL,
        extra=LINES_SQL.format(text="text") + r""",
marked AS (SELECT *, i > 1 AND regexp_matches(line, '^[AEIOU]') AS starts FROM lines)""",
    ),
)
def paginate_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paginate(fx.page_text(spark, sf_dir), "regex:^[AEIOU]")


@REG.query(
    "F4_normalize_pages",
    with_views(
        "",
        """SELECT doc, string_agg(line || chr(10), '' ORDER BY i) AS text FROM (
             SELECT *, row_number() OVER (PARTITION BY doc, island, blank ORDER BY i) AS run FROM (
               SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS island FROM (
                 SELECT doc, i, rtrim(line, ' ' || chr(9) || chr(13)) AS line, rtrim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM lines)))
           WHERE NOT blank OR run <= 2 GROUP BY doc""",
        extra=LINES_SQL.format(text=r"regexp_replace(replace(text, '. ', '.  ' || chr(10)), '[!?.]\n', '. ' || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || chr(10), 'g')"),
    ),
)
def normalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ragged = F.regexp_replace(F.replace("text", F.lit(". "), F.lit(".  \n")), "[!?.]\n", ". \n \n\n\n\n")
    return pages.normalize_pages(fx.page_text(spark, sf_dir).withColumn("text", ragged))


@REG.query(
    "F5_pages_without_text",
    r"""SELECT doc, count(*) AS pages, count(*) FILTER (WHERE length(regexp_replace(text, '[\s\pZ]', '', 'g')) < 5) AS without_text,
               CASE WHEN count(*) FILTER (WHERE length(regexp_replace(text, '[\s\pZ]', '', 'g')) < 5) > 0 THEN 'refused' ELSE 'accepted' END AS status
        FROM (SELECT doc_id AS doc, unnest(string_split(text, ' ')) AS text FROM documents) GROUP BY doc""",
)
def text_layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand for pages, so that many have too few characters."""
    words = fx.page_text(spark, sf_dir).select("doc", F.posexplode(F.split("text", " ")).alias("page_index", "text"))
    return pages.text_layer_gate(words)


FOLIO_SQL = r"""ends AS (
  SELECT doc, page_index, CASE WHEN len(l) > 1 THEN [l[1], l[-1]] ELSE l END AS l FROM (
    SELECT doc, page_index, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM page_table)),
tokens AS (
  SELECT doc, page_index, a, unnest(t) AS raw, unnest(range(len(t))) AS b FROM (
    SELECT doc, page_index, a, regexp_split_to_array(line, '[\s\pZ]+') AS t FROM (
      SELECT doc, page_index, unnest(l) AS line, unnest(range(len(l))) AS a FROM ends))),
bare AS (SELECT doc, page_index, a, b, regexp_replace(regexp_replace(raw, '^[^\pL\pN]+', ''), '[^\pL\pN]+$', '') AS tok FROM tokens),
letters AS (
  SELECT tok, i, v, CASE WHEN v < lead(v) OVER (PARTITION BY tok ORDER BY i) THEN -v ELSE v END AS s FROM (
    SELECT tok, i, CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END AS v
    FROM (SELECT tok, unnest(string_split(tok, '')) AS c, unnest(range(length(tok))) AS i
          FROM (SELECT DISTINCT tok FROM bare WHERE regexp_matches(tok, '^[ivxlcdm]+$'))))),
romans AS (SELECT tok, CAST(sum(s) AS BIGINT) AS n FROM (
  SELECT *, sum(s) OVER (PARTITION BY tok ORDER BY i) AS run FROM letters) GROUP BY tok HAVING min(run) >= 0 AND sum(s) > 0),
cands AS (
  SELECT doc, page_index, a, b, tok, 'arabic' AS kind, CAST(tok AS BIGINT) AS n FROM bare WHERE regexp_matches(tok, '^[0-9]+$') AND length(tok) <= 18
  UNION ALL SELECT doc, page_index, a, b, tok, 'roman', n FROM bare JOIN romans USING (tok)),
votes AS (SELECT doc, kind, n - (page_index - 1) AS off, count(DISTINCT page_index) AS c FROM cands GROUP BY 1, 2, 3),
best AS (SELECT doc, kind, off FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY c DESC, off) AS rn FROM votes WHERE c >= 2) WHERE rn = 1),
hits AS (SELECT c.doc, c.page_index, arg_min(c.tok, c.a * 1000000 + c.b) AS folio FROM cands c
         JOIN best b ON b.doc = c.doc AND b.kind = c.kind AND b.off = c.n - (c.page_index - 1) GROUP BY 1, 2),
folios AS (SELECT p.doc, p.page_index, p.text, h.folio FROM page_table p LEFT JOIN hits h USING (doc, page_index))"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.detect_folios(fx.page_table(spark, sf_dir))


@REG.query("F6_detect_folios", with_views("page_table", "SELECT doc, page_index, folio FROM folios", extra=FOLIO_SQL))
def detect_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("doc", "page_index", "folio")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pages start a roman series, fourth pages an arabic one; sixth pages carry a folio that is no numeral."""
    turn = F.col("page_index")
    folio = (
        F.when(turn == 2, "xii").when(turn == 4, (F.col("doc") % 90 + 10).cast("string")).when(turn == 6, "p. 6")
    )
    return fx.page_table(spark, sf_dir).select("doc", "page_index", folio.alias("folio")).where(F.col("folio").isNotNull())


@REG.query(
    "F7_anchor_folios",
    with_views(
        "page_table",
        """SELECT doc, page_index, CASE WHEN page_index >= 4 THEN CAST(doc % 90 + 10 + page_index - 4 AS VARCHAR)
                  WHEN page_index = 3 THEN 'xiii' WHEN page_index = 2 THEN 'xii' END AS folio FROM page_table""",
    ),
)
def anchor_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.anchor_folios(fx.page_table(spark, sf_dir), _anchors(spark, sf_dir))
    return out.select("doc", "page_index", "folio")


RUN_SQL = """typed AS (
  SELECT f.doc, f.page_index, f.folio, CASE WHEN regexp_matches(folio, '^[0-9]+$') THEN 'arabic' WHEN folio IS NOT NULL THEN 'roman' END AS kind,
         CASE WHEN regexp_matches(folio, '^[0-9]+$') THEN CAST(folio AS BIGINT) ELSE r.n END AS n
  FROM folios f LEFT JOIN romans r ON r.tok = f.folio),
marked AS (
  SELECT *, CASE WHEN lag(page_index) OVER w = page_index - 1 AND lag(kind) OVER w = kind AND lag(n) OVER w + 1 = n THEN 0 ELSE 1 END AS begins
  FROM typed WINDOW w AS (PARTITION BY doc ORDER BY page_index)),
runs AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 0 ELSE begins END) OVER (PARTITION BY doc ORDER BY page_index) AS run FROM marked)"""


@REG.query(
    "F8_folio_runs",
    with_views(
        "page_table",
        """SELECT doc, min(page_index) AS first_page, max(page_index) AS last_page, arg_min(folio, page_index) AS first_folio,
                  arg_max(folio, page_index) AS last_folio FROM runs WHERE kind IS NOT NULL GROUP BY doc, run""",
        extra=FOLIO_SQL + "," + RUN_SQL,
    ),
)
def folio_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.folio_runs(_detected(spark, sf_dir))


@REG.query(
    "F9_folio_breaks",
    with_views(
        "page_table",
        """SELECT doc, 'gap' AS kind, min(page_index) AS first_page, max(page_index) AS last_page, NULL AS folio FROM (
             SELECT *, sum(CASE WHEN state = 'gap' THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page_index) AS island FROM states)
           WHERE state = 'gap' GROUP BY doc, island
           UNION ALL SELECT doc, 'contradiction', page_index, page_index, cand FROM states WHERE state = 'contradiction'""",
        extra=FOLIO_SQL + """,
states AS (
  SELECT f.doc, f.page_index, c.cand, CASE WHEN f.folio IS NOT NULL THEN 'folio' WHEN c.cand IS NOT NULL THEN 'contradiction' ELSE 'gap' END AS state
  FROM folios f LEFT JOIN (SELECT doc, page_index, arg_min(tok, a * 1000000 + b) AS cand FROM cands GROUP BY 1, 2) c USING (doc, page_index))""",
    ),
)
def folio_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.folio_breaks(_detected(spark, sf_dir))


@REG.query(
    "F10_folio_method",
    with_views(
        "page_table",
        """SELECT doc, CASE WHEN max(page_index) >= 8 THEN 'anchored' WHEN count(folio) > 0 THEN 'detected' ELSE 'none' END AS method,
                  max(page_index) >= 8 OR count(folio) > 0 AS accepted FROM folios GROUP BY doc""",
        extra=FOLIO_SQL,
    ),
)
def folio_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of eight pages or more come with an anchor."""
    anchors = fx.page_table(spark, sf_dir).where("page_index = 8").select("doc", "page_index", F.lit("8").alias("folio"))
    return pages.folio_method(_detected(spark, sf_dir), anchors)


def _word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paginate(fx.page_text(spark, sf_dir), "regex:^[AEIOU]")


CHUNK_SQL = LINES_SQL.format(text="text") + r""",
marked AS (SELECT *, i > 1 AND regexp_matches(line, '^[AEIOU]') AS starts FROM lines),
paged AS (SELECT doc, i, line, 1 + sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS page FROM marked),
words AS (
  SELECT doc, i, page, unnest(w) AS word, unnest(range(len(w))) AS j FROM (
    SELECT doc, i, page, list_filter(regexp_split_to_array(line, '[\s\pZ]+'), lambda x: x <> '') AS w FROM paged)),
toks AS (SELECT doc, page, word, row_number() OVER (PARTITION BY doc ORDER BY i, j) - 1 AS t, count(*) OVER (PARTITION BY doc) AS total FROM words),
chunks AS (
  SELECT doc, s.seq, string_agg(word, ' ' ORDER BY t) AS text, CAST(min(page) AS INTEGER) AS page_start, CAST(max(page) AS INTEGER) AS page_end,
         CAST(count(*) AS INTEGER) AS token_count
  FROM toks JOIN (SELECT unnest(range(0, 2000)) AS seq) s
    ON t >= s.seq * 56 AND t < s.seq * 56 + 64 AND s.seq BETWEEN t // 56 - 1 AND t // 56
  WHERE s.seq = 0 OR (s.seq - 1) * 56 + 64 < total GROUP BY doc, s.seq)"""


@REG.query(
    "F11_chunk_pages",
    with_views("", "SELECT doc, seq, text, page_start, page_end, token_count FROM chunks", extra=CHUNK_SQL),
)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunk_pages(_word_pages(spark, sf_dir), 64, 8)


@REG.query(
    "F12_chunks_for_pages",
    with_views(
        "",
        """SELECT r.request_id, r.doc, c.seq, c.page_start, c.page_end FROM requests r
           JOIN chunks c ON c.doc = r.doc AND c.page_end >= r.first_page AND c.page_start <= r.last_page""",
        extra=CHUNK_SQL + """,
requests AS (SELECT doc_id AS request_id, doc_id AS doc, 2 AS first_page, 2 + doc_id % 100 AS last_page FROM documents)""",
    ),
)
def chunks_for_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("doc_id").alias("doc"), F.lit(2).alias("first_page"),
        (F.col("doc_id") % 100 + 2).alias("last_page"),
    )
    chunks = pages.chunk_pages(_word_pages(spark, sf_dir), 64, 8)
    return pages.chunks_for_pages(chunks, requests).select("request_id", "doc", "seq", "page_start", "page_end")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_table(spark, sf_dir).groupBy("doc").agg(F.max("page_index").alias("page_count"))


@REG.query(
    "F13_outline_errors",
    with_views(
        "page_table outline",
        """SELECT doc, 'duplicate_id' AS error, id, NULL AS other, start_page_index AS start, end_page_index AS "end" FROM numbered WHERE nth > 1
           UNION ALL SELECT doc, 'invalid_range', id, NULL, start_page_index, end_page_index FROM numbered WHERE start_page_index > end_page_index
           UNION ALL SELECT doc, 'out_of_bounds', id, NULL, start_page_index, end_page_index FROM numbered JOIN counts USING (doc) WHERE end_page_index > page_count
           UNION ALL SELECT doc, 'overlap', id, pid, start_page_index, end_page_index FROM placed
             WHERE ps <= pe AND start_page_index <= end_page_index AND start_page_index <= pe""",
        extra="""numbered AS (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY ord) AS nth FROM outline),
counts AS (SELECT doc, max(page_index) AS page_count FROM page_table GROUP BY doc),
placed AS (SELECT *, lag(id) OVER w AS pid, lag(start_page_index) OVER w AS ps, lag(end_page_index) OVER w AS pe
           FROM outline WINDOW w AS (PARTITION BY doc ORDER BY start_page_index, ord))""",
    ),
)
def outline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.outline_errors(fx.outline(spark, sf_dir), _counts(spark, sf_dir))


REQUEST_SQL = """asked AS (
  SELECT conv_id * 100 + turn AS request_id, conv_id AS doc, CAST(turn + conv_id + 2 AS VARCHAR) AS start, CAST(conv_id + 1 AS VARCHAR) AS "end" FROM conversations)"""


def _printed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return fx.table(spark, sf_dir, "conversations").select(
        (c * 100 + t).alias("request_id"), c.alias("doc"), (t + c + 2).cast("string").alias("start"), (c + 1).cast("string").alias("end")
    )


@REG.query(
    "F14_locate_printed",
    with_views(
        "page_table",
        """SELECT r.request_id, r.doc, CASE WHEN a.page IS NULL OR b.page IS NULL THEN 'folio_not_found' ELSE 'found' END AS status,
                  CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN least(a.page, b.page) END AS first_page,
                  CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN greatest(a.page, b.page) END AS last_page
           FROM asked r LEFT JOIN bearing a ON a.doc = r.doc AND a.folio = r.start LEFT JOIN bearing b ON b.doc = r.doc AND b.folio = r."end" """,
        extra=FOLIO_SQL + "," + REQUEST_SQL + """,
bearing AS (SELECT doc, folio, min(page_index) AS page FROM folios WHERE folio IS NOT NULL GROUP BY 1, 2)""",
    ),
)
def locate_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.locate_printed(_printed_requests(spark, sf_dir), _detected(spark, sf_dir))


def _page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return fx.table(spark, sf_dir, "conversations").select(
        (c * 100 + t).alias("request_id"), c.alias("doc"), (t + 1).alias("start"), (t * 2).alias("end")
    )


ARTIFACT_PAGES_SQL = """spans AS (
  SELECT conv_id * 100 + turn AS request_id, conv_id AS doc,
         CASE WHEN turn * 2 BETWEEN 1 AND n THEN 'found' ELSE 'out_of_range' END AS status,
         CASE WHEN turn * 2 BETWEEN 1 AND n THEN least(turn + 1, turn * 2) END AS first_page,
         CASE WHEN turn * 2 BETWEEN 1 AND n THEN greatest(turn + 1, turn * 2) END AS last_page
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 AS n FROM conversations))"""


@REG.query("F15_locate_artifact_pages", with_views("", "SELECT request_id, doc, status, first_page, last_page FROM spans", extra=ARTIFACT_PAGES_SQL))
def locate_artifact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.locate_artifact_pages(_page_requests(spark, sf_dir), _counts(spark, sf_dir))


@REG.query(
    "F15_read_span",
    with_views(
        "page_table",
        "SELECT s.request_id, s.doc, p.page_index, p.text FROM spans s JOIN page_table p ON p.doc = s.doc AND p.page_index BETWEEN s.first_page AND s.last_page",
        extra=ARTIFACT_PAGES_SQL,
    ),
)
def read_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pages.locate_artifact_pages(_page_requests(spark, sf_dir), _counts(spark, sf_dir))
    return pages.read_span(spans, fx.page_table(spark, sf_dir))


@REG.query(
    "F16_locate_section",
    with_views(
        "page_table outline",
        """SELECT request_id, doc, CASE WHEN s IS NULL THEN 'section_not_found' WHEN len(list_filter(span, lambda p: p > page_count)) > 0 THEN 'partial' ELSE 'found' END AS status,
                  CAST(list_min(list_filter(span, lambda p: p <= page_count)) AS INTEGER) AS first_page,
                  CAST(list_max(list_filter(span, lambda p: p <= page_count)) AS INTEGER) AS last_page,
                  CAST(list_min(list_filter(span, lambda p: p > page_count)) AS INTEGER) AS missing_from,
                  CAST(list_max(list_filter(span, lambda p: p > page_count)) AS INTEGER) AS missing_to
           FROM (SELECT *, CASE WHEN s IS NOT NULL THEN CASE WHEN head IS NOT NULL THEN range(s, least(e, s + head - 1) + 1)
                        WHEN tail IS NOT NULL THEN range(greatest(s, e - tail + 1), e + 1) ELSE range(s, e + 1) END END AS span
                 FROM (SELECT r.*, f.s, f.e, c.page_count FROM requests r LEFT JOIN firsts f ON f.doc = r.doc AND f.id = r.id LEFT JOIN counts c ON c.doc = r.doc))""",
        extra="""counts AS (SELECT doc, max(page_index) AS page_count FROM page_table GROUP BY doc),
firsts AS (SELECT doc, id, arg_min(start_page_index, ord) AS s, arg_min(end_page_index, ord) AS e FROM outline GROUP BY 1, 2),
kinds AS (SELECT unnest(['intro', 'body', 'body', 'notes', 'index']) AS id, unnest([NULL, 2, NULL, NULL, NULL]) AS head,
                 unnest([NULL, NULL, 1, NULL, NULL]) AS tail, unnest(range(5)) AS k),
requests AS (SELECT counts.doc * 10 + k AS request_id, counts.doc, id, head, tail FROM counts, kinds)""",
    ),
)
def locate_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("intro", None, None), ("body", 2, None), ("body", None, 1), ("notes", None, None), ("index", None, None)]
    ask = lambda k, id, head, tail: F.struct(
        F.lit(k).alias("k"), F.lit(id).alias("id"), F.lit(head).cast("int").alias("head"), F.lit(tail).cast("int").alias("tail")
    )
    counts = _counts(spark, sf_dir)
    requests = counts.select("doc", F.explode(F.array(*[ask(k, *kind) for k, kind in enumerate(kinds)])).alias("r")).select(
        (F.col("doc") * 10 + F.col("r.k")).alias("request_id"), "doc", "r.id", "r.head", "r.tail"
    )
    return pages.locate_sections(requests, fx.outline(spark, sf_dir), counts)


@REG.query(
    "F17_locate_quote",
    with_views(
        "page_table",
        """SELECT request_id, doc, CASE WHEN needle = '' THEN 'empty_quote' WHEN page_index IS NULL THEN 'quote_not_found' ELSE 'found' END AS status, page_index
           FROM (SELECT DISTINCT r.request_id, r.doc, r.needle, p.page_index FROM requests r
                 LEFT JOIN page_table p ON r.doc = p.doc AND r.needle <> '' AND contains(p.text, r.needle))""",
        extra="""requests AS (
  SELECT turn AS request_id, conv_id AS doc, regexp_extract(text, '^\\S+ \\S+') AS needle FROM conversations
  UNION ALL SELECT 100000 + turn, conv_id, CASE WHEN turn % 2 = 0 THEN 'q' ELSE 'no such words' END FROM conversations)""",
    ),
)
def locate_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every turn are looked for on all pages of its conversation, and so are a letter and words that are nowhere."""
    turns = fx.table(spark, sf_dir, "conversations")
    asked = turns.select(F.col("turn").alias("request_id"), F.col("conv_id").alias("doc"), F.regexp_extract("text", r"^\S+ \S+", 0).alias("needle"))
    other = turns.select(
        (F.col("turn") + 100000).alias("request_id"), F.col("conv_id").alias("doc"), F.when(F.col("turn") % 2 == 0, "q").otherwise("no such words").alias("needle")
    )
    return pages.locate_quotes(asked.unionByName(other), fx.page_table(spark, sf_dir))
