"""The driver's tables seen as catalog, page and notes tables.

Every view is a narrow projection or a partially aggregated group of a whole
table: no sampling, no row caps. `SQL` states the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.session import cut_lineage

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, its narrow rows dealt over all cores by the first before they are made wide: it may lie in one row group, which is one task.

    They are written: filters on what is made of them would otherwise be pushed below the exchange, and the making with them.
    """
    return cut_lineage(table(spark, sf_dir, name).select(*columns).repartition(columns[0]))


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edge_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge claims: order -contains-> part and part -supplied_by-> supplier, one provider per return flag."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    claim = [
        F.col("l_returnflag").alias("source"),
        F.date_format("l_shipdate", ISO_SECONDS).alias("fetched_at"),
        F.concat(F.lit('{"qty":'), F.col("l_quantity").cast("long"), F.lit("}")).alias("attrs"),
        F.struct("l_linenumber", "l_shipdate", "l_quantity", "l_orderkey").alias("seq"),
    ]
    contains = lines.select(
        _id("o", "l_orderkey").alias("src_id"), _id("p", "l_partkey").alias("dst_id"),
        F.lit("contains").alias("relation"), *claim,
    )
    supplied = lines.select(
        _id("p", "l_partkey").alias("src_id"), _id("s", "l_suppkey").alias("dst_id"),
        F.lit("supplied_by").alias("relation"), *claim,
    )
    return contains.unionByName(supplied)


def document_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical_id, merged_into): a document forwards to the first with its text and source,
    that one to the first with its text, that one to the first of its length and language."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("text_key")
    )
    near, same, size = ["text_key", "source"], ["text_key"], ["n_chars", "lang"]
    out = docs
    for name, keys in (("near", near), ("same", same), ("size", size)):
        out = out.join(docs.groupBy(*keys).agg(F.min("doc_id").alias(name)), keys)
    target = (
        F.when(F.col("doc_id") != F.col("near"), F.col("near"))
        .when(F.col("doc_id") != F.col("same"), F.col("same"))
        .when(F.col("doc_id") != F.col("size"), F.col("size"))
    )
    return out.select(
        _id("d", "doc_id").alias("canonical_id"),
        F.concat(F.lit("d"), target.cast("string")).alias("merged_into"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical_id, kind, merged_into) over parts, suppliers, customers, orders and documents."""

    def plain(name: str, prefix: str, key: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            _id(prefix, key).alias("canonical_id"), F.lit(kind).alias("kind"),
            F.lit(None).cast("string").alias("merged_into"),
        )

    docs = document_redirects(spark, sf_dir).select("canonical_id", F.lit("work").alias("kind"), "merged_into")
    return (
        plain("part", "p", "p_partkey", "work")
        .unionByName(plain("supplier", "s", "s_suppkey", "author"))
        .unionByName(plain("customer", "c", "c_custkey", "venue"))
        .unionByName(plain("orders", "o", "o_orderkey", "topic"))
        .unionByName(docs)
    )


def assertion_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider claims about users, one provider per event type, with a field of its own each."""
    events = table(spark, sf_dir, "events")
    attrs = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"event":"'), F.col("event_type"),
        F.lit('","'), F.col("event_type"), F.lit('_id":'), F.col("event_id"), F.lit("}"),
    )
    return events.select(
        _id("u", "user_id").alias("canonical_id"), F.col("event_type").alias("source"), attrs.alias("attrs"),
        F.date_format("ts", ISO_MICROS).alias("fetched_at"), F.col("event_id").alias("seq"),
    )


def work_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers per part: `alpha` states title, year and authorships; `beta` display_name and authors."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    alpha = parts.select(
        _id("p", "p_partkey").alias("canonical_id"), F.lit("alpha").alias("source"),
        F.concat(
            F.lit('{"title":"'), "p_name", F.lit('","publication_year":'), F.col("p_size") + 1980,
            F.lit(',"authorships":[{"author":{"display_name":"'), "p_brand", F.lit('"}}]}'),
        ).alias("attrs"),
        F.lit("2024-01-01T00:00:00Z").alias("fetched_at"),
    )
    beta = parts.select(
        _id("p", "p_partkey").alias("canonical_id"), F.lit("beta").alias("source"),
        F.concat(
            F.lit('{"display_name":"'), F.upper("p_name"), F.lit('","authors":[{"name":"Maker '),
            F.col("p_size").cast("string"), F.lit('"},"'), F.lower("p_type"), F.lit('"]}'),
        ).alias("attrs"),
        F.lit("2024-06-01T00:00:00Z").alias("fetched_at"),
    )
    return alpha.unionByName(beta)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scheme, value, canonical_id): every part has an `mpn`, its name and brand give a `sku` to the
    first part that bears them, suppliers and orders carry `openalex`-like ids; customers have none."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    own = parts.select(
        F.lit("mpn").alias("scheme"), F.col("p_partkey").cast("string").alias("value"),
        _id("p", "p_partkey").alias("canonical_id"),
    )
    sku = (
        parts.groupBy(F.concat_ws("/", "p_name", "p_brand").alias("value"))
        .agg(F.min("p_partkey").alias("first"))
        .select(F.lit("doi").alias("scheme"), "value", _id("p", "first").alias("canonical_id"))
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("openalex").alias("scheme"), F.col("s_name").alias("value"), _id("s", "s_suppkey").alias("canonical_id")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.lit("openalex").alias("scheme"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("value"),
        _id("o", "o_orderkey").alias("canonical_id"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("scheme"), F.col("doc_id").cast("string").alias("value"), _id("d", "doc_id").alias("canonical_id")
    )
    return own.unionByName(sku).unionByName(suppliers).unionByName(orders).unionByName(docs)


def records(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    """(record_id, seq, scheme, value) long form: a document's id and text digest, and with `lines`
    also the digest of each line of 40 or more characters (these weld many documents together)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    long = docs.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit("doc").alias("scheme"), F.col("doc_id").cast("string").alias("value")),
                F.struct(F.lit("sha").alias("scheme"), F.sha2("text", 256).alias("value")),
            )
        ).alias("a"),
    ).select("doc_id", "a.scheme", "a.value")
    if lines:
        by_line = (
            docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
            .where(F.length("line") >= 40)
            .select("doc_id", F.lit("line").alias("scheme"), F.sha2("line", 256).alias("value"))
        )
        long = long.unionByName(by_line)
    return long.select(_id("d", "doc_id").alias("record_id"), F.col("doc_id").alias("seq"), "scheme", "value")


def artifact_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving artifacts: work = document source, role = language, ordered by document id."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("canonical_id"), F.col("lang").alias("role"), F.col("n_chars").alias("byte_size"),
        F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seq"),
    )


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page_index, text): a turn is a page; its last line is a folio, missing on every fifth page
    and off the series on every seventh."""
    page = F.col("turn") + 1
    folio = (
        F.when(page % 5 == 0, F.lit(""))
        .when(page % 7 == 0, F.concat(F.lit("\n"), (page * 3).cast("string")))
        .otherwise(F.concat(F.lit("\n"), (page + F.col("conv_id")).cast("string")))
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), page.cast("int").alias("page_index"), F.concat("text", folio).alias("text")
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): raw documents with a line-structured layout for the page splitters."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sections per conversation; some run past the end, overlap, are inverted or share an id."""
    spans = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    section = lambda ord, i, start, end: F.struct(
        F.lit(ord).alias("ord"), i.alias("id"), start.cast("int").alias("start_page_index"), end.cast("int").alias("end_page_index")
    )
    n, c = F.col("n"), F.col("conv_id")
    rows = F.array(
        section(1, F.lit("intro"), F.lit(1), F.lit(1)),
        section(2, F.lit("body"), F.lit(2), n),
        section(3, F.when(c % 3 == 0, F.lit("body")).otherwise(F.lit("notes")), n - 1, n),
        section(4, F.lit("index"), n + 1, n + 1 - (c % 4)),
    )
    return spans.select(F.col("conv_id").alias("doc"), F.explode(rows).alias("s")).select("doc", "s.*")


TURNS_PER_NOTE = 200
LEFT_OUT_LENGTHS = (100, 150)


def _note_slug() -> Column:
    part = F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part").cast("string"))).otherwise("")
    return F.concat(F.lit("note-"), F.col("home").cast("string"), part)


def note_files(spark: SparkSession, sf_dir: str, side: str = "a") -> DataFrame:
    """(slug, text): Markdown notes with one heading per turn, `TURNS_PER_NOTE` turns of a conversation each.

    Side `b` is the same collection edited: some turns rewritten or added to, short ones left out,
    some moved to another note, and all headers changed.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c, t = F.col("conv_id"), F.col("turn")
    anchor = F.concat(F.lit("r-"), c.cast("string"), F.lit("x"), t.cast("string"))
    title = F.substring_index("text", "\n", 1)
    heading = F.concat(
        F.lit("## "), F.regexp_replace(title, r"[\^\[\]]", ""),
        F.when((c + t) % 11 == 3, F.lit(""))
        .when((c + t) % 13 == 5, F.concat(F.lit(" ^t-"), c.cast("string"), F.lit("-"), t.cast("string")))
        .otherwise(F.concat(F.lit(" ^"), anchor)),
    )
    remark = F.concat(F.lit("- remark: "), F.length("text").cast("string"), F.lit(" characters\n  in "), "role")
    catalog = F.concat(F.lit("- catalog [[part:"), c.cast("string"), F.lit("]] {why: 'turn, "), t.cast("string"), F.lit("'}"))
    follows = F.when(
        t > 0, F.concat(F.lit("- follows [[^r-"), c.cast("string"), F.lit("x"), (t - 1).cast("string"), F.lit("]]"))
    ).otherwise(
        F.concat(
            F.lit("- reading: {role: "),
            F.when(c % 3 == 0, F.lit("core")).when(c % 3 == 1, F.lit("start-here")).otherwise(F.lit("extra")),
            F.lit(", why: first}\n- siblings [[note-"), (c + 1).cast("string"), F.lit("]]"),
        )
    )
    broken = F.when((c + t) % 9 == 4, F.lit("\n- broken: {no colon}\n- [[dangling")).otherwise(F.lit(""))
    tags = F.concat(F.lit("- tags: #"), "role", F.lit(" #turn"))
    if side == "b":
        remark = F.when((c + t) % 8 == 1, F.concat(remark, F.lit("\n- added: on b"))).otherwise(remark)
        tags = F.when((c + t) % 8 == 2, F.lit("- tags: #edited")).otherwise(tags)
    body = F.concat_ws("\n", heading, tags, remark, catalog, F.concat(follows, broken), F.lit(""))
    home = c
    kept = turns
    if side == "b":
        kept = turns.where(~F.length("text").between(*LEFT_OUT_LENGTHS))
        home = F.when((c + t) % 8 == 4, c + 1).otherwise(c)
    meta = F.concat(
        F.lit("---\ndoc: "), _note_slug(),
        F.lit("\nschema: " + ("research" if side == "a" else "revised")),
        F.when(F.col("home") % 6 == 5, F.lit("\ndomain: old")).otherwise(F.lit("")),
        F.lit("\n---\n\n# Note "), F.col("home").cast("string"), F.lit("\n\n"),
    )
    # A note is one file, so its turns are gathered into one cell as the file would hold them; a long
    # conversation is split over several notes, so no cell grows with it.
    part = F.floor(t / TURNS_PER_NOTE)
    gathered = kept.select(home.alias("home"), part.alias("part"), "conv_id", "turn", body.alias("body")).groupBy("home", "part").agg(
        F.array_sort(F.collect_list(F.struct("conv_id", "turn", "body"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["body"]), "\n")
    head = F.when(F.col("home") % 10 == 9, F.lit("# No header\n\n")).otherwise(meta)
    return gathered.select(_note_slug().alias("slug"), F.concat(head, joined).alias("text"))
