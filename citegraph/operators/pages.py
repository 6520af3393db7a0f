"""Page tables derived from document text: pages, folios, outlines, chunks, locators.

A page table is (doc, page_index from 1, text, …) with page_index dense per document. A
document may hold any share of the pages: ordered logic runs in blocks (`functions.scans`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions import page_text
from citegraph.functions.columns import char_runs
from citegraph.functions.folios import candidates, folio_kind, render_folio
from citegraph.functions.intervals import overlap_join
from citegraph.functions.ranking import order_rows
from citegraph.functions.scans import carry_last, previous_row, running_sum
from citegraph.session import broadcast_if_small, cut_lineage, measure


# ── pages ────────────────────────────────────────────────────────────────────


def paginate(texts: DataFrame, separator: str = "form-feed") -> DataFrame:
    """(doc, page_index, text) from (doc, text) by `form-feed`, `blank-lines:<n>` or `regex:<pattern>`."""
    text = F.col("text")
    kind, _, argument = separator.partition(":")
    if separator == "form-feed":
        pages = page_text.split_form_feed(text)
    elif kind == "blank-lines" and argument.isdigit():
        pages = page_text.split_blank_lines(text, int(argument))
    elif kind == "regex" and argument:
        pages = page_text.split_regex(text, argument)
    else:
        raise ValueError(f"cannot split pages at {separator!r}: give form-feed, blank-lines:N or regex:PATTERN")
    return texts.select("doc", F.posexplode(pages).alias("_at", "text")).select(
        "doc", (F.col("_at") + 1).alias("page_index"), "text"
    )


def normalize_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", page_text.normalize(F.col("text")))


def pages_without_text(pages: DataFrame) -> DataFrame:
    return pages.where(~page_text.has_text_layer(F.col("text")))


def text_layer_gate(pages: DataFrame) -> DataFrame:
    """(doc, pages, without_text, status): `refused` where any page lacks a text layer."""
    lacking = F.count_if(~page_text.has_text_layer(F.col("text")))
    return pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), lacking.alias("without_text")).withColumn(
        "status", F.when(F.col("without_text") > 0, "refused").otherwise("accepted")
    )


def blank_unreadable(pages: DataFrame) -> DataFrame:
    """Empty the pages without a text layer but keep their numbers."""
    return pages.withColumn("text", F.when(page_text.has_text_layer(F.col("text")), F.col("text")).otherwise(""))


# ── folios ───────────────────────────────────────────────────────────────────


def detect_folios(pages: DataFrame) -> DataFrame:
    """Adds `folio` and `candidates`. Folios that belong to a series share one offset to the page number.

    Each candidate votes once per page for its offset, separately for arabic and roman; the
    offset with most pages (two at least, smaller on a tie) is the document's, and a page takes
    its first candidate on it.
    """
    found = pages.withColumn("candidates", candidates(F.col("text")))
    place = F.col("page_index") - 1
    ballots = F.array_distinct(F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), (c["n"] - place).alias("offset"))))
    votes = found.select("doc", F.explode(ballots).alias("b")).groupBy("doc", "b.kind", "b.offset").agg(F.count(F.lit(1)).alias("n"))
    score = F.struct(F.col("n"), (-F.col("offset")).alias("negative"))
    best = (
        votes.where("n >= 2")
        .groupBy("doc")
        .agg(*[F.max(F.when(F.col("kind") == kind, score)).alias(kind) for kind in ("arabic", "roman")])
        .select("doc", (-F.col("arabic.negative")).alias("_arabic"), (-F.col("roman.negative")).alias("_roman"))
    )
    on_series = lambda c: c["n"] - place == F.when(c["kind"] == "arabic", F.col("_arabic")).otherwise(F.col("_roman"))
    folio = F.get(F.filter("candidates", on_series), F.lit(0))["value"]
    return found.join(best, "doc", "left").withColumn("folio", folio).drop("_arabic", "_roman")


def anchor_folios(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds `folio` from stated facts (doc, page_index, folio): each governs up to the next.

    Pages before the first anchor get none. An anchor that is no numeral, or sits on no page,
    is not used; see `bad_anchors`.
    """
    known = anchors.withColumn("_kind", folio_kind(F.col("folio"))).where(F.col("_kind").isNotNull())
    fact = F.struct(F.col("page_index").alias("page"), F.col("_kind.kind").alias("kind"), F.col("_kind.n").alias("n"))
    facts = known.groupBy("doc", "page_index").agg(F.max(fact).alias("_fact"))
    marked = pages.join(facts, ["doc", "page_index"], "left")
    governed = carry_last(marked, "doc", "page_index", F.col("_fact"), "_governing")
    value = F.col("_governing.n") + F.col("page_index") - F.col("_governing.page")
    folio = F.when(F.col("_governing").isNotNull(), render_folio(F.col("_governing.kind"), value))
    return governed.withColumn("folio", folio).drop("_fact", "_governing")


def bad_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.where(folio_kind(F.col("folio")).isNull() | (F.col("page_index") < 1))


def folio_runs(pages: DataFrame) -> DataFrame:
    """(doc, first_page, last_page, first_folio, last_folio): runs of pages whose folios count up without a gap."""
    typed = pages.select("doc", "page_index", "folio", folio_kind(F.col("folio")).alias("k")).select(
        "doc", "page_index", "folio", F.col("k.kind").alias("kind"), F.col("k.n").alias("n")
    )
    chained = previous_row(typed, "doc", "page_index", ["kind", "n"])
    goes_on = (F.col("prev_kind") == F.col("kind")) & (F.col("prev_n") + 1 == F.col("n"))
    begins = F.when(F.col("kind").isNotNull() & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)
    runs = running_sum(chained, "doc", "page_index", begins, "run").where(F.col("kind").isNotNull())
    return runs.groupBy("doc", "run").agg(
        F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"),
        F.min_by("folio", "page_index").alias("first_folio"), F.max_by("folio", "page_index").alias("last_folio"),
    ).drop("run")


def folio_breaks(detected: DataFrame) -> DataFrame:
    """(doc, kind, first_page, last_page, folio): where the folios of `detect_folios` break off.

    A page that has candidates, none on the series, is a `contradiction` naming its first one;
    neighbouring pages without any candidate form one `gap`.
    """
    state = (
        F.when(F.col("folio").isNotNull(), "folio").when(F.size("candidates") > 0, "contradiction").otherwise("gap")
    )
    typed = detected.select("doc", "page_index", state.alias("kind"), F.get("candidates", F.lit(0))["value"].alias("candidate"))
    grouped = running_sum(typed, "doc", "page_index", F.when(F.col("kind") == "gap", 0).otherwise(1), "island")
    gaps = grouped.where("kind = 'gap'").groupBy("doc", "island").agg(
        F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page")
    ).select("doc", F.lit("gap").alias("kind"), "first_page", "last_page", F.lit(None).cast("string").alias("folio"))
    wrong = typed.where("kind = 'contradiction'").select(
        "doc", "kind", F.col("page_index").alias("first_page"), F.col("page_index").alias("last_page"), F.col("candidate").alias("folio")
    )
    return gaps.unionByName(wrong)


def folio_method(pages: DataFrame, anchors: DataFrame | None = None, allow_none: bool = False) -> DataFrame:
    """(doc, method, accepted): `anchored`, `detected` or `none`; a document without folios is refused unless allowed."""
    per_doc = pages.groupBy("doc").agg(F.bool_or(F.col("folio").isNotNull()).alias("_any"))
    if anchors is None:
        per_doc = per_doc.withColumn("_anchored", F.lit(None).cast("boolean"))
    else:
        per_doc = per_doc.join(anchors.select("doc").distinct().withColumn("_anchored", F.lit(True)), "doc", "left")
    method = F.when(F.col("_anchored"), "anchored").when(F.col("_any"), "detected").otherwise("none")
    return per_doc.select("doc", method.alias("method")).withColumn("accepted", (F.col("method") != "none") | F.lit(allow_none))


# ── outline ──────────────────────────────────────────────────────────────────


def outline_errors(sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc, error, id, other, start, end): duplicate ids, inverted ranges, ends past the last page,
    and overlap with the next section by start page. `sections` carry a unique `ord` per document."""
    none = F.lit(None).cast("string")
    row = lambda df, error, other=none: df.select(
        "doc", F.lit(error).alias("error"), "id", other.alias("other"),
        F.col("start_page_index").alias("start"), F.col("end_page_index").alias("end"),
    )
    firsts = sections.groupBy("doc", "id").agg(F.min("ord").alias("_first"))
    repeated = sections.join(firsts, ["doc", "id"]).where(F.col("ord") > F.col("_first"))
    inverted = sections.where("start_page_index > end_page_index")
    past = sections.join(page_counts, "doc").where("end_page_index > page_count")
    placed = order_rows(sections, ["doc"], ["start_page_index", "ord"], "n")
    pairs = previous_row(placed, "doc", "n", ["id", "start_page_index", "end_page_index"])
    overlapping = pairs.where(
        "prev_start_page_index <= prev_end_page_index AND start_page_index <= end_page_index AND start_page_index <= prev_end_page_index"
    )
    return (
        row(repeated, "duplicate_id").unionByName(row(inverted, "invalid_range")).unionByName(row(past, "out_of_bounds"))
        .unionByName(row(overlapping, "overlap", F.col("prev_id")))
    )


# ── chunks ───────────────────────────────────────────────────────────────────


def chunk_pages(pages: DataFrame, max_tokens: int = 512, overlap: int = 64) -> DataFrame:
    """(doc, seq, text, page_start, page_end, token_count): token windows over the pages of a document.

    Tokens are white-space separated words. A page's tokens are numbered on from the pages
    before it (a running sum of counts) and cut into the windows they fall in, so one row per
    page and window is shuffled, not one per token. Words go through a shuffle as one text, which as an
    array take several times its bytes. A window the previous one covers is not made.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be smaller than max_tokens")
    stride = max_tokens - overlap
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    tokens = pages.select("doc", "page_index", words.alias("words"))
    tokens = tokens.select("doc", "page_index", F.array_join("words", " ").alias("body"), F.size("words").alias("n"))
    placed = running_sum(tokens, "doc", "page_index", F.col("n"), "until", total="total").where("n > 0")
    start, end = F.col("until") - F.col("n"), F.col("until")
    first = F.greatest(F.lit(0), F.ceil((start - max_tokens + 1) / stride))
    last = F.floor((end - 1) / stride)
    split = placed.select("doc", "page_index", F.split("body", " ").alias("words"), start.alias("start"), end.alias("end"),
                          "total", F.sequence(first, last).alias("seqs"))
    sliced = split.select("doc", "page_index", "words", "start", "end", "total", F.explode("seqs").alias("seq"))
    lo = F.greatest(F.col("start"), F.col("seq") * stride)
    hi = F.least(F.col("end"), F.col("seq") * stride + max_tokens)
    piece = F.array_join(F.slice("words", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")), " ")
    wanted = (F.col("seq") == 0) | ((F.col("seq") - 1) * stride + max_tokens < F.col("total"))
    pieces = sliced.where(wanted & (hi > lo)).select("doc", "seq", "page_index", piece.alias("piece"), (hi - lo).alias("n"))
    # At most max_tokens words reach one group.
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "piece")))
    return pieces.groupBy("doc", "seq").agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), " ").alias("text"),
        F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end"), F.sum("n").cast("int").alias("token_count"),
    )


def chunks_for_pages(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks that touch each requested range (request_id, doc, first_page, last_page). Ranges end at the document's last page."""
    ends = chunks.groupBy("doc").agg(F.max("page_end").alias("_end"))
    within = requests.join(ends, "doc").withColumn("first_page", F.greatest("first_page", F.lit(1))).withColumn("last_page", F.least("last_page", F.col("_end")))
    return overlap_join(within.drop("_end"), chunks, "doc", ("first_page", "last_page"), ("page_start", "page_end"))


# ── locators ─────────────────────────────────────────────────────────────────


def _span(lo: Column, hi: Column) -> Column:
    return F.sequence(F.least(lo, hi).cast("int"), F.greatest(lo, hi).cast("int"))


def locate_printed(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, doc, status, first_page, last_page) for folio ranges (request_id, doc, start, end).

    The first page that bears a folio stands for it; a reversed range is swapped.
    """
    bearing = pages.where(F.col("folio").isNotNull()).groupBy("doc", "folio").agg(F.min("page_index").alias("page"))
    out = requests
    for end in ("start", "end"):
        out = out.join(
            bearing.select("doc", F.col("folio").alias(end), F.col("page").alias(f"_{end}")), ["doc", end], "left"
        )
    found = F.col("_start").isNotNull() & F.col("_end").isNotNull()
    return out.select(
        "request_id", "doc", F.when(found, "found").otherwise("folio_not_found").alias("status"),
        F.when(found, F.least("_start", "_end")).alias("first_page"), F.when(found, F.greatest("_start", "_end")).alias("last_page"),
    )


def locate_artifact_pages(requests: DataFrame, page_counts: DataFrame) -> DataFrame:
    """As `locate_printed` for page numbers: both ends must lie within the document."""
    joined = requests.join(page_counts, "doc", "left")
    inside = lambda c: c.isNotNull() & (c >= 1) & (c <= F.col("page_count"))
    start, end = F.col("start").try_cast("int"), F.col("end").try_cast("int")
    found = F.coalesce(inside(start) & inside(end), F.lit(False))
    return joined.select(
        "request_id", "doc", F.when(found, "found").otherwise("out_of_range").alias("status"),
        F.when(found, F.least(start, end)).alias("first_page"), F.when(found, F.greatest(start, end)).alias("last_page"),
    )


def locate_sections(requests: DataFrame, sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(request_id, doc, status, first_page, last_page, missing_from, missing_to): the pages of a section, or of its
    first `head` / last `tail`.

    The first section of that id counts. Pages past the end of the document are missing; both stretches
    are ranges, so a long section is still one row.
    """
    first = sections.groupBy("doc", "id").agg(F.min_by(F.struct("start_page_index", "end_page_index"), "ord").alias("s"))
    joined = requests.join(first, ["doc", "id"], "left").join(page_counts, "doc", "left")
    start, end = F.col("s.start_page_index"), F.col("s.end_page_index")
    lo = F.when(F.col("head").isNull() & F.col("tail").isNotNull(), F.greatest(start, end - F.col("tail") + 1)).otherwise(start)
    hi = F.when(F.col("head").isNotNull(), F.least(end, start + F.col("head") - 1)).otherwise(end)
    known, count = F.col("s").isNotNull(), F.col("page_count")
    some = known & (lo <= hi)
    found, missing = some & (lo <= count), some & (hi > count)
    status = F.when(~known, "section_not_found").when(missing, "partial").otherwise("found")
    return joined.select(
        "request_id", "doc", status.alias("status"),
        F.when(found, lo).alias("first_page"), F.when(found, F.least(hi, count)).alias("last_page"),
        F.when(missing, F.greatest(lo, count + 1)).alias("missing_from"), F.when(missing, hi).alias("missing_to"),
    )


QUOTE_GRAM = 3


def quote_candidates(needles: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, needle, page_index): pages that hold the run of three characters of a needle (doc, needle) that is on the fewest pages.

    Runs are counted on the pages first, those of the needles alone; a needle with a run that is on no page has no candidate.
    """
    wanted = cut_lineage(needles.select("doc", "needle", F.explode(char_runs("needle", QUOTE_GRAM)).alias("_run")))
    on_pages = lambda runs: pages.select("doc", "page_index", F.explode(char_runs("text", QUOTE_GRAM)).alias("_run")).join(
        runs.select("doc", "_run").distinct(), ["doc", "_run"], "left_semi"
    )
    counts = on_pages(wanted).groupBy("doc", "_run").agg(F.count(F.lit(1)).alias("n"))
    rated = wanted.join(counts, ["doc", "_run"], "left").select("doc", "needle", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_run").alias("_run")).alias("r"))
    rarest = cut_lineage(rated.groupBy("doc", "needle").agg(F.min("r").alias("r")).where("r.n > 0").select("doc", "needle", "r._run"))
    return on_pages(rarest).join(rarest, ["doc", "_run"]).select("doc", "needle", "page_index")


def locate_quotes(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, doc, status, page_index) for every page that contains a requested `needle`, case kept.

    A needle that is nowhere gives one row `quote_not_found`, an empty or null one `empty_quote`. Needles meet pages
    through their rarest run of three characters, so neither a common opening nor many requests on many pages make
    all pairs; equal needles of a document are looked for once. Needles under three characters are compared with all
    pages of their document.
    """
    asked = requests.select("request_id", "doc", "needle")
    usable = asked.where(F.length("needle") > 0)
    needles = usable.select("doc", "needle").distinct()
    near = quote_candidates(needles.where(F.length("needle") >= QUOTE_GRAM), pages)
    far = pages.select("doc", "page_index").join(needles.where(F.length("needle") < QUOTE_GRAM), "doc").select("doc", "needle", "page_index")
    hits = near.unionByName(far).join(pages.select("doc", "page_index", "text"), ["doc", "page_index"]).where(F.contains("text", "needle"))
    hits = cut_lineage(hits.select("doc", "needle", "page_index").distinct())
    found = usable.join(hits, ["doc", "needle"]).select("request_id", "doc", F.lit("found").alias("status"), "page_index").distinct()
    missed = usable.join(hits, ["doc", "needle"], "left_anti").select("request_id", "doc", F.lit("quote_not_found").alias("status"))
    empty = asked.where(F.coalesce(F.length("needle"), F.lit(0)) == 0).select("request_id", "doc", F.lit("empty_quote").alias("status"))
    none = missed.unionByName(empty).withColumn("page_index", F.lit(None).cast("int"))
    return found.unionByName(none)


def read_span(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, doc, page_index, text) of located ranges."""
    wanted = spans.where("status = 'found'").select(
        "request_id", "doc", F.explode(_span(F.col("first_page"), F.col("last_page"))).alias("page_index")
    )
    return wanted.join(pages.select("doc", "page_index", "text"), ["doc", "page_index"])
