import random
import re

import pytest
from pyspark.sql import functions as F

from citegraph.functions import folios, page_text
from citegraph.operators import pages
from tests.helpers import bytes_shuffled, rows


def page_table(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc string, page_index int, text string")


def found(spark, *texts):
    return [r["folio"] for r in pages.detect_folios(page_table(spark, *texts)).orderBy("page_index").collect()]


def test_values_of_roman_tokens(spark):
    tokens = ["iii", "xii", "xiv", "mcm", "iv", "ix", "iiii", "ivi", "abc", "vx", "xlii"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", folios.roman_value(F.col("t")).alias("v"))
    assert dict(rows(df)) == {"iii": 3, "xii": 12, "xiv": 14, "mcm": 1900, "iv": None, "ix": None, "iiii": 4, "ivi": None, "abc": None, "vx": None, "xlii": None} | {
        "xlii": None
    }


def test_render_roman(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 9, 14, 40, 90, 444, 1999, 3888)], "n long").select("n", folios.render_roman(F.col("n")).alias("r"))
    assert dict(rows(df)) == {1: "i", 4: "iv", 9: "ix", 14: "xiv", 40: "xl", 90: "xc", 444: "cdxliv", 1999: "mcmxcix", 3888: "mmmdccclxxxviii"}


def test_series_in_header_and_footer(spark):
    assert found(spark, "Intro\nbody\n7", "8 Title\nbody", "more\nbody\n- 9 -") == ["7", "8", "9"]


def test_numbers_inside_the_body_do_not_count(spark):
    assert found(spark, "head\nin 1984 we\ntail", "head\nin 1985 we\ntail") == [None, None]


def test_roman_front_matter_and_arabic_body(spark):
    assert found(spark, "a\nxii", "b\nxiii", "c\n1", "d\n2") == ["xii", "xiii", "1", "2"]


def test_off_series_candidate_is_rejected(spark):
    table = page_table(spark, "a\n5", "b\n6", "wrong\n99", "plate", "e\n9")
    detected = pages.detect_folios(table)
    assert [r["folio"] for r in detected.orderBy("page_index").collect()] == ["5", "6", None, None, "9"]
    assert rows(pages.folio_breaks(detected)) == [("d", "contradiction", 3, 3, "99"), ("d", "gap", 4, 4, None)]
    assert rows(pages.folio_runs(detected)) == [("d", 1, 2, "5", "6"), ("d", 5, 5, "9", "9")]


def test_single_page_has_no_neighbour_to_confirm_it(spark):
    table = pages.detect_folios(page_table(spark, "text\n12", "nothing here"))
    assert rows(pages.folio_method(table)) == [("d", "none", False)]
    assert rows(pages.folio_method(table, allow_none=True)) == [("d", "none", True)]


def test_anchors_govern_up_to_the_next(spark):
    anchors = spark.createDataFrame([("d", 2, "xii"), ("d", 4, "1"), ("d", 5, "p5")], "doc string, page_index int, folio string")
    got = pages.anchor_folios(page_table(spark, *"abcde"), anchors)
    assert rows(got, "page_index", "folio") == [(1, None), (2, "xii"), (3, "xiii"), (4, "1"), (5, "2")]
    assert rows(pages.bad_anchors(anchors), "folio") == [("p5",)]


@pytest.mark.parametrize(
    ("separator", "text", "want"),
    [
        ("form-feed", "a\fb\f", ["a", "b"]), ("form-feed", "", []), ("form-feed", "a\f\fb", ["a", "", "b"]),
        ("blank-lines:2", "a\nb\n\n\nc\n\nd\n", ["a\nb\n\n\n", "c\n\nd\n"]), ("blank-lines:2", "\n\n\na\n", ["\n\n\na\n"]), ("blank-lines:1", " \n\n", []),
        ("blank-lines:1", "a\n\nb", ["a\n\n", "b"]),
        ("regex:^PAGE", "pre\nPAGE 1\nx\nPAGE 2", ["pre\n", "PAGE 1\nx\n", "PAGE 2"]), ("regex:^PAGE", "PAGE 1\nx\n", ["PAGE 1\nx\n"]), ("regex:^", "a\nb\n", ["a\n", "b\n"]),
    ],
)
def test_paginate(spark, separator, text, want):
    got = pages.paginate(spark.createDataFrame([("d", text)], "doc string, text string"), separator)
    assert [r["text"] for r in got.orderBy("page_index").collect()] == want


def test_bad_separators(spark):
    texts = spark.createDataFrame([("d", "x")], "doc string, text string")
    for separator in ("pages", "blank-lines:x", "blank-lines:0", "regex:"):
        with pytest.raises(ValueError):
            pages.paginate(texts, separator)


def test_normalize(spark):
    cases = {"hello   \nworld \t\r\n": "hello\nworld\n", "a\n\n\n\n\nb": "a\n\n\nb\n", "\n\n\n\na": "\n\na\n", "": "", "  \n": "\n"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", page_text.normalize(F.col("t")).alias("n"))
    assert dict(rows(df)) == cases


def test_pages_without_text_layer(spark):
    table = page_table(spark, "Real content here.", "  \n\n ", "", "abcd")
    assert rows(pages.pages_without_text(table), "page_index") == [(2,), (3,), (4,)]
    assert rows(pages.text_layer_gate(table)) == [("d", 4, 3, "refused")]
    assert rows(pages.blank_unreadable(table), "page_index", "text")[3] == (4, "")


def test_chunks_overlap_and_keep_page_numbers(spark):
    table = page_table(spark, "a b c d e", "", "f g h i j")
    got = pages.chunk_pages(table, 4, 1).orderBy("seq").collect()
    assert [(r["text"], r["page_start"], r["page_end"]) for r in got] == [("a b c d", 1, 1), ("d e f g", 1, 3), ("g h i j", 3, 3)]
    assert pages.chunk_pages(page_table(spark, " "), 4, 1).count() == 0
    with pytest.raises(ValueError):
        pages.chunk_pages(table, 4, 4)


def test_outline_errors(spark):
    sections = spark.createDataFrame(
        [("d", 1, "a", 1, 5), ("d", 2, "b", 4, 6), ("d", 3, "a", 9, 7), ("d", 4, "c", 10, 12)], "doc string, ord int, id string, start_page_index int, end_page_index int"
    )
    counts = spark.createDataFrame([("d", 11)], "doc string, page_count int")
    got = rows(pages.outline_errors(sections, counts), "error", "id", "other")
    assert got == [("duplicate_id", "a", None), ("invalid_range", "a", None), ("out_of_bounds", "c", None), ("overlap", "b", "a")]


def test_locators(spark):
    table = spark.createDataFrame(
        [("d", 1, None, "cover"), ("d", 2, "1", "alpha"), ("d", 3, "2", "Beta"), ("d", 4, "3", "beta"), ("d", 5, "4", "end")],
        "doc string, page_index int, folio string, text string",
    )
    asked = spark.createDataFrame([(1, "d", "3", "1"), (2, "d", "9", "1")], "request_id int, doc string, start string, end string")
    assert rows(pages.locate_printed(asked, table)) == [(1, "d", "found", 2, 4), (2, "d", "folio_not_found", None, None)]
    counts = spark.createDataFrame([("d", 5)], "doc string, page_count int")
    ranges = spark.createDataFrame([(1, "d", "5", "2"), (2, "d", "0", "2"), (3, "d", "1", "6"), (4, "d", "x", "1")], "request_id int, doc string, start string, end string")
    assert rows(pages.locate_artifact_pages(ranges, counts), "request_id", "status", "first_page", "last_page") == [
        (1, "found", 2, 5), (2, "out_of_range", None, None), (3, "out_of_range", None, None), (4, "out_of_range", None, None)
    ]
    sections = spark.createDataFrame([("d", 1, "s", 2, 4), ("d", 2, "t", 4, 7)], "doc string, ord int, id string, start_page_index int, end_page_index int")
    wants = spark.createDataFrame(
        [(1, "d", "s", None, None), (2, "d", "s", 2, None), (3, "d", "s", None, 1), (4, "d", "t", None, None), (5, "d", "t", 2, None), (6, "d", "u", None, None)],
        "request_id int, doc string, id string, head int, tail int",
    )
    assert rows(pages.locate_sections(wants, sections, counts), "request_id", "status", "first_page", "last_page", "missing_from", "missing_to") == [
        (1, "found", 2, 4, None, None), (2, "found", 2, 3, None, None), (3, "found", 4, 4, None, None), (4, "partial", 4, 5, 6, 7),
        (5, "found", 4, 5, None, None), (6, "section_not_found", None, None, None, None),
    ]
    quotes = spark.createDataFrame([(1, "d", "eta"), (2, "d", "beta"), (3, "d", "nowhere"), (4, "d", ""), (5, "d", "Be"), (6, "e", "beta")], "request_id int, doc string, needle string")
    assert rows(pages.locate_quotes(quotes, table), "request_id", "status", "page_index") == [
        (1, "found", 3), (1, "found", 4), (2, "found", 4), (3, "quote_not_found", None), (4, "empty_quote", None), (5, "found", 3), (6, "quote_not_found", None)
    ]
    assert rows(pages.read_span(pages.locate_printed(asked, table), table), "page_index", "text") == [(2, "alpha"), (3, "Beta"), (4, "beta")]


def test_quotes_that_all_begin_alike_meet_few_pages(spark):
    """Three hundred needles that begin with a word of every page: candidates stay near the hits."""
    texts = [f"the start of page {k} and the word{k:03d}x closes the page" for k in range(300)]
    page_table = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(texts)], "doc string, page_index int, text string")
    needles = [f"the word{k:03d}x" for k in range(0, 600, 2)]
    asked = spark.createDataFrame([(k, "d", n) for k, n in enumerate(needles)] + [(900, "d", "the"), (901, "d", "th"), (902, "d", ""), (903, "e", "the"), (904, "d", needles[3])], "request_id int, doc string, needle string")
    got = pages.locate_quotes(asked, page_table).collect()
    found = {(r["request_id"], r["page_index"]) for r in got if r["status"] == "found"}
    want = {(k, i + 1) for k, n in enumerate(needles) for i, t in enumerate(texts) if n in t} | {(q, i + 1) for q in (900, 901) for i in range(300)} | {(904, 7)}
    assert found == want and len([r for r in got if r["status"] == "found"]) == len(want)
    assert {(r["request_id"], r["status"]) for r in got if r["request_id"] > 901 and r["status"] != "found"} == {(902, "empty_quote"), (903, "quote_not_found")}
    distinct = spark.createDataFrame([("d", n) for n in needles], "doc string, needle string")
    assert pages.quote_candidates(distinct, page_table).count() <= 12 * 150


def test_chunks_shuffle_little_more_than_the_text_twice(spark, tmp_path):
    """Once to number the words and once into windows; arrays of words, and whole windows a third time, took more than three times as much."""
    rng = random.Random(2)
    texts = [" \u2003".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5)) for _ in range(900)) for _ in range(120)]
    frame = spark.createDataFrame([(f"d{k % 40}", k // 40 + 1, t) for k, t in enumerate(texts)] + [("d0", 4, None), ("d0", 5, " ")], "doc string, page_index int, text string")
    frame.write.parquet(f"{tmp_path}/pages")
    made = []
    shuffled = bytes_shuffled(spark, lambda: made.extend(pages.chunk_pages(spark.read.parquet(f"{tmp_path}/pages"), 64, 8).collect()))
    for doc in ("d0", "d39"):
        words = [(w, k // 40 + 1) for k, t in enumerate(texts) if f"d{k % 40}" == doc for w in re.split(r"\s+", t)]
        windows = [words[at : at + 64] for at in range(0, len(words), 56) if at == 0 or at + 8 < len(words)]
        want = [(k, " ".join(w for w, _ in x), x[0][1], x[-1][1], len(x)) for k, x in enumerate(windows)]
        assert sorted(tuple(r)[1:] for r in made if r["doc"] == doc) == want
    assert shuffled < 2.5 * sum(6 * len(t.split()) for t in texts)
