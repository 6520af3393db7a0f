"""General column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Unicode white space in Java regular expressions.
SPACE = r"(?U)\s"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body` (also inside nested lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)\S"))


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def text_lines(text: Column) -> Column:
    """Lines without their terminators; a trailing terminator adds no line."""
    return let(
        F.split(text, "\r?\n"),
        lambda l: F.when(F.element_at(l, -1) == "", F.slice(l, F.lit(1), F.size(l) - 1)).otherwise(l),
    )


def char_runs(text: Column | str, size: int) -> Column:
    """The different runs of `size` characters of a text; none of a shorter text.

    One pass over the text that looks ahead at each character. Cutting each run by its place would count characters from the start for
    every run, which takes the square of the text's length.
    """
    text = F.col(text) if isinstance(text, str) else text
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * size + "))."), 1))
    return F.coalesce(runs, F.array().cast("array<string>"))
