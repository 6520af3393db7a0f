"""Cutting one text into pages, and normalising page text. All row-local: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from citegraph.functions.columns import is_blank, let

#: Fewer non-space characters than this and a page has no text layer.
TEXT_LAYER_MIN_CHARS = 5


def split_form_feed(text: Column) -> Column:
    """Pages between form feeds; a trailing one adds no page, empty text has none."""
    return let(
        F.split(text, "\f"),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def _cut(text: Column, starts: Callable[[Column], Column]) -> Column:
    """Pages from the line numbers (from 0) at which a page starts; line 0 always starts one."""

    def pages(lines: Column, firsts: Column) -> Column:
        count = F.size(lines)
        page = lambda s, i: F.concat(
            F.array_join(F.slice(lines, s + 1, F.coalesce(F.get(firsts, i + 1), count) - s), "\n"),
            F.when(F.get(firsts, i + 1).isNotNull() | F.endswith(text, F.lit("\n")), "\n").otherwise(""),
        )
        return F.transform(firsts, page)

    def from_lines(lines: Column) -> Column:
        firsts = F.array_distinct(F.concat(F.array(F.lit(0)), starts(lines)))
        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(let(firsts, lambda f: pages(lines, f)))

    without_tail = let(
        F.split(text, "\n"),
        lambda l: F.when(F.element_at(l, -1) == "", F.slice(l, F.lit(1), F.size(l) - 1)).otherwise(l),
    )
    return let(without_tail, from_lines)


def split_blank_lines(text: Column, n: int) -> Column:
    """A page starts at a non-blank line after `n` or more blank ones; the blanks stay with the page before."""
    if n < 1:
        raise ValueError("a page break needs one blank line or more")

    def starts(lines: Column) -> Column:
        def from_blanks(blank: Column) -> Column:
            opened = F.array_position(blank, F.lit(False))  # 1-based place of the first non-blank line
            after_gap = lambda i: (i >= opened) & ~F.get(blank, i) & F.forall(F.slice(blank, i - (n - 1), F.lit(n)), lambda b: b)
            numbers = F.sequence(F.lit(0), F.size(blank) - 1)
            return F.filter(numbers, lambda i: F.when(i >= n, after_gap(i)).otherwise(F.lit(False)))

        return let(F.transform(lines, is_blank), from_blanks)

    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(_cut(text, starts))


def split_regex(text: Column, pattern: str) -> Column:
    """A page starts at each line that matches `pattern`."""

    def starts(lines: Column) -> Column:
        hits = F.transform(lines, lambda l, i: F.when(F.rlike(l, F.lit(pattern)), i))
        return F.filter(hits, lambda i: i.isNotNull())

    return _cut(text, starts)


def normalize(text: Column) -> Column:
    """Right-trimmed lines, at most two blank ones in a row, each line ended."""
    trimmed = F.regexp_replace(text, r"(?U)[\s&&[^\n]]++(?=\n|\z)", "")
    ended = let(trimmed, lambda t: F.when((t == "") | F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n"))))
    return F.regexp_replace(F.regexp_replace(ended, r"\n{4,}", "\n\n\n"), r"\A\n{3,}", "\n\n")


def has_text_layer(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", "")) >= TEXT_LAYER_MIN_CHARS
