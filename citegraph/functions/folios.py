"""Printed page numbers: numeral values, rendering, and candidates on a page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citegraph.functions.columns import is_blank, let

# Numerals and their worth.
_NUMERAL_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_UNITS = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
_TENS = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
_HUNDREDS = ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")

_NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]"


def roman_value(token: Column) -> Column:
    """Value of a lower-case roman token, null where it has none.

    Read left to right, a smaller numeral before a larger one is taken away from the total so
    far; a total that would fall below zero (as in `iv`) or ends at zero makes the token invalid.
    """
    worth = F.create_map(*[F.lit(x) for pair in _NUMERAL_VALUES.items() for x in pair])
    values = F.transform(F.regexp_extract_all(token, F.lit("[a-z]"), F.lit(0)), lambda c: F.element_at(worth, c))

    def total(v: Column) -> Column:
        signed = F.transform(v, lambda x, i: F.when(x < F.get(v, i + 1), -x).otherwise(x))
        return F.aggregate(
            signed, F.lit(0), lambda acc, x: F.when((acc < 0) | (acc + x < 0), F.lit(-1)).otherwise(acc + x)
        )

    value = let(values, total)
    return F.when(F.rlike(token, F.lit("^[ivxlcdm]+$")) & (value > 0), value.cast("long"))


def render_roman(value: Column) -> Column:
    digit = lambda names, unit: F.element_at(F.array(*map(F.lit, names)), (F.floor(value / unit) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(value / 1000).cast("int")), digit(_HUNDREDS, 100), digit(_TENS, 10), digit(_UNITS, 1))


def folio_kind(folio: Column) -> Column:
    """STRUCT<kind, n>: `arabic` or `roman` with its value; null where the text is neither."""
    arabic = F.when(F.rlike(folio, F.lit("^[0-9]+$")), folio.try_cast("long"))
    roman = roman_value(folio)
    return F.when(arabic.isNotNull(), F.struct(F.lit("arabic").alias("kind"), arabic.alias("n"))).when(
        roman.isNotNull(), F.struct(F.lit("roman").alias("kind"), roman.alias("n"))
    )


def render_folio(kind: Column, value: Column) -> Column:
    return F.when(kind == "arabic", value.cast("string")).otherwise(render_roman(value))


def candidates(text: Column) -> Column:
    """ARRAY<STRUCT<value, kind, n>>: number and roman tokens on the first and the last non-blank line, in order."""
    lines = F.filter(F.split(text, "\r?\n"), lambda l: ~is_blank(l))
    ends = let(
        lines,
        lambda l: F.when(F.size(l) > 1, F.array(F.get(l, F.lit(0)), F.element_at(l, -1))).otherwise(l),
    )
    tokens = F.flatten(F.transform(ends, lambda l: F.split(l, r"(?U)\s+")))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, f"^{_NOT_WORD}+|{_NOT_WORD}+$", ""))
    numerals = F.filter(bare, lambda t: F.rlike(t, F.lit("^([0-9]+|[ivxlcdm]+)$")))
    known = F.transform(numerals, lambda t: F.struct(t.alias("value"), folio_kind(t).alias("k")))
    return F.transform(
        F.filter(known, lambda c: c["k"].isNotNull()),
        lambda c: F.struct(c["value"].alias("value"), c["k"]["kind"].alias("kind"), c["k"]["n"].alias("n")),
    )
