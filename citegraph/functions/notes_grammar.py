"""The block grammar of research notes, as expressions over one note's text.

A note is one cell, so everything that only looks inside a note is row-local: lines are an
array, headings cut it into nodes, bullets cut a node's body. No shuffle until tables meet.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citegraph.functions.columns import is_blank, let, trim, trim_end, trim_start

FENCE = "---"
_BRACKET = r"\[\[((?:(?!\]\]).)*+)\]\]"
EXPLICIT_LINK = rf"(?sU)\A{_BRACKET}\s*([a-z][a-z0-9-]*)\s+{_BRACKET}(.*)\z"
IMPLICIT_LINK = rf"(?sU)\A([a-z][a-z0-9-]*)\s+{_BRACKET}(.*)\z"
_FLOW_PART = r"""((?:[^,'"]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z))++)"""
_HEADING_ANCHOR = r"(?sU)\A(?:(.*)\s)?\^(\S+)\z"


def closing_fence(lines: Column) -> Column:
    """1-based line of the fence that closes the frontmatter, 0 when there is none."""
    second = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), FENCE)
    return F.when((F.get(lines, F.lit(0)) == FENCE) & (second > 0), (second + 1).cast("int")).otherwise(F.lit(0))


def frontmatter(lines: Column, fence: Column) -> Column:
    """Lines between the fences; an empty block counts as none."""
    return F.when(fence >= 3, F.slice(lines, F.lit(2), fence - 2)).otherwise(F.array().cast("array<string>"))


def frontmatter_value(block: Column, key: str) -> Column:
    """Value of the first `key:` line: null without one, empty for a bare key or a block marker."""
    line = F.get(F.filter(block, lambda l: F.rlike(l, F.lit(f"^{key}:( |$)"))), F.lit(0))
    value = trim(F.regexp_replace(line, f"^{key}:", ""))
    return F.when(value.isin(">", "|"), "").otherwise(value)


def sections(lines: Column, fence: Column) -> Column:
    """ARRAY<STRUCT<ord, line, heading, id, title, body>>: one entry per `## ` heading below the frontmatter."""
    numbered = F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("l")))
    heads = F.filter(numbered, lambda x: (x["i"] >= fence) & F.startswith(x["l"], F.lit("## ")))

    def cut(h: Column) -> Column:
        return F.transform(
            h,
            lambda x, j: F.struct(
                j.alias("ord"), (x["i"] + 1).alias("line"), x["l"].alias("heading"),
                heading_anchor(x["l"]).alias("id"), heading_title(x["l"]).alias("title"),
                F.slice(lines, x["i"] + 2, F.coalesce(F.get(h, j + 1)["i"], F.size(lines)) - x["i"] - 1).alias("body"),
            ),
        )

    return let(heads, cut)


def heading_anchor(heading: Column) -> Column:
    """The trailing `^token` of a heading line, without its caret; null without one."""
    text = trim_end(F.substr(heading, F.lit(4)))
    found = F.regexp_extract(text, _HEADING_ANCHOR, 2)
    return F.when(found != "", found)


def heading_title(heading: Column) -> Column:
    text = trim_end(F.substr(heading, F.lit(4)))
    return F.when(F.rlike(text, F.lit(_HEADING_ANCHOR)), trim_end(F.regexp_extract(text, _HEADING_ANCHOR, 1))).otherwise(text)


def bullets(body: Column) -> Column:
    """ARRAY<STRUCT<at, text>>: each `- ` item with its indented lines folded in; `at` counts body lines from 1."""
    numbered = F.transform(body, lambda l, i: F.struct(i.alias("i"), l.alias("l")))
    heads = F.filter(numbered, lambda x: F.rlike(x["l"], F.lit(r"(?U)\A\s*- ")))

    def fold(h: Column) -> Column:
        def item(x: Column, j: Column) -> Column:
            rest = F.slice(body, x["i"] + 2, F.coalesce(F.get(h, j + 1)["i"], F.size(body)) - x["i"] - 1)
            more = F.transform(F.filter(rest, lambda l: F.rlike(l, F.lit(r"(?U)\A\s+\S"))), trim_start)
            first = F.regexp_replace(x["l"], r"(?U)\A\s*- ", "")
            return F.struct((x["i"] + 1).alias("at"), trim(F.array_join(F.concat(F.array(first), more), " ")).alias("text"))

        return F.transform(h, item)

    return let(heads, fold)


def read_bullets(body: Column) -> Column:
    """ARRAY<STRUCT<at, text, c, m>>: bullets with their class (`classify`) and the flow map of their raw value.

    Reading happens inside the array, so that exploding it gives plain columns: a filter on them is
    not rewritten into the patterns and evaluated again.
    """
    sorted_out = F.transform(bullets(body), lambda b: F.struct(b["at"].alias("at"), b["text"].alias("text"), classify(b["text"]).alias("c")))
    return F.transform(
        sorted_out,
        lambda b: F.struct(
            b["at"].alias("at"), b["text"].alias("text"), b["c"].alias("c"), flow_map(F.coalesce(b["c"]["raw"], F.lit(""))).alias("m")
        ),
    )


def _unquote(text: Column) -> Column:
    quoted = F.rlike(text, F.lit(r"""(?s)\A(?:'.*'|".*")\z""")) & (F.length(text) >= 2)
    return F.when(quoted, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def flow_map(text: Column) -> Column:
    """STRUCT<is_map, malformed, entries> of `{k: v, 'quoted, comma'}`.

    Commas inside quotes do not split; each part splits at its first colon; a part without
    one makes the whole map malformed. The last of equal keys wins.
    """
    is_map = F.rlike(text, F.lit(r"(?s)\A\{.*\}\z")) & (F.length(text) >= 2)
    parts = F.filter(
        F.transform(F.regexp_extract_all(F.substr(text, F.lit(2), F.length(text) - 2), F.lit(_FLOW_PART), F.lit(1)), trim),
        lambda p: p != "",
    )

    def read(p: Column) -> Column:
        pairs = F.transform(
            p,
            lambda x: F.struct(
                trim(F.regexp_extract(x, r"(?s)\A([^:]*):", 1)).alias("key"),
                _unquote(trim(F.regexp_replace(x, r"(?s)\A[^:]*:", ""))).alias("value"),
            ),
        )
        last = let(
            pairs,
            lambda all_: F.filter(
                all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["key"] == x["key"])
            ),
        )
        bad = F.exists(p, lambda x: ~F.contains(x, F.lit(":")))
        none = F.array().cast("array<struct<key:string,value:string>>")
        return F.struct(
            is_map.alias("is_map"), (is_map & bad).alias("malformed"),
            F.when(is_map & ~bad, last).otherwise(none).alias("entries"),
        )

    return let(parts, read)


def entries_json(entries: Column) -> Column:
    """A JSON object of flow-map entries, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def endpoint(target: Column) -> Column:
    """STRUCT<type, scheme, value>: `^anchor` is a node, `scheme:value` a catalog entry, anything else a document."""
    alias = r"(?s)\A([a-z0-9_]*):(.+)\z"
    none = F.lit(None).cast("string")
    of = lambda type_, scheme, value: F.struct(F.lit(type_).alias("type"), scheme.alias("scheme"), value.alias("value"))
    return (
        F.when(F.startswith(target, F.lit("^")), of("node", none, F.substr(target, F.lit(2))))
        .when(F.rlike(target, F.lit(alias)), of("catalog", F.regexp_extract(target, alias, 1), F.regexp_extract(target, alias, 2)))
        .otherwise(of("node", none, F.concat(F.lit("doc:"), target)))
    )


def endpoint_text(end: Column) -> Column:
    return F.when(end["type"] == "node", F.concat(F.lit("node:"), end["value"])).otherwise(
        F.concat(end["scheme"], F.lit(":"), end["value"])
    )


def classify(text: Column) -> Column:
    """STRUCT<form, source, kind, target, key, raw> of one bullet: explicit, implicit, tags, property, broken_link or other."""
    part = lambda pattern, n: F.regexp_extract(text, pattern, n)
    key = trim(part(r"(?s)\A([^:]*):", 1))
    is_property = F.contains(text, F.lit(":")) & (key != "") & ~F.contains(key, F.lit(" ")) & ~F.contains(key, F.lit("["))
    none = F.lit(None).cast("string")

    def row(form, source=none, kind=none, target=none, key_=none, raw=none):
        named = zip(("form", "source", "kind", "target", "key", "raw"), (F.lit(form), source, kind, target, key_, raw))
        return F.struct(*[c.alias(n) for n, c in named])

    value = trim(F.regexp_replace(text, r"(?s)\A[^:]*:", ""))
    return (
        F.when(
            F.rlike(text, F.lit(EXPLICIT_LINK)),
            row("explicit", trim(part(EXPLICIT_LINK, 1)), part(EXPLICIT_LINK, 2), trim(part(EXPLICIT_LINK, 3)), none, trim(part(EXPLICIT_LINK, 4))),
        )
        .when(
            F.rlike(text, F.lit(IMPLICIT_LINK)),
            row("implicit", none, part(IMPLICIT_LINK, 1), trim(part(IMPLICIT_LINK, 2)), none, trim(part(IMPLICIT_LINK, 3))),
        )
        .when(is_property & (key == "tags"), row("tags", raw=value))
        .when(is_property, row("property", key_=key, raw=value))
        .when(F.contains(text, F.lit("[[")), row("broken_link"))
        .otherwise(row("other"))
    )


def body_hash(heading: Column, body: Column) -> Column:
    """Digest of a heading and its lines; trailing space and trailing blank lines do not count."""
    lines = F.concat(F.array(trim_end(heading)), drop_blank_tail(F.transform(body, trim_end)))
    return F.sha2(F.array_join(F.concat(lines, F.array(F.lit(""))), "\n"), 256)


def lines_hash(lines: Column) -> Column:
    kept = drop_blank_tail(F.transform(lines, trim_end))
    return let(kept, lambda k: F.sha2(F.when(F.size(k) == 0, "").otherwise(F.concat(F.array_join(k, "\n"), F.lit("\n"))), 256))


def blank_tail(lines: Column) -> Column:
    """How many blank lines end the array."""
    full = F.transform(lines, lambda l, i: F.when(~is_blank(l), i + 1))
    return F.size(lines) - F.coalesce(F.array_max(full), F.lit(0))


def drop_blank_tail(lines: Column) -> Column:
    return let(lines, lambda l: F.slice(l, F.lit(1), F.size(l) - blank_tail(l)))


def missing_lines(dest: Column, source: Column) -> Column:
    """Non-blank source lines (in order, repeats kept) that the destination lacks, trailing space aside."""
    have = F.transform(dest, trim_end)
    return let(have, lambda h: F.filter(source, lambda l: ~is_blank(l) & ~F.array_contains(h, trim_end(l))))


def union_lines(dest: Column, source: Column) -> Column:
    """The destination lines with the missing source lines put before its blank tail."""
    return let(
        dest,
        lambda d: F.concat(
            F.slice(d, F.lit(1), F.size(d) - blank_tail(d)), missing_lines(d, source),
            F.slice(d, F.size(d) - blank_tail(d) + 1, F.size(d)),
        ),
    )
