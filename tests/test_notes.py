import pytest
from pyspark.sql import functions as F

from citegraph.functions import notes_grammar as g
from citegraph.operators import notes, notes_sync
from citegraph.sources.notes_files import read_notes
from tests.helpers import rows

NOTE = """---
schema: log
doc: river-log
---

Prose before the first heading belongs to no node.

## Gauge at the weir ^g-77
- level: 3.2 m
- source [[crossref:10.5/ab]]
- [[field-diary]] mentions [[^g-77]] {page: 12}

## Open question
- follows [[^g-77]] {since: 'spring, early'}
- status: {unsure}

## Delta survey (draft), see [[openalex:W88]] ^k-5
- summary: two lines
  make one
- compares [[openalex:W31]] {how: "by eye, twice"}
- reading: {why: 'later, if at all', role: core}
- Bad [[x
- tags: #hydro #delta
- catalog [[doi:10.7/q]]
"""


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "slug string, text string")


@pytest.fixture(scope="module")
def graph(spark):
    return notes.lift_notes(files(spark, river=NOTE))


def test_nodes_labels_and_properties(graph):
    assert rows(graph.nodes, "ord", "id", "heading_line") == [(0, "g-77", 8), (1, None, 13), (2, "k-5", 17)]
    assert rows(graph.labels, "id", "label") == [("k-5", "delta"), ("k-5", "hydro")]
    stated = {(r["ord"], r["key"]): r["value"] for r in graph.properties.collect()}
    assert stated[2, "title"] == "Delta survey (draft), see [[openalex:W88]]"
    assert stated[0, "level"] == "3.2 m" and stated[2, "summary"] == "two lines make one"
    assert stated[2, "reading"] == '{"role":"core","why":"later, if at all"}'
    assert stated[1, "status"] == "{unsure}"


def test_links_and_warnings(graph):
    shown = graph.links.select("recorded_in", g.endpoint_text(F.col("source")).alias("s"), "kind", g.endpoint_text(F.col("target")).alias("t"))
    assert rows(shown) == [
        (None, "node:", "follows", "node:g-77"), ("g-77", "node:doc:field-diary", "mentions", "node:g-77"), ("g-77", "node:g-77", "source", "crossref:10.5/ab"),
        ("k-5", "node:k-5", "catalog", "doi:10.7/q"), ("k-5", "node:k-5", "compares", "openalex:W31"),
    ]
    assert sorted(e["value"] for r in graph.links.collect() for e in r["entries"]) == ["12", "by eye, twice", "spring, early"]
    assert rows(graph.warnings, "line", "message") == sorted([(13, notes.NO_ANCHOR), (15, notes.MALFORMED_MAP), (22, notes.NEITHER_FORM)], key=str)
    assert rows(notes.cross_references(graph)) == [("river-log", "field-diary", False)]
    assert rows(notes.work_index(graph)) == [("crossref:10.5/ab", "river-log"), ("doi:10.7/q", "river-log"), ("openalex:W31", "river-log")]
    assert rows(notes.reading_list(graph), "rank", "role", "why", "work_id") == [(1, "core", "later, if at all", "doi:10.7/q")]


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("[[a]] kind [[b]]", "explicit"), ("kind [[b]]", "implicit"), ("Kind [[b]]", "broken_link"), ("kind: [[b]]", "property"), ("tags: #x", "tags"),
        ("two words: x", "other"), ("[[a]] Bad [[b]]", "broken_link"), ("[[a]]kind [[b]]", "explicit"), ("kind[[b]]", "broken_link"), ("plain", "other"), ("a b [[c]]: d", "broken_link"),
    ],
)
def test_bullet_forms(spark, text, form):
    df = spark.createDataFrame([(text,)], "t string").select(g.classify(F.col("t"))["form"].alias("f"))
    assert df.first()["f"] == form


def test_endpoints(spark):
    cases = {"^r-1": "node:r-1", "isbn:97:8": "isbn:97:8", "slug": "node:doc:slug", "Upper:x": "node:doc:Upper:x", "empty:": "node:doc:empty:"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", g.endpoint_text(g.endpoint(F.col("t"))).alias("e"))
    assert dict(rows(df)) == cases


def test_note_without_frontmatter(spark):
    made = notes.lift_notes(files(spark, plain="## A ^x\n", open_="---\ndoc: z\n## B ^y\n"))
    assert rows(made.nodes, "doc", "id", "heading_line") == [("open_", "y", 3), ("plain", "x", 1)]
    assert rows(made.warnings, "doc", "message") == [("open_", notes.NO_FRONTMATTER), ("plain", notes.NO_FRONTMATTER)]


def test_anchors_are_appended_and_repeatable(spark):
    given = files(spark, a="---\ndoc: a\n---\n## One\n- x: 1\n## Two ^r-2\n## One\n", b="## One")
    assigned, after = notes.assign_anchors(given)
    again, _ = notes.assign_anchors(given)
    assert rows(assigned, "slug", "ord", "anchor") == rows(again, "slug", "ord", "anchor")
    assert len({r["anchor"] for r in assigned.collect()}) == 3
    text = dict(rows(after))
    ids = {(r["slug"], r["ord"]): r["anchor"] for r in assigned.collect()}
    assert text["a"] == f"---\ndoc: a\n---\n## One ^{ids['a', 0]}\n- x: 1\n## Two ^r-2\n## One ^{ids['a', 2]}\n"
    assert text["b"] == f"## One ^{ids['b', 0]}"


def test_temporary_anchors_are_resolved_everywhere(spark):
    given = files(spark, a="## New ^t-x\n- see [[^t-xy]]\n## Twice ^t-d\n", b="- lost\n## B ^r-b\n- see [[^t-x]] and ^t-x-not\n- [[^t-x]] cites [[^t-d]]\n## Again ^t-d\n")
    done = notes.resolve_temp_anchors(given)
    new = done.resolved.first()["anchor"]
    assert rows(done.resolved, "temp", "doc") == [("t-x", "a")]
    assert rows(done.duplicates) == [("t-d", "a"), ("t-d", "b")] and rows(done.dangling) == [("t-xy",)]
    text = dict(rows(done.files))
    assert text["a"] == f"## New ^{new}\n- see [[^t-xy]]\n## Twice ^t-d\n"
    assert text["b"] == f"- lost\n## B ^r-b\n- see [[^{new}]] and ^t-x-not\n- [[^{new}]] cites [[^t-d]]\n## Again ^t-d\n"


def test_write_gate(spark):
    stored = files(spark, other="---\ndoc: other\n---\n## Held ^r-dup\n", same="---\ndoc: same\n---\n## Mine ^r-own\n")
    head = "---\ndoc: d\n---\n"
    incoming = files(spark, bad=head + "## N ^r-1\n- [[dangling\n", clash=head + "## N ^r-dup\n", fine=head + "## No anchor\n", same=head + "## Mine ^r-own\n")
    assert dict(rows(notes.write_gate(incoming, stored))) == {"bad": "blocked", "clash": "conflict", "fine": "accepted", "same": "accepted"}
    assert dict(rows(notes.write_gate(incoming, stored, force=True)))["bad"] == "accepted"


def test_lint(spark):
    given = files(spark, x="---\ndoc: y\ndomain: old\n---\n## A ^t-1\n", ok="---\ndoc: ok\n---\n## A ^r-1\n- catalog [[doi:1]]\n")
    found = rows(notes.lint(given, notes.lift_notes(given)), "slug", "warning")
    assert [w for s, w in found if s == "x"] == sorted(
        ["the note names another document than its file", "the old key `domain` is still there", "the note refers to no catalog work", "a temporary anchor is left"]
    )
    assert [w for s, w in found if s == "ok"] == []


def test_reading_note_files(spark, tmp_path):
    for name in ("a.l3.md", "sub/b.l3.md", "_hidden.l3.md", "_dir/c.l3.md", "INDEX.md", "d.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("---\ntwo\nlines\n")
    assert rows(read_notes(spark, str(tmp_path)), "slug", "text") == [("a", "---\ntwo\nlines\n"), ("b", "---\ntwo\nlines\n")]


# ── synchronisation ──────────────────────────────────────────────────────────

DOC = "---\ndoc: alpha\n---\n\n## First ^r-1\n- tags: #x\n\n## Second ^r-2\n- key: value\n"


def merge(spark, source, dest, base=None):
    plan = notes_sync.plan_merge(files(spark, **source), files_or_none(spark, dest), spark.createDataFrame(list((base or {}).items()), "key string, hash string"))
    actions = {r["anchor"]: r["action"] for r in plan.node_actions.collect() if r["anchor"]}
    return actions, dict(rows(plan.writes)), dict(rows(plan.state_after)), dict(rows(plan.header_actions))


def files_or_none(spark, texts):
    return spark.createDataFrame(list(texts.items()), "slug string, text string")


def hashes(spark, text):
    unit = {r["anchor"]: r["hash"] for r in notes_sync.units(files(spark, alpha=text)).collect()}
    return unit | {"doc:alpha": notes_sync.headers(files(spark, alpha=text)).first()["hash"]}


def test_missing_note_is_created(spark):
    actions, writes, state, heads = merge(spark, {"alpha": DOC}, {})
    assert actions == {"r-1": "add", "r-2": "add"} and writes == {"alpha": DOC} and heads == {"alpha": "created"}
    assert set(state) == {"r-1", "r-2", "doc:alpha"}


def test_addition_keeps_the_other_header_and_spacing(spark):
    dest = "---\ndoc: alpha\nupdated: later\n---\n\n## First ^r-1\n- tags: #x\n"
    actions, writes, _, heads = merge(spark, {"alpha": DOC}, {"alpha": dest})
    assert actions == {"r-1": "in_sync", "r-2": "add"} and heads == {"alpha": "conflict"}
    assert writes == {"alpha": dest + "\n## Second ^r-2\n- key: value\n"}


def test_one_sided_edits(spark):
    edited = DOC.replace("#x", "#x #y")
    base = hashes(spark, DOC)
    actions, writes, state, _ = merge(spark, {"alpha": edited}, {"alpha": DOC}, base)
    assert actions["r-1"] == "replace" and writes == {"alpha": edited} and "r-1" in state
    actions, writes, state, _ = merge(spark, {"alpha": DOC}, {"alpha": edited}, base)
    assert actions["r-1"] == "dest_wins" and writes == {} and "r-1" not in state


def test_edits_on_both_sides_unite_lines(spark):
    source, dest = DOC.replace("#x\n", "#x\n- s: 1\n"), DOC.replace("#x\n", "#x\n- d: 1\n")
    actions, writes, state, _ = merge(spark, {"alpha": source}, {"alpha": dest})
    assert actions["r-1"] == "line_union" and writes == {"alpha": DOC.replace("#x\n", "#x\n- d: 1\n- s: 1\n")} and "r-1" not in state
    renamed = DOC.replace("First", "Renamed")
    assert merge(spark, {"alpha": renamed}, {"alpha": DOC})[0]["r-1"] == "conflict"


def test_deletions_and_moves_never_travel(spark):
    short, base = DOC.split("\n## Second")[0] + "\n", hashes(spark, DOC)
    actions, writes, _, _ = merge(spark, {"alpha": short}, {"alpha": DOC}, base)
    assert actions["r-2"] == "deleted_on_source" and writes == {}
    assert merge(spark, {"alpha": DOC}, {"alpha": short}, base)[0]["r-2"] == "deleted_on_dest"
    assert merge(spark, {"beta": DOC}, {"alpha": DOC})[0] == {"r-1": "moved", "r-2": "moved"}


def test_header_edits(spark):
    source = DOC.replace("doc: alpha", "doc: alpha\ntopic: salt")
    _, writes, state, heads = merge(spark, {"alpha": source}, {"alpha": DOC}, hashes(spark, DOC))
    assert heads == {"alpha": "replace"} and writes == {"alpha": source} and "doc:alpha" in state


def test_whole_files(spark):
    import hashlib

    old = hashlib.sha256(b"v1").hexdigest()
    table = lambda d: spark.createDataFrame(list(d.items()), "name string, content string")
    base = spark.createDataFrame([("agent:kept", old), ("agent:gone", old)], "key string, hash string")
    got = notes_sync.plan_file_sync(table({"new": "hello", "kept": "v2", "gone": "v1"}), table({"kept": "v1"}), base, "agent:")
    assert rows(got, "name", "action", "content") == [("gone", "deleted_on_dest", None), ("kept", "replace", "v2"), ("new", "add", "hello")]
    both = notes_sync.plan_file_sync(table({"kept": "v2"}), table({"kept": "v3"}), base, "agent:")
    assert rows(both, "name", "action", "hash") == [("gone", None, None)][:0] + [("kept", "conflict", None)]
