import zlib

import numpy as np
import public_tokenizers
import pytest

from citegraph.llm import packing as pk
from tests.llm.conftest import sentences

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(rows, texts):
    """Each id lies in one piece with its checksum; windows are gapless and at most full."""
    by_window = {}
    for r in rows:
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= pk.WINDOW
    want = sorted((i if i is not None else -1, ids_of(t).tobytes()) for i, t in texts)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"] if r["doc_id"] is not None else -1), []).append(r)
    for i, code in want:
        ids = np.frombuffer(code, "<u4")
        own = [r for r in by_doc[i] if r["doc_tokens"] == len(ids)]
        spans = sorted({(r["start"], r["length"]) for r in own if zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]})
        assert sum(n for _, n in spans) >= len(ids)
    assert sum(r["length"] for r in rows) == sum(len(code) // 4 for _, code in want)
    return len(by_window)


def test_awkward_texts(docs, no_docs):
    check(pk.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert pk.pack(no_docs, PATH).collect() == []


def test_little_padding(spark):
    texts = [(k, sentences(k, 20 + (37 * k) % 400)) for k in range(400)]
    rows = pk.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect()
    windows = check(rows, texts)
    assert sum(r["length"] for r in rows) > 0.9 * windows * pk.WINDOW


def test_one_fixed_window_and_a_larger_pool(spark):
    """Rows without an id lend their rests to the pool: its windows come after window 0, not over it."""
    texts = [(k, sentences(k, 30)) for k in range(12)] + [(None, sentences(500 + k, 1500)) for k in range(6)]
    rows = pk.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect()
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))
    assert sum(n for _, _, n in spans) == sum(len(ids_of(t)) for _, t in texts)
    assert {s for s, _, _ in spans} == set(range(spans[-1][0] + 1)) and spans[-1][0] > 0


@pytest.mark.parametrize(
    "text",
    ["", "Plain words, and more.", "ÉÀ Über straße I'll don't <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "tab\there nbsp　wide", "é combining Å x≠y ≠", "№ ½ Σίσυφος İstanbul ſ K 日本語 😀👍🏽", "a.b,c;d--e!!! ***x*** 12 3.14 'tis rock'n'roll", "\x00 \x1f \x85  ", "x" * 5000],
)
def test_ids_are_the_tokenizers(text):
    import pyarrow as pa

    ids, at = pk.WordIds(PATH).encode(pa.array([text, "next", text.upper()], pa.large_string()))
    for k, t in enumerate((text, "next", text.upper())):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(t)[:-1].tolist()


def test_strategies_and_counts():
    table = pk.strategies()
    assert (table @ np.arange(pk.BINS + 1) == pk.BINS).all()
    h = np.zeros(pk.BINS + 1)
    h[100], h[28], h[64], h[128] = 50, 50, 80, 7
    counts = pk.solve_counts(table, h)
    assert (counts @ table <= h).all() and (counts @ table).sum() >= 0.9 * h.sum()
    ranges = pk.plan(h)
    for b in np.flatnonzero(h):
        spans = sorted((lo, hi) for x, lo, hi, *_ in ranges if x == b)
        assert spans[0][0] == 0 and spans[-1][1] == h[b] and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
