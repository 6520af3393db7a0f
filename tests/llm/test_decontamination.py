import random
import re

import numpy as np

from citegraph.llm import decontamination as dc
from tests.llm.conftest import sentences


def tiles(a, b, least):
    """Greedy string tiling by looking at all pairs of positions."""
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, at = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best:
                    at.append((i, j))
        if best < least:
            return covered
        for i, j in at:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = [True] * best
                used_b[j : j + best] = [True] * best
                covered += best


def test_tiling_matches_the_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, n))] for n in (40, 30))
        assert sum(t[2] for t in dc.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)) == tiles(a, b, 3)


def test_leaks_match_tiling_of_all_pairs(spark):
    items = [(k, sentences(200 + k, 30)) for k in range(4)] + [(7, "too short"), (8, None), (9, sentences(200, 30))]
    words = [sentences(200 + k, 30).split() for k in range(4)]
    texts = {
        0: sentences(1, 50) + " " + items[0][1], 1: " ".join(words[1][15:] + ["gap"] + words[1][:15]), 2: " ".join(words[2][:10]), 3: " ".join(words[3][:16]) + " x " + sentences(3, 20),
        4: sentences(4, 60), 5: None, 6: "", 7: items[0][1].upper(),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["covered"]) for r in dc.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = []
    for d, t in texts.items():
        for i, s in items:
            covered = tiles(split(t), split(s), 5)
            if split(s) and covered >= 0.5 * len(split(s)):
                want.append((d, i, covered))
    assert got == sorted(want)
    assert {(0, 0), (1, 1), (3, 3), (7, 0), (7, 9)} <= {x[:2] for x in got}


def test_awkward_rows(spark, docs, no_docs):
    items = spark.createDataFrame([(1, sentences(8, 60)), (1, sentences(8, 60))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()} == {(16, 1), (17, 1)}
    kept = dc.drop_leaked(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, none).collect() == [] and dc.leaks(no_docs, items).collect() == []


def test_rows_go_by_row_whatever_the_ids(spark):
    passage = sentences(8, 60)
    rows = [(None, passage), (None, sentences(1, 60)), (1, passage), (1, passage), (1, sentences(2, 60)), (2, sentences(3, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dc.drop_leaked(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
