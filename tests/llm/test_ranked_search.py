import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from citegraph.llm import ranked_search as rs
from tests.llm.conftest import sentences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    """The contract, row by row."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 100 - 25 + ((25 * sum(bag.values()) * n_docs) // total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda r: r[:3])[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, query string, score string").repartition(3),
        spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, rank string"),
    )


def found(spark, docs, items, **more):
    return sorted((tuple(r) for r in rs.search(*frames(spark, docs, items), **more).collect()), key=str)


AWKWARD = [
    (1, None), (2, ""), (3, " .,; "), (4, "Éa éa ÉA x"), (5, "one two three"), (5, "one two three"), (6, "one two three"), (None, "one two three"), (7, "one " * 3000), (8, "ONE-two_three"),
    (9, "two " + sentences(3, 40_000)), (10, "x" * 5000),
]


@pytest.mark.parametrize("stretch,segment", [(1024, 16 << 20), (7, 3000)])
def test_equals_brute_force(spark, monkeypatch, stretch, segment):
    monkeypatch.setattr(rs, "STRETCH_DOCS", stretch)
    monkeypatch.setattr(rs, "SEGMENT_BYTES", segment)
    docs = AWKWARD + [(100 + k, sentences(k % 150, 5 + (13 * k) % 160)) for k in range(300)]
    items = [(1, sentences(4, 30)), (1, sentences(4, 30)), (2, None), (3, "!"), (None, "one TWO two éa"), (4, "nowhere"), (5, sentences(9, 20) + " one"), (6, "ka ka ka lo mi ter")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert len(want) > 80


def test_many_blocks_of_queries_and_other_limits(spark, monkeypatch):
    monkeypatch.setattr(rs, "QUERY_BYTES", 300)
    docs = [(k, sentences(k, 30)) for k in range(60)]
    items = [(k, sentences(k, 10)) for k in range(12)]
    assert found(spark, docs, items, top=3) == brute(docs, items, top=3)


def test_nothing_to_search(spark):
    assert found(spark, [], [(1, "one")]) == found(spark, [(1, "one")], []) == found(spark, [(1, None)], [(1, "one")]) == []


def test_walk_scores_few_documents_and_loses_none():
    """A frequent word's list is looked up, not walked, once the rare words' documents lead."""
    rng = random.Random(1)
    n, top = 20_000, 5
    common = np.arange(n)
    rare = np.array(sorted(rng.sample(range(n), 60)))
    lists = [rs.Iter(common, np.array([rng.randint(1, 10) for _ in range(n)]), 10, 2), rs.Iter(rare, np.array([rng.randint(500, 900) for _ in rare]), 900)]
    plain = np.zeros(n, np.int64)
    for it in lists:
        plain[it.docs] += it.scores * it.factor
    lists[0].bound = 20
    best = rs.Best(top)
    seen = rs.walk(rs.iterators(lists, n), n, np.arange(n), np.zeros(n, bool), best)
    order = np.lexsort((np.arange(n), -plain))[:top]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == plain[order].tolist()
    assert seen < n / 2


def test_short_lists_become_one_bounded_iterator():
    lists = [rs.Iter(np.array([1, 5]), np.array([3, 4]), 4, 2), rs.Iter(np.array([5, 9]), np.array([10, 1]), 10), rs.Iter(np.arange(40), np.ones(40, int), 1)]
    its = rs.iterators(lists, 40)
    assert [(it.docs.tolist(), it.scores.tolist(), it.bound) for it in its[:1]] == [([1, 5, 9], [6, 18, 1], 18)]
    assert len(its) == 2 and its[1].bound == 1
