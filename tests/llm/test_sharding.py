import zlib
from collections import Counter, defaultdict

from citegraph.llm import sharding
from tests.llm.conftest import sentences


def check(rows, frame):
    given = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == given
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 8 and r["grown_shard"] is None
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_sizes_are_even_and_copies_stay_together(spark):
    rows = [(k, sentences(k, 20 + k % 60)) for k in range(1500)]
    rows += [(2000 + 10 * g + k, sentences(5000 + g, 40)) for g in range(80) for k in range(2 + g % 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(frame).collect()
    sizes = check(out, frame)
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 8 and len(sizes) == 8
    groups = defaultdict(list)
    for r in out:
        groups[r["text_crc32"]].append(r["shard"])
    linked = [g for g in groups.values() if len(g) > 1]
    assert sum(len(set(g)) == 1 for g in linked) >= 0.9 * len(linked)


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    same = sentences(1, 50)
    frame = spark.createDataFrame([(k, same if k % 3 == 0 else sentences(k, 50)) for k in range(900)], "doc_id long, text string")
    sizes = check(sharding.shard(frame).collect(), frame)
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 8


def test_awkward_rows(docs, no_docs):
    check(sharding.shard(docs).collect(), docs)
    assert sharding.shard(no_docs).collect() == []
