import random
import time

import pytest
from pyspark.sql import functions as F

from citegraph.functions import intervals, ranking, scans
from citegraph.functions.columns import char_runs
from citegraph.session import broadcast_if_small, measure
from tests.helpers import rows


@pytest.fixture(scope="module")
def positions(spark):
    """One hot document and some small ones; positions are dense but for a hole."""
    rng = random.Random(3)
    data = [("hot", p, rng.choice([0, 1, None])) for p in range(1, 101) if p != 40] + [(f"d{d}", p, 1) for d in range(3) for p in range(1, 4)]
    return data, spark.createDataFrame(data, "doc string, page int, x int")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_sum_across_blocks(positions, block):
    data, df = positions
    got = {(r["doc"], r["page"]): r["s"] for r in scans.running_sum(df, "doc", "page", F.col("x"), "s", block).collect()}
    want, total = {}, {}
    for doc, page, x in sorted(data, key=lambda r: (r[0], r[1])):
        total[doc] = total.get(doc, 0) + (x or 0)
        want[doc, page] = total[doc]
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_carry_last_across_blocks(positions, block):
    data, df = positions
    marked = F.when(F.col("x") == 1, F.col("page"))
    got = {(r["doc"], r["page"]): r["c"] for r in scans.carry_last(df, "doc", "page", marked, "c", block).collect()}
    want, seen = {}, {}
    for doc, page, x in sorted(data, key=lambda r: (r[0], r[1])):
        if x == 1:
            seen[doc] = page
        want[doc, page] = seen.get(doc)
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_previous_row_across_blocks(positions, block):
    data, df = positions
    got = {(r["doc"], r["page"]): r["prev_x"] for r in scans.previous_row(df, "doc", "page", ["x"], block).collect()}
    have = {(d, p): x for d, p, x in data}
    assert got == {(d, p): have.get((d, p - 1)) for d, p, _ in data}


def test_order_rows_of_a_hot_key(spark):
    rng = random.Random(5)
    data = [("hot", rng.random(), n) for n in range(500)] + [(f"k{n % 7}", rng.random(), n) for n in range(100)]
    df = spark.createDataFrame(data, "k string, o double, n int").repartition(6)
    got = {(r["k"], r["n"]): r["at"] for r in ranking.order_rows(df, ["k"], ["o", "n"], "at").collect()}
    want, seen = {}, {}
    for k, _, n in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        want[k, n] = seen[k]
    assert got == want


def test_smallest_rows_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 5)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert rows(ranking.smallest_rows(df, ["id"], 40)) == sorted(((n,) for n in range(40)), key=str)


def test_best_row_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.best_row(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("width", [1, 5, 64])
def test_overlap_join_matches_brute_force(spark, width):
    rng = random.Random(11)
    spans = lambda n, tag: [(tag + str(i), rng.choice("ab"), a, a + rng.randrange(-1, 20)) for i in range(n) for a in [rng.randrange(60)]]
    left, right = spans(30, "l"), spans(30, "r")
    got = intervals.overlap_join(
        spark.createDataFrame(left, "l string, k string, ls int, le int"), spark.createDataFrame(right, "r string, k string, rs int, re int"),
        "k", ("ls", "le"), ("rs", "re"), width,
    )
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and a[3] >= b[2])
    assert rows(got, "l", "r") == want


def test_broadcast_needs_a_small_measure(spark):
    df = spark.createDataFrame([("abc",), ("d",)], "t string")
    n, size = measure(df, "t")
    assert n == 2 and size >= 4
    hinted = lambda s: "ResolvedHint" in broadcast_if_small(df, s)._jdf.queryExecution().analyzed().toString()
    assert hinted(size) and not hinted(10**12)


def test_char_runs(spark):
    texts = ["", "ab", "abc", "a\n😀b\n😀b", "😀😀b", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", char_runs("t", 3).alias("r")).collect()
    want = lambda t: list(dict.fromkeys(t[k : k + 3] for k in range(len(t) - 2)))
    assert {r["i"]: r["r"] for r in got} == {i: want(t or "") for i, t in enumerate(texts)}


def test_char_runs_take_no_square_of_the_text(spark):
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: i.cast("string")), " ").alias("t"))
    began = time.time()
    assert long.select(F.size(char_runs("t", 3))).first()[0] == 1288
    assert time.time() - began < 20
