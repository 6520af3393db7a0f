import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.operators import semantic
from tests.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    data = [(k, [float(c) for c in middles[k % 12] + rng.normal(size=16) * 0.5]) for k in range(600)]
    data += [(700, data[5][1]), (701, data[5][1])]  # copies
    return data


def brute(vectors, queries, top):
    v = {i: np.array(x, np.float32).astype(float) for i, x in vectors}
    out = {}
    for i, q in queries:
        q = np.array(q, np.float32).astype(float)
        scored = sorted((-float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)), j) for j, x in v.items() if j != i)
        out[i] = [j for _, j in scored[:top]]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1) for i, v in data], SCHEMA).repartition(3)


def test_recall_and_exact_search(spark, vectors, monkeypatch):
    monkeypatch.setattr(semantic, "SALT_ROWS", 20)
    odd = [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [1.0] * 5), (805, [None] * 16)]
    cells = semantic.build(frame(spark, vectors + odd))
    queries = [(i, v) for i, v in vectors if i % 20 == 0 or i == 5]
    want = brute(vectors, queries, 10)
    got = {}
    for exact in (False, True):
        found = {}
        for r in semantic.nearest(cells, frame(spark, queries + odd[:2]), probes=6, exact=exact).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["id"])
        got[exact] = found
    hits = sum(len(set(got[False][i]) & set(want[i])) for i in want)
    assert hits >= 0.9 * 10 * len(want)
    assert got[True] == want and got[True][5][:2] == [700, 701]


def test_no_rows_and_few_rows(spark, vectors):
    none = semantic.build(frame(spark, []))
    assert semantic.nearest(none, frame(spark, vectors[:3])).collect() == []
    few = semantic.build(frame(spark, vectors[:3]))
    assert len(rows(semantic.nearest(few, frame(spark, vectors[:3]), exact=True))) == 6
    assert semantic.nearest(few, frame(spark, []).where(F.lit(True))).collect() == []
