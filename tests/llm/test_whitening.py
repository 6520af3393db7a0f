from fractions import Fraction

import numpy as np
import pytest

from citegraph.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, k=wh.COMPONENTS):
    """Covariance by exact fractions, then eigh; (V, eigenvalues, components, deviations) of lists of x."""
    n, d = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(d)]
    u = [[n * v[i] - sums[i] for i in range(d)] for v in vectors]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in u), n**3)) for j in range(d)] for i in range(d)])
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    white = (np.array(u, float) / n) @ directions[:, order] / np.sqrt(values[order])
    return cov, values[order], white, [sum(c * c for c in r) for r in u]


def as_x(vector):
    return [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in vector]


@pytest.mark.parametrize("scale", [0.3, 40.0])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 7)) @ rng.normal(size=(7, 7)) * scale
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(500, vectors[3][1]), (500, vectors[3][1]), (None, vectors[4][1])]
    broken = [(600, None), (601, [None] + [0.1] * 6), (602, [float("nan")] * 7), (603, [float("inf")] + [0.0] * 6), (604, []), (605, [1.0] * 5), (606, [3e38] + [0.0] * 6)]
    rows = wh.whiten(frame(spark, vectors + broken)).collect()
    assert len(rows) == len(vectors) * 7
    cov, values, white, deviation = brute([as_x(v) for _, v in vectors])
    assert {r["n"] for r in rows} == {len(vectors)} and {r["component"] for r in rows} == set(range(1, 8))
    for r in rows:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-9
    by_id = {}
    for r in rows:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(by_id[500, 1]) == 2 and len(by_id[None, 1]) == 1
    for k in range(7):
        mine = np.array([by_id[i, k + 1][0]["whitened"] for i, _ in vectors])
        sign = np.sign(mine[0] * white[0, k])
        assert np.allclose(mine * sign, white[:, k], atol=1e-8)
        assert [int(by_id[i, k + 1][0]["deviation"]) for i, _ in vectors] == deviation


def test_pairs_of_squares_are_exact_beyond_64_bits(spark):
    vectors = [(0, [1e12, -3.0, 2.5]), (1, [-2e12, 1.25, 0.0]), (2, [5.0, 7.0, -1e12]), (3, [0.0, 0.0, 0.0])]
    df = frame(spark, vectors)
    x = [as_x(v) for _, v in vectors]
    n, sums = wh.totals(df.select("embedding"))
    assert (n, sums) == (4, [sum(c) for c in zip(*x)])
    square, rest = wh.squares(df.select("embedding"), n, sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    y = [[a - b for a, b in zip(v, centre)] for v in x]
    assert square == {(i, j): sum((v[i] + (v[j] if i != j else 0)) ** 2 for v in y) for i in range(3) for j in range(i, 3)}
    assert rest == [sum(c) for c in zip(*y)]
    cov = wh.covariance(n, square, rest)
    assert cov == pytest.approx(brute(x)[0], rel=1e-15)
    assert len(wh.whiten(df).collect()) == 4 * 2  # the third eigenvalue is below rounding; nothing overflows


def test_no_rows_one_row_equal_rows_and_a_flat_dimension(spark):
    assert wh.whiten(frame(spark, [])).collect() == []
    assert wh.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert wh.whiten(frame(spark, [(1, [0.5, 0.25])])).collect() == []
    assert wh.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(5)])).collect() == []
    rows = wh.whiten(frame(spark, [(i, [i / 4, 0.25]) for i in range(5)])).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 5 and rows[0]["explained"] == 1.0


def test_at_most_the_asked_components(spark):
    rng = np.random.default_rng(2)
    rows = wh.whiten(frame(spark, [(i, rng.normal(size=40).tolist()) for i in range(200)])).collect()
    assert {r["component"] for r in rows} == set(range(1, 33))
    first = sorted((r["component"], r["explained"]) for r in rows if r["vec_id"] == 0)
    assert [e for _, e in first] == sorted((e for _, e in first), reverse=True)
