"""Whitening against numpy over all rows, copies included."""

import random

import numpy as np
import pytest

from sightline.llm.whitening import WhiteningParams, whitened_rows

COLUMNS = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def check(rows, vectors, k):
    """``vectors``: (vec_id, list) that remain."""
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    y = (x * n - sums).astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    expected = y @ axes / np.sqrt(values)
    got = np.zeros((n, k))
    at = {v: i for i, (v, _) in enumerate(vectors)}
    assert len(rows) == n * k
    for vec_id, component, count, deviation, whitened, explained, error in rows:
        i, j = at[vec_id], component - 1
        got[i, j] = whitened
        assert count == n and deviation == int(((x[i] * n - sums) ** 2).sum())
        assert abs(explained - values[j] / np.trace(y.T @ y / n)) <= 1e-9 and error <= 1e-9
    signs = np.sign((got * expected).sum(0))
    assert np.abs(got - expected * signs).max() < 1e-6


@pytest.mark.parametrize("d", [3, 40])
def test_against_numpy(spark, d):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(150, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    vectors = [(k, [float(c) for c in base[k % 150 if k % 3 else 0]]) for k in range(400)]
    odd = [(900, None), (901, [float("nan")] * d), (902, [None] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, [1.0]), (905, [])]
    df = spark.createDataFrame([(*v, "s", 1, 2) for v in vectors + odd], "vec_id long, embedding array<float>, x string, h int, weight int").repartition(5)
    check(rows_of(whitened_rows(df)), vectors, min(32, d))


def test_weights_of_one(spark):
    rng = random.Random(1)
    base = [[rng.random() for _ in range(3)] for _ in range(30)]
    df = spark.createDataFrame([(k, base[k if k < 30 else 0]) for k in range(60)], "vec_id long, embedding array<float>")
    rows = rows_of(whitened_rows(df, WhiteningParams(weights="one")))
    assert len(rows) == 180 and {r[2] for r in rows} == {30}
    check([r for r in rows if r[0] < 30], list(enumerate(base)), 3)


def test_ids_and_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert whitened_rows(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = rows_of(whitened_rows(spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])], schema)))
    assert len(same) == 6 and {(r[2], r[3], r[4], r[5], r[6]) for r in same} == {(3, 0, 0.0, 0.0, 0.0)}
    line = rows_of(whitened_rows(spark.createDataFrame([(k, [float(k), 0.0]) for k in range(4)], schema)))
    assert {r[5] for r in line if r[1] == 1} == {1.0} and {r[4] for r in line if r[1] == 2} == {0.0}
    huge = rows_of(whitened_rows(spark.createDataFrame([(1, [3e38, 1.0]), (2, [0.0, 2.0]), (3, [-3e38, 3.5])], schema)))
    assert len(huge) == 6 and all(r[3] is None for r in huge if r[0] != 2)
