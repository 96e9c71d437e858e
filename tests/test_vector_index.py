"""Searches in blocks and through inverted lists, against scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators.vector_index import IndexParams, SearchParams, build_index, nearest, search_index

SCHEMA = "unit_id long, video long, unit_type string, embedding array<float>"


def data(n, d=8, clusters=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    v = centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, d))
    v[n // 2 : n // 2 + n // 3] = v[0]  # a third of all are copies
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    return [(k, int(k % 17), ("summary", "speech", "visual")[k % 3], [float(x) for x in v[k]]) for k in range(n)]


def expected(rows, k, per_video=False, weights=()):
    v = np.array([r[3] for r in rows], np.float32).astype(float)
    out, w = [], dict(weights)
    for q in range(0, len(rows), 50):
        scores = [(math.floor(min(max(float(v[q] @ v[i]), 0), 1) * 1e5 + 0.5) / 1e5, r) for i, r in enumerate(rows) if i != q]
        if w:
            scores = [(math.floor(s * w[r[2]] * 1e6 + 0.5) / 1e6, r) for s, r in scores]
        if per_video:
            best = {}
            for s, r in sorted(scores, key=lambda x: (-x[0], x[1][0])):
                best.setdefault(r[1], (s, r))
            order = sorted(best.values(), key=lambda x: (-x[0], x[1][1]))
        else:
            order = sorted(scores, key=lambda x: (-x[0], x[1][0]))
        out += [(q, r[0], place) for place, (_, r) in enumerate(order[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.unit_id, r.place) for r in df.collect())


def tables(spark, rows):
    units = spark.createDataFrame([*rows, (10**6, 1, "speech", None)], SCHEMA).repartition(3)
    return units, units.filter("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), "embedding")


@pytest.mark.parametrize(("chunk", "block"), [(32_768, 16_384), (100, 4)])
def test_blocks(spark, chunk, block):
    rows = data(700)
    units, queries = tables(spark, rows)
    assert got(nearest(units, queries, SearchParams(k=7, chunk=chunk, block=block))) == expected(rows, 7)
    weights = (("speech", 1.0), ("summary", 0.9), ("visual", 0.8))
    assert got(nearest(units, queries, SearchParams(k=5, per_video=True, weights=weights, chunk=chunk, block=block))) == expected(rows, 5, True, weights)
    assert nearest(units.limit(0), queries).count() == 0 and nearest(units, queries.limit(0)).count() == 0
    plan = nearest(units, queries)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index(spark, tmp_path):
    rows = data(2000)
    units, queries = tables(spark, rows)
    index = build_index(units, str(tmp_path / "i"), IndexParams(lists=40, sample=500))
    assert index.lists.count() == 2000 and index.lists.select("list").distinct().count() > 5
    exact = set(expected(rows, 10))
    assert set(got(search_index(index, queries, SearchParams(chunk=300, block=3), 4, exact=True))) == exact
    found = {x[:2] for x in got(search_index(index, queries, SearchParams(), 8))}
    least = {}
    for r in nearest(units, queries).collect():
        least[r.query_id] = min(least.get(r.query_id, 2), r.score)
    scores = {(r.query_id, r.unit_id): r.score for r in search_index(index, queries, SearchParams(), 8).collect()}
    recall = sum(scores[x] >= least[x[0]] for x in found) / len(exact)
    assert recall >= 0.9


def test_index_of_nothing(spark, tmp_path):
    units, queries = tables(spark, [])
    index = build_index(units.limit(0), str(tmp_path / "i"))
    assert search_index(index, queries.limit(0), SearchParams(), 8, exact=True).count() == 0


def test_memory_of_a_full_group():
    """A full chunk of units and many queries: a worker holds one part's scores, not several copies (F2, F3, F4)."""
    import tracemalloc

    import pyarrow as pa

    from sightline.operators.vector_index import _best

    rng, p = np.random.default_rng(4), SearchParams(k=100)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 16)).astype(np.float32)), pa.list_(pa.float32()))
    units = pa.table({"unit_id": pa.array(range(p.chunk)), "video": pa.array([k % 9 for k in range(p.chunk)]), "unit_type": pa.array(["x"] * p.chunk), "embedding": vectors(p.chunk)})
    asked = pa.table({"query_id": pa.array(range(0, 40_000, 40)), "query": vectors(1_000)})
    tracemalloc.start()
    found = _best(p)(asked, units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 100_000 and peak < 60e6
