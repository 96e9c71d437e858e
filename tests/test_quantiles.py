import random

import numpy as np
import pytest

from sightline.operators.quantiles import exact_quantiles

WANTED = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("hot", [False, True])
def test_against_numpy(spark, hot):
    rng = random.Random(4)
    rows = [(rng.randrange(3), 5.5 if hot and rng.random() < 0.5 else rng.expovariate(0.01)) for _ in range(3000)] + [(7, 1.0), (8, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    clean = [(g, v) for g, v in rows if v is not None and v == v]
    for by, groups in ((("g",), {g: [v for h, v in clean if h == g] for g in {g for g, _ in clean}}), ((), {None: [v for _, v in clean]})):
        found = exact_quantiles(df, "v", WANTED, by).collect()
        assert len(found) == len(groups)
        for r in found:
            values = groups[r["g"] if by else None]
            assert [r[n] for n in WANTED] == pytest.approx([float(np.quantile(values, p)) for p in WANTED.values()], rel=1e-12)


def test_nothing(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert exact_quantiles(df, "v", WANTED, ("g",)).count() == 0
    assert [tuple(r) for r in exact_quantiles(df, "v", WANTED).collect()] == [(None,) * 5]
