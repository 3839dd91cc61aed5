"""Index quantiles against sorted lists, on groups with ties, hot groups and single rows."""

from __future__ import annotations

import random

import pytest

from heddle.operators import stats


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("rounding", ["round", "floor"])
def test_index_quantile(spark, q, rounding):
    rng = random.Random(int(q * 100))
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(rng.randint(0, 2))) for _ in range(999)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("hot", None), ("none", None)]
    got = stats.index_quantile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", q, rounding).collect()
    want = {}
    for key in ("hot", "ties", "one", None):
        values = sorted(v for k, v in rows if k == key and v is not None)
        at = (len(values) - 1) * q
        want[key] = values[round(at) if rounding == "round" else int(at)]
    assert {r["k"]: r["quantile"] for r in got} == want


def test_a_sketch_that_misses(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET", 0.0000001)
    monkeypatch.setattr(stats.F, "percentile_approx", lambda c, p, a: stats.F.array(stats.F.lit(10**6), stats.F.lit(10**6 + 1)))
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(101)], "k string, v long")
    assert sorted(map(tuple, stats.index_quantile(df, ["k"], "v", 0.5, "round").collect())) == [("a", 50), ("b", 50)]
