"""Exact order statistics against NumPy, with bins so small that every step is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import quantiles, scale, summary


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.integers(0, 50, 400).astype(float),
        "one value": np.full(300, 7.5),
        "far apart": np.concatenate([10.0 ** rng.integers(-300, 300, 150), -(10.0 ** rng.integers(-300, 300, 149)), np.zeros(50)]),
        "neighbours": 1 + np.arange(100) * 2.0**-52,
        "tiny": np.arange(1, 90) * 5e-324,
        "mostly one": np.concatenate([np.full(5000, 3.25), rng.normal(size=40)]),
        "few": np.array([2.0, 1.0]),
        "single": np.array([-1.0]),
    }
    rows = [(g, float(x), float(-x)) for g, v in groups.items() for x in v] + [("even", None, float("nan")), (None, 1.0, 1.0), ("nothing", None, float("nan"))]
    df = spark.createDataFrame(rows, "`a.g` string, x double, y double").repartition(7).withColumns({c: F.lit(1) for c in ("c", "v", "k0", "lo", "n", "size", "rank")})
    qs = (0.0, 0.05, 0.25, 0.5, 0.75, 1.0)
    wanted = [(f"x{q}", "x", q) for q in qs] + [("y1", "y", 0.1)]
    for few in (1, 16, quantiles.FEW):
        got = {r[0]: r[1:] for r in quantiles.quantiles(df, ["a.g"], wanted, few).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            assert np.allclose(got[g], [*np.quantile(v, qs), np.quantile(-v, 0.1)], rtol=1e-14, atol=0), g
        every = np.concatenate(list(groups.values()) + [[1.0]])
        whole = quantiles.quantiles(df, [], wanted, few).collect()
        assert len(whole) == 1 and np.allclose(whole[0], [*np.quantile(every, qs), np.quantile(-every, 0.1)], rtol=1e-14, atol=0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double, y long")
    assert quantiles.quantiles(df, ["g"], [("m", "x", 0.5)]).count() == 0
    assert quantiles.quantiles(df, [], [("m", "x", 0.5), ("n", "y", 0.1)]).collect() == [(None, None)]
    some = spark.createDataFrame([("a", None, 3), ("a", None, 4), ("b", None, None)], df.schema)
    assert [tuple(r) for r in quantiles.medians(some, ["g"], ["x", "y"]).collect()] == [("a", None, 3.5)]
    assert sorted(tuple(r) for r in summary.group_summary(some, ["g"], ["y"]).collect()) == [("a", 2, 3.5, 3.5, 0.5**0.5), ("b", 0, None, None, None)]
    assert scale.impute_median(some, ["y"]).select("y").collect() == [(3.0,), (4.0,), (3.5,)]


def test_no_task_sorts_a_group(spark, monkeypatch):
    """Bins that are sorted have few rows even where one group has all, and the counts of a round are bounded by its bins."""
    sorted_rows = []
    pick = quantiles._pick

    def watched(wanted, counted, on, order):
        sorted_rows.append((order, counted.groupBy(*on).count().agg(F.max("count")).first()[0] or 0))
        return pick(wanted, counted, on, order)

    monkeypatch.setattr(quantiles, "_pick", watched)
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.rand(3) * 1e6).alias("x"))
    got = quantiles.quantiles(df, ["g"], [("q1", "x", 0.25), ("m", "x", 0.5)], few=500).first()
    assert np.allclose([got.q1, got.m], np.quantile([r.x for r in df.collect()], (0.25, 0.5)))
    assert {o for o, _ in sorted_rows} == {"bin", "v"}
    assert all(n <= 500 for o, n in sorted_rows if o == "v") and all(n <= 4096 for o, n in sorted_rows if o == "bin")


@pytest.mark.parametrize("values", [[0.0, -0.0, 1e308, -1e308], [float("inf"), float("-inf"), 0.0, 1.0, 5.0]])
def test_extreme_values(spark, values):
    rows = [(v,) for v in values * 30]
    got = quantiles.quantiles(spark.createDataFrame(rows, "x double"), [], [("lo", "x", 0.0), ("hi", "x", 1.0), ("m", "x", 0.5)], few=2).first()
    assert tuple(got) == (min(values), max(values), float(np.quantile([v for v in values * 30 if abs(v) < 1e300] + [1.0] * 0, 0.5)) if 1.0 in values else 0.0)
