"""Components by contraction and ranks by ranges against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import glm, graph, raster


def roots(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_connected(spark):
    rng = random.Random(1)
    path = list(range(3000))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(5000, 5000 + i) for i in range(1, 400)] + [(6000 + rng.randrange(300), 6000 + rng.randrange(300)) for _ in range(250)] + [(9000, 9000), (9001, None), (1, 2), (2, 1)]
    got = {r.id: r.root for r in graph.connected(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == roots(links)
    assert graph.connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        graph.connected(spark.createDataFrame(links, "a long, b long"), rounds=2)


def picture(spark, pictures):
    return spark.createDataFrame([(name, y, x, bool(v)) for name, rows in pictures.items() for y, row in enumerate(rows) for x, v in enumerate(row)], "image string, y int, x int, in boolean").repartition(5)


@pytest.mark.parametrize("neighbours", [raster.EIGHT, raster.FOUR])
def test_components_of_pictures(spark, neighbours):
    rng = np.random.default_rng(2)
    spiral = np.zeros((61, 61), bool)
    y = x = 30
    for turn in range(60):
        dy, dx = [(0, 1), (1, 0), (0, -1), (-1, 0)][turn % 4]
        for _ in range((turn // 2 + 1) * 1 + (turn // 2 + 1)):
            if 0 <= y < 61 and 0 <= x < 61:
                spiral[y, x] = True
            y, x = y + dy, x + dx
    pictures = {"spiral": spiral, "board": np.indices((12, 13)).sum(0) % 2 == 0, "empty": np.zeros((3, 3), bool), "full": np.ones((4, 9), bool)} | {f"r{p}": rng.random((25, 31)) < p for p in (0.2, 0.4, 0.6)}
    links = [((n, (i, j)), (n, (i + dy, j + dx))) for n, m in pictures.items() for i, j in zip(*np.nonzero(m)) for dy, dx in neighbours if 0 <= i + dy < m.shape[0] and 0 <= j + dx < m.shape[1] and m[i + dy, j + dx]]
    want = roots(links)
    got = raster.components(picture(spark, pictures), neighbours).collect()
    assert len(got) == sum(m.size for m in pictures.values())
    for r in got:
        here = (r.image, (r.y, r.x))
        own = want.get(here, here)[1]
        assert r.component == (own[0] * 2**32 + own[1] if pictures[r.image][r.y, r.x] else None)


def test_five_thousand_turns(spark):
    """A path that goes down 10,001 rows, to and fro, is one component, found in few rounds."""
    rows = [("s", y, x, True) for y in range(10_001) for x in ([0, 1, 2] if y % 2 == 0 else [2 if y % 4 == 1 else 0])]
    found = raster.components(spark.createDataFrame(rows, "image string, y int, x int, in boolean"))
    assert [r.component for r in found.select("component").distinct().collect()] == [0]


def q_values(ps):
    order, q = np.argsort(ps, kind="stable"), np.ones(len(ps))
    q[order] = np.minimum.accumulate((np.array(ps)[order] * len(ps) / np.arange(1, len(ps) + 1))[::-1])[::-1]
    return np.minimum(q, 1)


def test_false_discovery_of_large_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"large": rng.random(5000) ** 2, "ties": rng.choice([0.001, 0.02, 1.0], 3000), None: rng.random(50), "one": np.array([0.04])}
    rows = [(g, i, float(p)) for g, ps in groups.items() for i, p in enumerate(ps)] + [("large", -1, None), ("one", -2, float("nan"))]
    df = spark.createDataFrame(rows, "`the group` string, i long, p double").withColumns({c: F.lit(2.0) for c in ("q", "rank", "range", "by", "a.b", "value")})
    for key in (["i"], []):
        got = glm.false_discovery(df, by=["the group"], key=key).collect()
        assert len(got) == len(rows)
        by = {(r["the group"], r.i): r for r in got}
        for g, ps in groups.items():
            for i, q in enumerate(q_values(ps)):
                assert abs(by[g, i].q - q) < 1e-12 and by[g, i].significant == (q <= 0.05)
        assert by["large", -1].q is None and by["one", -2].q is None and not by["large", -1].significant
    assert glm.false_discovery(df.limit(0)).count() == 0


def test_a_group_is_ranked_by_many_tasks(spark, monkeypatch):
    from brightloom.operators import ranks

    seen = {}
    monkeypatch.setattr(ranks, "stored", lambda df, name: seen.setdefault(name, df))
    df = spark.range(20_000).withColumn("p", F.lit(0.5))
    ranks.step_up(df, F.col("p"), [], [F.col("id")])
    n = [r["count"] for r in seen["ranges"].groupBy("range").count().collect()]
    assert len(n) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(n) < 2 * min(n)


def test_a_continuous_target_needs_no_family(spark):
    rng = random.Random(4)
    rows = [(i % 20, float(i), 2.0 * i + rng.random()) for i in range(200)]
    found = glm.feature_association(spark.createDataFrame(rows, "bag long, x double, y double"), ["y"], ["x"], "bag").collect()
    assert len(found) == 1 and abs(found[0].coef - 2) < 0.01 and found[0].family == "gaussian"
