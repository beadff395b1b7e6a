"""Neighbour graphs and layouts against brute force and measures of quality."""

import math

import numpy as np
from pyspark.sql import functions as F

from brightloom.operators import neighbours


def squares(x):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return d


def trustworthiness(x, y, k=15):
    """1, less a penalty for each of a row's k neighbours in y by how far down it is among its neighbours in x."""
    n, ranks = len(x), np.argsort(np.argsort(squares(x), 1), 1)
    beside = np.argsort(squares(y), 1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(ranks, beside, 1) - k + 1, 0).sum()


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "key long, vec array<float>").repartition(5)


def recall(spark, df, k):
    rows = df.collect()
    ids, x = [r.key for r in rows], np.array([r.vec for r in rows], np.float64)
    d, got = np.sqrt(squares(x)), {}
    for r in neighbours.nearest(df, "key", "vec", k).collect():
        got.setdefault(r.id, []).append(r)
    hits = asked = 0
    for i, key in enumerate(ids):
        own = sorted(got[key], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, k + 1)) and len({r.other for r in own} | {key}) == k + 1
        assert all(abs(d[i, ids.index(r.other)] - r.distance) < 1e-3 for r in own)
        if key % 50 == 0:
            asked, hits = asked + k, hits + sum(r.distance <= np.partition(d[i], k - 1)[k - 1] + 1e-6 for r in own)
    return hits / asked


def test_recall(spark):
    rng = np.random.default_rng(1)
    assert recall(spark, frame(spark, rng.normal(size=(1200, 32))), 10) >= 0.95
    copies = np.concatenate([np.ones((300, 5)), rng.normal(size=(300, 5))])
    assert recall(spark, frame(spark, copies), 5) >= 0.95


def test_layout_keeps_neighbours(spark):
    rng = np.random.default_rng(2)
    t = rng.random(700) * 9 + 3
    roll = np.stack([t * np.cos(t), rng.random(700) * 20, t * np.sin(t)], 1)
    got = {r.id: (r.x, r.y) for r in neighbours.plane(frame(spark, roll), "key", "vec").collect()}
    assert set(got) == set(range(700))
    y = np.array([got[i] for i in range(700)])
    flat = np.linalg.svd(roll - roll.mean(0), full_matrices=False)
    assert trustworthiness(roll, y) > 0.97 > trustworthiness(roll, (flat[0] * flat[1])[:, :2])


def test_awkward_rows(spark):
    rows = [(0, [0.0, 1.0]), (1, [1.0, 1.0, 2.0]), (2, None), (None, [1.0]), (3, [float("nan"), 1.0]), (4, [None]), (5, []), (5, [9.0]), (6, [0.0, 1.0]), (7, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "key long, vec array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "a.b", "fresh")})
    got = neighbours.nearest(df, "key", "vec", 15).collect()
    assert {r.id for r in got} == {0, 1, 5, 6, 7} and len(got) == 20
    assert min(got, key=lambda r: (r.distance, r.id))[:2] == (0, 6)
    for init in ("pca", "random"):
        places = neighbours.plane(df, "key", "vec", init=init).collect()
        assert {r.id for r in places} == {0, 1, 5, 6, 7} and all(math.isfinite(r.x + r.y) for r in places)
    for few in (df.limit(0), df.where("key = 0"), df.where("key < 2")):
        n = few.count()
        assert neighbours.nearest(few, "key", "vec").count() == n * (n - 1) and neighbours.plane(few, "key", "vec").count() == n


def test_bandwidths_and_curve():
    rng = np.random.default_rng(3)
    d = np.sort(rng.random((50, 15)) * 10, 1)
    d[0], d[1, 5:], d[2, :3] = 4.0, np.nan, 0.0
    least, width = neighbours.bandwidths(d)
    assert least[0] == 4.0 and least[2] > 0
    for i in range(3, 50):
        assert least[i] == d[i, 0] and abs(np.exp(-(d[i] - d[i, 0]) / width[i]).sum() - math.log2(15)) < 1e-6
    a, b = neighbours.curve()
    assert abs(a - 1.577) < 2e-3 and abs(b - 0.895) < 2e-3  # the published constants for a least distance of 0.1


def test_weights_of_both_directions(spark):
    rows = [(1, 2, 1.0, 1), (1, 3, 2.0, 2), (2, 1, 1.0, 1), (2, 3, 5.0, 2), (3, 1, 2.0, 1)]
    got = {(r.id, r.other): r.weight for r in neighbours.weights(spark.createDataFrame(rows, "id long, other long, distance double, rank int")).collect()}
    assert len(got) == 6 and all(abs(got[a, b] - got[b, a]) < 1e-12 and 0 < w <= 1 for (a, b), w in got.items())
    assert got[1, 2] == 1.0 and got[1, 3] == 1.0 and got[2, 3] < 0.5
