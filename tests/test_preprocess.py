"""Bars, boxes, crops and dominant components against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import overlays, preprocess, raster
from brightloom.operators.filters import ContractError


def pixels(spark, pictures, value="v", kind="int"):
    cast = int if kind == "int" else bool
    return spark.createDataFrame([(n, y, x, cast(v)) for n, m in pictures.items() for y, row in enumerate(m) for x, v in enumerate(row)], f"image string, y int, x int, `{value}` {kind}").repartition(6)


def bar_of(m):
    most = int(min(len(m) * 0.30, 220))
    if most <= 4:
        return 0
    dark, means, end = (m[:most] < 55).mean(1), m[:most].mean(1), 0
    for i in range(most):
        if dark[i] >= 0.70:
            end = i + 1
        elif end >= 8:
            break
    steps = np.abs(np.diff(means))
    peak = int(np.argmax(steps)) + 1
    return min(max(end, peak) if 6 <= peak <= most - 2 and dark[:peak].mean() >= 0.55 else end, most)


def lines(m, f):
    return np.stack([f(c) for c in np.stack([f(r) for r in m]).T]).T


def blur(m, radius, deviation):
    k = np.exp(-np.square(np.arange(-radius, radius + 1)) / (2 * deviation**2))
    return np.floor(np.round(lines(m, lambda v: np.convolve(np.pad(v, radius, mode="reflect"), k / k.sum(), "valid")), 6) + 0.5)


def square(m, radius, of):
    h, w = m.shape
    return np.array([[of(m[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]) for x in range(w)] for y in range(h)])


def parts(m):
    """Components in the order of their first pixels, through eight neighbours."""
    left, out = set(map(tuple, np.argwhere(m).tolist())), []
    for start in sorted(left):
        if start in left:
            todo, own = [start], []
            left.discard(start)
            while todo:
                y, x = todo.pop()
                own.append((y, x))
                for p in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                    if p in left:
                        left.discard(p)
                        todo.append(p)
            out.append(np.array(own))
    return out


def box_of(m, ignore=0.12):
    h, w = m.shape
    soft = blur(m.astype(float), 3, 1.4)
    d = np.abs(soft - blur(soft, 63, 21.0)).astype(int)
    best, cut = 0.0, 0
    for t in range(256):
        a, b = d[d <= t], d[d > t]
        if len(a) and len(b) and (s := len(a) * len(b) * (a.mean() - b.mean()) ** 2) > best * (1 + 1e-12):
            best, cut = s, t
    mask = square(square(square(square((d > cut).astype(int), 4, np.max), 4, np.min), 2, np.min), 2, np.max)
    found, top = None, -1.0
    for p in parts(mask):
        (y, x), (bh, bw) = p.min(0), np.ptp(p, 0) + 1
        if not h * w * 0.004 <= len(p) <= h * w * 0.70 or y < int(h * ignore) or not 0.15 <= bw / bh <= 6:
            continue
        score = len(p) / (1 + 6 * (((x + bw / 2 - w / 2) / w) ** 2 + ((y + bh / 2 - h / 2) / h) ** 2))
        if score > top + 1e-9:
            found, top = (x, y, x + bw, y + bh), score
    return found


def scenes():
    rng = np.random.default_rng(1)
    out = {"flat": np.full((40, 50), 90), "bar": np.full((100, 80), 150), "low": np.full((10, 9), 20), "noise": rng.integers(0, 256, (60, 40))}
    out["bar"][:15] = 0
    for i in range(4):
        m = rng.integers(120, 140, (90, 110))
        for _ in range(3):
            y, x, r = rng.integers(25, 80), rng.integers(15, 100), rng.integers(5, 16)
            m[np.hypot(*(np.indices(m.shape) - np.array([y, x])[:, None, None])) < r] -= rng.integers(30, 110)
        m[: rng.integers(0, 22)] = np.where(rng.random(110) < 0.2, 250, 10)
        out[f"cells {i}"] = m
    return out


def test_bars_and_boxes(spark):
    pictures = scenes()
    px = pixels(spark, pictures)
    assert {r.image: r.bar for r in preprocess.top_bars(px).collect()} == {n: bar_of(m) for n, m in pictures.items()}
    got = {r.image: (r.x1, r.y1, r.x2, r.y2) for r in preprocess.cell_boxes(px).collect()}
    want = {n: box_of(m) or (None,) * 4 for n, m in pictures.items()}
    assert got == want and sum(b[0] is not None for b in want.values()) >= 3


def test_crops_keep_pixels(spark):
    pictures = scenes()
    px = pixels(spark, pictures).withColumn("note", F.concat("image", F.col("v").cast("string")))
    records = preprocess.crops(px, pad=16)
    got = {r.image: r for r in records.collect()}
    assert (got["bar"].top_bar_px, got["bar"].crop_x, got["bar"].crop_y) == (15, 0, 15)
    inside = {}
    for r in preprocess.cropped(px, records).collect():
        assert r.note == f"{r.image}{r.v}"
        inside.setdefault(r.image, {})[r.y, r.x] = r.v
    for n, m in pictures.items():
        h, w = m.shape
        bar = min(bar_of(m), h - 1)
        box = box_of(m[bar:])
        x1, y1, x2, y2 = (max(0, box[0] - 16), max(0, box[1] - 16), min(w, box[2] + 16), min(h - bar, box[3] + 16)) if box else (0, 0, w, h - bar)
        assert tuple(got[n])[1:] == (w, h, bar, box is not None, x1, bar + y1, x2 - x1, y2 - y1)
        assert inside[n] == {(y, x): m[bar + y1 + y, x1 + x] for y in range(y2 - y1) for x in range(x2 - x1)}
    fixed = {r.image: r.top_bar_px for r in preprocess.crops(px, bar=30).collect()}
    assert fixed["bar"] == 30 and fixed["low"] == 9
    assert preprocess.crops(px.limit(0)).count() == 0


def test_manifest(spark):
    px = pixels(spark, {"a/x.png": np.full((9, 9), 7), "a/x.bmp": np.full((9, 9), 7)})
    files = spark.createDataFrame([("a/x.png", 9), ("a/x.bmp", 9), ("a/bad.jpg", -1)], "origin string, height int")
    got = {r.image: r for r in preprocess.processed(files, preprocess.crops(px)).collect()}
    assert [got[n].preprocess_status for n in ("a/x.png", "a/x.bmp", "a/bad.jpg")] == ["ok", "ok", "error"]
    assert got["a/x.png"].processed_path == "images/a/x.png.png" and got["a/x.bmp"].processed_path == "images/a/x.bmp.png"
    assert got["a/bad.jpg"].processed_path is None and got["a/bad.jpg"].error and got["a/x.png"].error == ""


def dominant_of(m, least):
    found, (h, w) = parts(m), m.shape
    if len(found) <= 1:
        return m, False
    score = lambda p: round(len(p) * (0.35 + 0.65 * (1 - min(1.0, math.hypot(*(p.mean(0) - [(h - 1) / 2, (w - 1) / 2])) / (math.hypot(h, w) / 2)))), 9)
    best, largest, total = max(found, key=score), max(found, key=len), sum(map(len, found))
    if len(best) / total >= 0.85 or best is largest and len(best) / total >= 0.72 and total - len(best) <= max(least * 4, 0.04 * h * w):
        out = np.zeros_like(m)
        out[tuple(best.T)] = True
        return out, True
    return m, False


def test_dominant_components(spark):
    rng = np.random.default_rng(3)
    pictures = {"none": np.zeros((6, 6), bool), "one": np.eye(7, dtype=bool)}
    for i in range(12):
        m = np.zeros((30, 40), bool)
        for _ in range(rng.integers(1, 5)):
            y, x, a, b = rng.integers(0, 24), rng.integers(0, 32), rng.integers(2, 20), rng.integers(2, 20)
            m[y : y + a, x : x + b] = True
        m[rng.integers(0, 30), :2] = True
        pictures[f"p{i}"] = m
    want = {n: dominant_of(m, 4) for n, m in pictures.items()}
    got = {}
    for r in raster.dominant(pixels(spark, pictures, "in", "boolean"), 4).collect():
        assert r.dominant == want[r.image][1]
        got.setdefault(r.image, set()).update({(r.y, r.x)} if getattr(r, "in") else ())
    assert got == {n: set(map(tuple, np.argwhere(m).tolist())) for n, (m, _) in want.items()}
    assert 2 <= sum(kept for _, kept in want.values()) < len(want)


def test_cleaned_to_the_central_component(spark):
    m = np.zeros((60, 60), bool)
    m[15:45, 15:45] = True
    m[2:8, 2:8] = True  # 36 of 936 pixels: within the bounds
    far = m.copy()
    far[2:14, 2:14] = True  # 144 of 1044: more than they allow
    px = pixels(spark, {"m": m, "far": far}, "in", "boolean")
    got = {(r.image, c): r.n for c in (False, True) for r in raster.cleaned(px, radius=1, central=c).where("in").groupBy("image").agg(F.count("*").alias("n")).collect()}
    assert got["m", True] < got["m", False]
    assert got["far", True] == got["far", False]


def test_overlays(spark):
    rng = np.random.default_rng(5)
    a, mask = rng.integers(0, 256, (9, 7, 3)), rng.random((9, 7)) < 0.4
    rows = [("a", y, x, *map(int, a[y, x])) for y in range(9) for x in range(7)]
    px = spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int")
    marks = pixels(spark, {"a": mask}, "in", "boolean")
    over = overlays.blended(px, marks, 0.3, (10, 255, 0))
    want = np.where(mask[..., None], np.rint(a * 0.7 + np.array([10, 255, 0]) * 0.3).astype(int), a)
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in over.collect()} == {(y, x): tuple(map(int, want[y, x])) for y in range(9) for x in range(7)}
    pair = {(r.y, r.x): (r.r, r.g, r.b) for r in overlays.beside(px, over).collect()}
    assert len(pair) == 126 and all(pair[y, x] == tuple(map(int, a[y, x])) and pair[y, x + 7] == tuple(map(int, want[y, x])) for y in range(9) for x in range(7))
    with pytest.raises(ContractError):
        overlays.blended(px, marks, 1.5)
    with pytest.raises(Exception, match="differ in size"):
        overlays.blended(px, marks.where("x < 6")).collect()


def test_overlay_jobs(spark):
    images = spark.createDataFrame([("a.png", "ok", "images/f/a.png.png"), ("b.jpg", "ok", "images/b.jpg.png"), ("c", "error", None), ("d", "ok", "images/d.png"), ("e", "ok", "images/e.png")], "image_id string, preprocess_status string, processed_path string")
    masks = spark.createDataFrame([("a.png", "ok", "m/a"), ("b.jpg", "empty", "m/b"), ("c", "ok", "m/c"), ("d", "error", "m/d")], "image_id string, status string, mask_path string")
    got = {r.image_id: (r.overlay_path, r.skipped) for r in overlays.overlay_jobs(images, masks).collect()}
    assert got == {"a.png": ("overlays/f/a.png", None), "b.jpg": ("overlays/b.jpg", None), "c": (None, "picture not ready"), "d": (None, "mask failed"), "e": (None, "no mask")}
