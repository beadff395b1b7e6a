"""Operators on small hand-made tables: missing values, contracts, labels, runs and models."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import clean, labels
from brightloom.operators import bags, cells, filters, glm, joins, models, raster, scale, select, summary
from brightloom.sources import runs, tables
from brightloom.streaming.incremental import follow

NAN, INF = float("nan"), float("inf")


def test_path_labels(spark):
    df = spark.createDataFrame([("Epithelioid Cells 23/23-WT1+CAL/1.png",), ("A549 Lung cancer cells (NSCLC)/1.png",), ("mystery/1.png",), ("x.png",), ("MSTO/SPCKX/1.png",)], "p string")
    a, b, c, d, e = df.select(*[v.alias(k) for k, v in labels.path_labels("p").items()]).collect()
    assert (a.marker_group, a.subtype, a.disease_group) == ("WT1+CAL", "epithelioid", "mesothelioma")
    assert (b.subtype, b.disease_group, b.cell_line, b.marker_label) == ("other/control", "nsclc_control", "A549", "unlabelled")
    assert c.subtype == c.disease_group == "unknown" and c.source_folder == "mystery"
    assert d.source_folder == "unknown"
    assert (e.cell_line, e.subtype, e.marker_group) == ("MSTO-211H", "biphasic", "SPCKX")


def test_cleaning(spark):
    df = spark.createDataFrame([("1.5", "A b_ c"), ("x", ""), (None, None), ("NaN", "TRUE "), ("inf", "true")], "n string, t string")
    assert [r[0] for r in df.select(clean.number("n")).collect()] == [1.5, None, None, None, None]
    assert [r[0] for r in df.select(clean.truth("t")).collect()] == [False, False, False, True, True]
    assert [r[0] for r in df.select(clean.folded("t")).collect()][0] == "a_b_c"
    assert [r[0] for r in df.select(clean.or_unknown("t")).collect()] == ["A b_ c", "unknown", "unknown", "TRUE", "true"]
    assert [r[0] for r in df.select(clean.contains_any("t", ["", "B_"])).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(clean.contains_any("t", ["a B"], fold=True)).collect()][0]
    assert clean.violations(spark.createDataFrame([("1",), ("1.5",), ("-1",), (None,)], "k string"), "k").count() == 3
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(clean.half_even("x", 0)).collect()] == [2.0, 4.0]


def test_matrix_drops_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 10.0, NAN, 5), (2.0, NAN, NAN, 5), (3.0, 30.0, None, 5), (INF, 40.0, NAN, 5)], "area double, perimeter double, solidity double, crop_x int")
    out, kept = scale.prepare_matrix(df, ["area", "perimeter", "solidity", "crop_x"])
    assert kept == ["area", "perimeter"]
    m = np.array([[r.area, r.perimeter] for r in out.collect()])
    assert np.isfinite(m).all() and np.allclose(m.mean(0), 0) and np.allclose(m.std(0), 1)


def test_contracts(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "bag string, label string, k int")
    with pytest.raises(filters.ContractError):
        filters.require_single(df, "bag", "label")
    with pytest.raises(filters.ContractError):
        filters.require_unique(df, ["bag"])
    with pytest.raises(filters.ContractError):
        filters.require_levels(df, "label", 2, "bag")
    assert filters.require_levels(df, "k", 3) is df
    assert filters.degenerate(df.withColumn("z", F.lit(0.0)), "z") and not filters.degenerate(df, "k")
    assert filters.complete(spark.createDataFrame([(1.0, "a"), (NAN, "a"), (2.0, None)], "x double, s string"), ["x", "s"]).count() == 1


def test_joins(spark):
    left = spark.createDataFrame([("1", "p"), ("2", "q")], "image_id string, note string")
    right = spark.createDataFrame([("1", "m", "ok")], "image_id string, note string, status string")
    rows = {r.image_id: r for r in joins.lookup(left, right, "image_id").collect()}
    assert rows["1"].note_mask == "m" and rows["2"].note_mask is None
    new = spark.createDataFrame([("1", " "), ("2", "z"), ("9", "w")], "image_id string, note string")
    assert sorted(tuple(r) for r in joins.override(left, new, "image_id", ["note"]).collect()) == [("1", "p"), ("2", "z")]
    with pytest.raises(ValueError):
        joins.override(left, new, "image_id", ["nothing"])
    assert [r.image_id for r in joins.remaining(left, right, ["image_id"]).collect()] == ["2"]
    assert [r.image_id for r in joins.reusable(left, right, ["image_id"]).collect()] == ["1"]
    assert joins.mapped(left, "note", {"p": "P"}, "m", "Cluster_").select("m").collect()[1].m == "Cluster_q"


def test_null_features_keep_their_weight(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, 0.0), ("a", None, 1.0, 0.0), (None, 1.0, 1.0, 0.0)], "bag string, x double, m1 double, m2 double")
    (r,) = bags.bag_features(df, "bag", ["x"], ["m1", "m2"]).collect()
    assert (r.n, r.xg_1, r.c_1, r.xk1_1, r.xk2_1) == (2, 2.0, 2.0, 1.0, None)


def test_selections(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(9)], "id int, g string")
    assert [r.id for r in select.round_robin(df, "g", "id", 4).collect()] == [0, 1, 2, 3]
    assert select.group_head(df, ["g"], "id").count() == 3
    assert select.tiered_sample(df, F.col("id") < 2, ["g"], "id", 6).count() == 6
    assert [r.page for r in select.pages(df, ["id"], 4).orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2]
    assert summary.histogram(df.withColumn("c", F.lit(1.0)), "g", "c").collect()[0].bin == 0


def test_glm_against_newton(spark):
    rng = np.random.default_rng(1)
    x, z = rng.standard_normal(400), rng.integers(0, 2, 400).astype(float)
    y = rng.poisson(np.exp(0.3 + 0.5 * x - 0.4 * z))
    df = spark.createDataFrame(list(zip(x.tolist(), z.tolist(), y.tolist(), (rng.integers(0, 20, 400)).tolist(), strict=True)), "x double, z double, y long, g long")
    design = np.column_stack([np.ones(400), x, z])
    for family, alpha in (("poisson", 0.0), ("nb", 1.0)):
        beta = np.array([math.log(y.mean()), 0, 0])
        for _ in range(100):
            mu = np.exp(design @ beta)
            w, s = mu / (1 + alpha * mu), (y - mu) / (1 + alpha * mu)
            beta = beta + np.linalg.solve(design.T @ (design * w[:, None]), design.T @ s)
        rows = glm.fit(df, [glm.Model("y", ["x", "z"], family)], "g").collect()
        assert np.allclose([r.coef for r in rows], beta, atol=1e-8) and all(r.converged and 0 <= r.p <= 1 for r in rows)
    dummy, names = glm.dummies(df.withColumn("level", F.concat(F.lit("l"), F.col("g") % 3)), "level")
    assert names == ["level[l1]", "level[l2]"] and glm.fit(dummy, [glm.Model("y", names, "poisson")]).count() == 3
    # A model that can't be solved is left out rather than stopping the others.
    assert glm.fit(df.withColumn("k", F.lit(0.0)), [glm.Model("y", ["k"], "poisson"), glm.Model("y", ["x"], "poisson")]).count() == 2
    q = glm.false_discovery(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")).orderBy("p").collect()
    assert q[0].q is None and np.allclose([r.q for r in q[1:]], [0.03, 0.04, 0.04])


def test_clusters_and_plane(spark):
    df = spark.createDataFrame([(float(10 * c + d), float(c)) for c in range(3) for d in (0.0, 0.1, 0.2)], "a double, b double")
    assert [r.cluster for r in models.kmeans(df, ["a", "b"], 3, starts=3).orderBy("a").collect()] == [0] * 3 + [1] * 3 + [2] * 3
    assert models.plane(df, ["a", "b"]).where("pc1 is not null").count() == 9


def image(spark, mask, grey=None, name="i"):
    h, w = mask.shape
    g = np.where(mask, 0.3, 0.8) if grey is None else grey
    return spark.createDataFrame([(name, y, x, float(g[y, x]), bool(mask[y, x])) for y in range(h) for x in range(w)], "image string, y int, x int, v double, `in` boolean")


def round_mask(size, radius, cy, cx):
    y, x = np.mgrid[:size, :size]
    return (y - cy) ** 2 + (x - cx) ** 2 <= radius**2


def test_disk_with_speckle(spark):
    mask = round_mask(40, 9, 20, 20)
    whole = mask.copy()
    whole[2:5, 2:5] = True
    px = raster.largest(image(spark, whole)).cache()
    (s,) = raster.shape(px).collect()
    assert s.area == mask.sum() and px.agg(F.max("component_count")).first()[0] == 2
    assert abs(s.major_axis - 2 * 9) < 0.6 and s.eccentricity < 0.05
    (p,) = raster.perimeter(px).collect()
    assert 4 * math.pi * s.area / p.perimeter**2 > 0.85
    assert raster.intensity(px).first().cell_mean == pytest.approx(0.3)
    assert raster.ring_intensity(px, 2).first().ring_mean == pytest.approx(0.8)
    assert raster.eroded(raster.dilated(px, 2), 2).where("in").count() == mask.sum()


def test_measures_of_pictures(spark):
    mask = round_mask(40, 9, 20, 20)
    whole = mask.copy()
    whole[2:5, 2:5] = True
    corner, empty = np.zeros((40, 40), bool), np.zeros((40, 40), bool)
    corner[:20, :20] = True
    px = image(spark, whole).union(image(spark, empty, name="e")).union(image(spark, corner, name="c"))
    got = {r.image: r for r in cells.measured(px).collect()}
    assert len([n for kind in cells.MEASURES.values() for n in kind]) == 27
    r = got["i"]
    assert (r.area, r.component_count, r.qc_flags, r.qc_ok) == (mask.sum(), 2, "ok", True) and r.circularity > 0.85 and 0.9 < r.solidity <= 1
    assert r.intensity_cell_mean == pytest.approx(0.3) and r.intensity_background_ring_mean == pytest.approx(0.8) and r.texture_glcm_energy is not None
    assert got["e"].qc_flags == "empty_mask" and got["e"].area is None and not got["e"].qc_ok and got["e"].component_count == 0
    assert got["c"].qc_flags == "touches_border" and got["c"].solidity == 1
    # A bar and a dot: pixel by pixel, the hull is all that no side leaves out.
    assert cells.hull_pixels(np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([2, 0, 0])) == 6
    assert cells.hull_pixels(np.array([3]), np.array([2]), np.array([2])) == 1


def test_border_runs(spark):
    for n in (0, 1, 9, 14):
        for turns in range(4):
            mask = np.zeros((20, 20), bool)
            mask[1:10, 4:15] = True
            mask[0, 4 : 4 + n] = True
            assert raster.longest_border_run(image(spark, np.rot90(mask, turns))).first().longest_run == n
        if n == 9:
            mask[0, 10:12] = False  # two runs of contact aren't added up
            assert raster.longest_border_run(image(spark, mask)).first().longest_run == 6
    flags = spark.range(1).select(raster.quality_flags(F.lit(0.9), F.lit(0.5), F.lit(14)), raster.quality_flags(F.lit(0.5), F.lit(1.0), F.lit(13)), raster.quality_flags(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0))).first()
    assert tuple(flags) == ("large_mask;multiple_components;touches_border", "ok", "empty_mask")


def test_texture_ignores_the_background(spark):
    grey = np.random.default_rng(42).random((20, 20))
    mask = np.zeros((20, 20), bool)
    mask[5:15, 5:15] = True
    a = raster.glcm(image(spark, mask, grey)).first()
    assert tuple(a)[1:] == pytest.approx(tuple(raster.glcm(image(spark, mask, np.where(mask, grey, 1.0))).first())[1:], rel=1e-12)
    assert raster.gradient(image(spark, mask, grey)).first().grad_mean > 0 and raster.entropy(image(spark, mask, grey)).first().entropy > 4
    assert raster.shape(image(spark, np.zeros((4, 4), bool))).count() == 0


def test_patterns_and_cut(spark):
    grey = np.random.default_rng(1).integers(0, 256, (9, 9)) / 255
    px = image(spark, np.ones((9, 9), bool), grey)
    g, d = np.pad(np.round(grey * 255), 1), 0.5**0.5
    want = {}
    for y in range(1, 10):
        for x in range(1, 10):
            bits = []
            for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)):
                v = g[y + dy, x + dx]
                if dy and dx:
                    v = g[y, x] * (1 - d) ** 2 + (g[y + dy, x] + g[y, x + dx]) * d * (1 - d) + v * d * d
                bits.append(int(v - g[y, x] >= -1e-9))
            changes = sum(a != b for a, b in zip(bits, bits[1:] + bits[:1], strict=True))
            want[y - 1, x - 1] = sum(bits) if changes <= 2 else 9
    assert {(r.y, r.x): r.code for r in raster.local_patterns(px).collect()} == want
    two = spark.createDataFrame([("i", v) for v in [0.0, 0.1, 0.2, 0.8, 0.9, 1.0]], "image string, g double")
    assert 0.2 <= raster.otsu(two, "g").first().cut < 0.8 and raster.otsu(two.withColumn("g", F.lit(3.0)), "g").first().cut == 3.0
    assert 0 < raster.edge_density(px).first().edge_density < 1 and raster.pattern_texture(px).first().lbp_entropy > 1


def test_cleanup(spark):
    mask = round_mask(40, 10, 20, 20)
    holed = mask.copy()
    holed[3, 3], holed[20, 20] = True, False
    assert {(r.y, r.x) for r in raster.cleaned(image(spark, holed), radius=2).where("in").collect()} == {tuple(map(int, p)) for p in np.argwhere(mask)}
    thin = np.zeros((30, 30), bool)
    thin[14:17, 5:25] = True  # opening would leave nothing of it
    assert raster.cleaned(image(spark, thin), radius=3).where("in").count() == thin.sum()
    assert raster.cleaned(image(spark, np.zeros((5, 5), bool)), radius=1).where("in").count() == 0


def test_run_store(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "run"))
    store.save_settings("segment", {"threshold": 0.6})
    store.save_settings("segment", {"threshold": 0.6})
    with pytest.raises(ValueError):
        store.save_settings("segment", {"threshold": 0.7})
    store.save_settings("segment", {"threshold": 0.7}, overwrite=True)
    one = spark.createDataFrame([("a", "ok", "h1")], "image_id string, status string, sha string")
    store.merge("masks", one, "image_id")
    store.merge("masks", spark.createDataFrame([("b", "error")], "image_id string, status string"), "image_id")
    assert sorted(tuple(r) for r in store.load("masks").select("image_id", "status", "sha").collect()) == [("a", "ok", "h1"), ("b", "error", None)]
    assert store.drop_stale(["old.png", "kept.csv", "x/y.png"], ["kept.csv"]) == ["old.png"]
    assert runs.settings_digest(spark, {"a": 1, "b": 2}) == runs.settings_digest(spark, {"b": 2, "a": 1}) != runs.settings_digest(spark, {"a": 2, "b": 1})
    # A version that wasn't finished isn't seen, and doesn't cost the one before.
    (tmp_path / "run/masks/v00000009").mkdir()
    assert store.load("masks").count() == 2 and store.merge("masks", one, "image_id").count() == 2


def test_incremental_stream(spark, tmp_path):
    store, source = runs.RunStore(spark, str(tmp_path / "run")), tmp_path / "in"
    schema, seen = "image_id string, sha string", []
    for day, rows in enumerate(([("a", "1"), ("b", "2")], [("b", "2"), ("c", "3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"day={day}"))

        def work(df):
            seen.extend(r.image_id for r in df.collect())
            return df.withColumn("status", F.lit("ok"))

        stream = spark.readStream.schema(schema).parquet(str(source / "day=*")).select("image_id", "sha")
        follow(stream, store, "done", "image_id", ["sha"], work, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(seen) == ["a", "b", "c"] and store.load("done").count() == 3


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name\n1,""\n2,NA\n3,x\n')
    assert [r.name for r in tables.read_csv(spark, str(tmp_path / "t.csv"), "id int, name string").collect()] == ["", "NA", "x"]
    assert [r.name for r in tables.read_csv(spark, str(tmp_path / "t.csv"), "id int, name string", missing=True).collect()] == [None, None, "x"]
    (tmp_path / "s.json").write_text(json.dumps({"a": [1]}))
    assert tables.read_settings(spark, str(tmp_path / "s.json")) == {"a": [1]}
    runs.write_csv(spark.createDataFrame([("a", ["x", "y"])], "k string, flags array<string>"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().flags == "x;y"
    import struct
    import zlib

    def png(h, w):
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + b"\x10" * 3 * w) * h)) + part(b"IEND", b"")

    (tmp_path / "raw/a").mkdir(parents=True)
    (tmp_path / "raw/a/1.PNG").write_bytes(png(5, 7))
    (tmp_path / "raw/a/2.txt").write_text("no")
    found = tables.fingerprinted(tables.scan_images(spark, str(tmp_path / "raw"))).collect()
    assert [r.image_id for r in found] == ["a/1.PNG"] and len(found[0].sha256) == 64
    assert tuple(tables.image_sizes(spark, str(tmp_path / "raw"), "g").first()) == ("1.PNG", "g", 7, 5, 35)
    (tmp_path / "raw/raw").mkdir()
    (tmp_path / "raw/raw/x.png").write_bytes(png(2, 3))
    assert sorted(r.image_id for r in tables.scan_images(spark, str(tmp_path / "raw")).collect()) == ["a/1.PNG", "raw/x.png"]
    decoded = tables.decode_images(spark, str(tmp_path / "raw/a"))
    grey = tables.grey_pixels(decoded).collect()
    assert len(grey) == 35 and {(r.y, r.x) for r in grey} == {(y, x) for y in range(5) for x in range(7)} and grey[0].v == pytest.approx(16 / 255)
    assert not any(r["in"] for r in tables.mask_pixels(decoded).collect())
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        tables.scan_images(spark, str(tmp_path / "none"))
