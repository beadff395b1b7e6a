"""Measures of rasters as jobs over a table of pixels: (image, y, x, v), and in for those inside the mask.

A neighbourhood is an explode over fixed offsets and a join, a run is a window, and a measure is an aggregation, so that
any number of images of any size are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.operators.graph import connected
from brightloom.operators.quantiles import joined, quantiles
from brightloom.session import checkpointed, sorted_side, stored

#: What a border pixel adds to the perimeter, by the code that its neighbourhood sums up to.
PERIMETER = {1.0: (5, 7, 15, 17, 25, 27), 2**0.5: (21, 33), (1 + 2**0.5) / 2: (13, 23)}
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def pixels(df: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """The pixels of images given as arrays, row by row, scaled to 0..1 over each image."""
    low, high = F.array_min(values).cast("double"), F.array_max(values).cast("double")
    scaled = F.transform(values, lambda v: F.coalesce(F.try_divide(v.cast("double") - low, high - low), F.lit(0.0)))
    rows = df.select(F.col(image).alias("image"), F.posexplode(scaled).alias("i", "v"))
    return rows.select("image", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "v")


def masked(px: DataFrame, cut: float = 0.5) -> DataFrame:
    return px.withColumn("in", F.col("v") > cut)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def shifted(px: DataFrame, offsets: list[tuple[int, int]], *more: str) -> DataFrame:
    """Each pixel at all its offsets, with dy and dx and the columns asked for."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])).alias("d")
    rows = px.select("image", "y", "x", *more, steps)
    return rows.select("image", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.col("d.dy").alias("dy"), F.col("d.dx").alias("dx"), *more)


def dilated(px: DataFrame, radius: int) -> DataFrame:
    """The mask grown by a disk, within the image."""
    near = shifted(px.where("in"), disk(radius)).select("image", "y", "x").distinct().withColumn("__in", F.lit(True))
    return px.join(sorted_side(near), ["image", "y", "x"], "left").withColumn("in", F.coalesce("__in", F.lit(False))).drop("__in")


def eroded(px: DataFrame, radius: int) -> DataFrame:
    """The mask less what lies within a disk of the outside; beyond the image counts as inside."""
    outside = px.withColumn("in", ~F.col("in"))
    return dilated(outside, radius).withColumn("in", ~F.col("in"))


def touching(runs: DataFrame, diagonal: bool) -> DataFrame:
    """(image, a, b): labels of runs (image, y, label, lo, hi) of neighbouring rows of an image that lie beside each other.
    Of two such runs the one that starts later starts within the other, which is the last of its row to start before."""
    sides = F.explode(F.array(F.struct(F.col("y").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("y") - 1).alias("pair"), F.lit(1).alias("side")))).alias("s")
    rows = runs.select("image", "label", "lo", "hi", sides).select("image", "label", "lo", "hi", "s.*")
    upto = Window.partitionBy("image", "pair").orderBy("lo", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("label", "hi")), ignorenulls=True).over(upto)
    beside = rows.select("image", F.col("label").alias("a"), "lo", F.when(F.col("side") == 0, last(1)).otherwise(last(0)).alias("other"))
    return beside.where(F.col("other.hi") + int(diagonal) >= F.col("lo")).select("image", "a", F.col("other.label").alias("b"))


def components(px: DataFrame, neighbours=EIGHT) -> DataFrame:
    """Adds component, the smallest y * 2**32 + x of the inside pixels that are joined with this one through all eight, or
    the four nearest, neighbours; null outside. Runs of pixels in a row are the vertices of a graph, whose links are runs
    that touch in the next row, so that rounds grow with the logarithm of their number and not with a path's turns."""
    along = Window.partitionBy("image", "y").orderBy("x")
    own = px.where("in").select("image", "y", "x", (F.col("x") - F.row_number().over(along)).alias("run"))
    label = F.col("y").cast("long") * (1 << 32) + F.min("x").over(Window.partitionBy("image", "y", "run"))
    own = stored(own.select("image", "y", "x", label.alias("label")), "runs")
    runs = own.groupBy("image", "y", "label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    links = touching(runs, (1, 1) in neighbours)
    roots = connected(links.select(F.struct("image", F.col("a").alias("label")).alias("a"), F.struct("image", F.col("b").alias("label")).alias("b")))
    roots = roots.select("id.image", "id.label", F.col("root.label").alias("root"))
    own = own.join(sorted_side(roots), ["image", "label"], "left").select("image", "y", "x", F.coalesce("root", "label").alias("component"))
    return px.join(sorted_side(own), ["image", "y", "x"], "left")


def largest(px: DataFrame) -> DataFrame:
    """Narrows the mask to the largest component of each image (the first of equals); adds component_count and
    selected_fraction."""
    found = components(px)
    sizes = found.where("component is not null").groupBy("image", "component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("image").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("best"), F.count(F.lit(1)).alias("component_count"), (F.max("n") / F.sum("n")).alias("selected_fraction"))
    out = found.join(sorted_side(best), "image", "left").withColumn("in", F.coalesce(F.col("component") == F.col("best"), F.lit(False)))
    return out.withColumn("component_count", F.coalesce("component_count", F.lit(0))).drop("component", "best")


def without_small(px: DataFrame, least: int, objects: bool = True) -> DataFrame:
    """Drops components of fewer pixels from the mask (joined through four neighbours), or fills such holes."""
    found = components(px if objects else px.withColumn("in", ~F.col("in")), FOUR)
    small = found.where("component is not null").groupBy("image", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    marked = found.join(sorted_side(small.withColumn("__small", F.lit(True))), ["image", "component"], "left")
    return px.join(sorted_side(marked.where("__small").select("image", "y", "x", F.lit(not objects).alias("__in"))), ["image", "y", "x"], "left").withColumn("in", F.coalesce("__in", "in")).drop("__in")


def dominant(px: DataFrame, least_object: int) -> DataFrame:
    """Narrows each mask to the component that is large and central, where it is most of the mask: 85 %, or 72 % if it is
    also the largest and the rest is small. Adds dominant, whether that was done."""
    found = stored(components(px, EIGHT), "parts")
    size = found.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    parts = found.where("component is not null").groupBy("image", "component").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx")).join(sorted_side(size), "image")
    away = F.sqrt((F.col("cy") - (F.col("h") - 1) / 2) ** 2 + (F.col("cx") - (F.col("w") - 1) / 2) ** 2) / (F.sqrt(F.col("h") ** 2 + F.col("w") ** 2) / 2)
    score = F.round(F.col("area") * (0.35 + 0.65 * (1 - F.least(F.lit(1.0), away))), 9)
    first = lambda by: F.max_by(F.struct("component", "area"), F.struct(by, -F.col("component")))
    best = parts.groupBy("image", "h", "w").agg(first(score).alias("best"), first(F.col("area")).alias("largest"), F.sum("area").alias("total"), F.count(F.lit(1)).alias("n"))
    part, rest = F.col("best.area") / F.col("total"), F.col("total") - F.col("best.area")
    small = rest <= F.greatest(F.lit(4 * least_object), 0.04 * F.col("h") * F.col("w"))
    keep = (F.col("n") > 1) & ((part >= 0.85) | ((F.col("best.component") == F.col("largest.component")) & (part >= 0.72) & small))
    chosen = best.select("image", F.when(keep, F.col("best.component")).alias("chosen"))
    out = found.join(sorted_side(chosen), "image", "left")
    return out.withColumns({"in": F.col("in") & (F.col("chosen").isNull() | F.coalesce(F.col("component") == F.col("chosen"), F.lit(False))), "dominant": F.col("chosen").isNotNull()}).drop("component", "chosen")


def cleaned(px: DataFrame, radius: int = 5, object_part: float = 0.001, hole_part: float = 0.01, relative: float = 0.08, absolute: float = 0.01, central: bool = False) -> DataFrame:
    """Light morphology of masks of one size: small objects and holes go, the rest is opened and closed by a disk. Where
    that changes an area too much, both relatively and absolutely, the image keeps its mask without small parts; one that
    would be left empty keeps what it had. central: masks are narrowed to their dominant component in the end, where that
    keeps to the same bounds."""
    n = px.groupBy("image").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    objects, holes = max(4, round(object_part * n)), max(6, round(hole_part * n))
    base = checkpointed(without_small(without_small(px, objects), holes, objects=False))
    soft = dilated(eroded(base, radius), radius)
    soft = checkpointed(without_small(without_small(eroded(dilated(soft, radius), radius), objects), holes, objects=False))
    both = px.join(sorted_side(base.select("image", "y", "x", F.col("in").alias("base"))), ["image", "y", "x"]).join(sorted_side(soft.select("image", "y", "x", F.col("in").alias("soft"))), ["image", "y", "x"])
    area = both.groupBy("image").agg(F.count_if("in").alias("a"), F.count_if("base").alias("b"), F.count_if("soft").alias("c"), F.count(F.lit(1)).alias("n"))
    change = F.abs(F.col("c") - F.col("a"))
    kept = F.when((F.col("c") > 0) & ((change <= relative * F.col("a")) | (change <= absolute * F.col("n"))), "soft").when(F.col("b") > 0, "base").otherwise("in")
    out = both.join(sorted_side(area.select("image", kept.alias("kept"))), "image")
    out = out.withColumn("result", F.when(F.col("kept") == "soft", F.col("soft")).when(F.col("kept") == "base", F.col("base")).otherwise(F.col("in")))
    if central:
        out = stored(out, "cleaned")
        one = dominant(out.withColumn("in", F.col("result")).select("image", "y", "x", "in"), objects).where("dominant").select("image", "y", "x", F.col("in").alias("one"))
        out = out.join(sorted_side(one), ["image", "y", "x"], "left")
        sizes = out.groupBy("image").agg(F.count_if("in").alias("a"), F.count_if("one").alias("c"), F.count(F.lit(1)).alias("n"))
        fits = (F.abs(F.col("c") - F.col("a")) <= relative * F.col("a")) | (F.abs(F.col("c") - F.col("a")) <= absolute * F.col("n"))
        out = out.join(sorted_side(sizes.select("image", fits.alias("fits"))), "image").withColumn("result", F.when(F.col("fits") & F.col("one").isNotNull(), F.col("one")).otherwise(F.col("result"))).drop("one", "fits")
    return out.withColumn("in", F.col("result")).drop("kept", "base", "soft", "result")


def intensity(px: DataFrame) -> DataFrame:
    """Mean, population deviation and percentiles inside the mask, and the same of a ring around it."""
    inside = px.where("in")
    moments = inside.groupBy("image").agg(F.avg("v").alias("cell_mean"), F.stddev_pop("v").alias("cell_std"))
    return joined(moments, quantiles(inside, ["image"], [("cell_p05", "v", 0.05), ("cell_p50", "v", 0.5), ("cell_p95", "v", 0.95)]), ["image"])


def ring_intensity(px: DataFrame, radius: int = 5) -> DataFrame:
    grown = dilated(px.withColumn("own", F.col("in")), radius).where(F.col("in") & ~F.col("own"))
    ring = grown.groupBy("image").agg(F.avg("v").alias("ring_mean"), F.stddev_pop("v").alias("ring_std"))
    cell = px.where("in").groupBy("image").agg(F.avg("v").alias("cell_mean"), F.stddev_pop("v").alias("cell_std"))
    out = cell.join(ring, "image", "left")
    return out.select("image", "ring_mean", (F.col("cell_mean") - F.col("ring_mean")).alias("cell_minus_ring_mean"), F.when(F.col("ring_std") > 0, F.col("cell_std") / F.col("ring_std")).alias("cell_to_ring_std_ratio"))


def shape(px: DataFrame) -> DataFrame:
    """Area, equivalent diameter, axes of the ellipse with the same moments, eccentricity and extent of the mask."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = px.where("in").groupBy("image").agg(F.count(F.lit(1)).alias("area"), F.var_pop(y).alias("yy"), F.var_pop(x).alias("xx"), F.covar_pop(y, x).alias("xy"), ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("box"))
    # A pixel is a unit square; its own spread isn't counted, as is usual for digitised regions.
    middle, half = (F.col("yy") + F.col("xx")) / 2, F.sqrt(((F.col("yy") - F.col("xx")) / 2) ** 2 + F.col("xy") ** 2)
    big, small = middle + half, F.greatest(middle - half, F.lit(0.0))
    eccentricity = F.when(big > 0, F.sqrt(F.greatest(1 - small / big, F.lit(0.0)))).otherwise(0.0)
    return m.select("image", "area", F.sqrt(4 * F.col("area") / F.pi()).alias("equivalent_diameter"), (4 * F.sqrt(big)).alias("major_axis"), (4 * F.sqrt(small)).alias("minor_axis"), eccentricity.alias("eccentricity"), (F.col("area") / F.col("box")).alias("extent"))


def perimeter(px: DataFrame) -> DataFrame:
    """Perimeter of the mask by the codes of its border pixels' neighbourhoods."""
    inside = px.where("in")
    beside = shifted(inside, FOUR).groupBy("image", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    border = inside.join(beside, ["image", "y", "x"], "left").where(F.coalesce("n", F.lit(0)) < 4)
    weight = F.when((F.col("dy") == 0) & (F.col("dx") == 0), 1).when((F.col("dy") == 0) | (F.col("dx") == 0), 2).otherwise(10)
    code = shifted(border, [(0, 0), *EIGHT]).groupBy("image", "y", "x").agg(F.sum(weight).alias("code"))
    adds = F.lit(0.0)
    for length, codes in PERIMETER.items():
        adds = F.when(F.col("code").isin(*codes), length).otherwise(adds)
    return code.groupBy("image").agg(F.sum(adds).alias("perimeter"))


def glcm(px: DataFrame, distances=(1, 2, 4), levels: int = 32) -> DataFrame:
    """Means of contrast, homogeneity, energy and correlation over co-occurrence matrices at the distances in four
    directions; both pixels of a pair are inside the mask."""
    offsets = [o for d in distances for o in ((0, d), (d, d), (d, 0), (d, -d))]
    level = px.where("in").withColumn("g", F.least(F.floor(F.col("v") * levels), F.lit(levels - 1)).cast("int"))
    first = shifted(level, offsets, "g").withColumnRenamed("g", "a")
    pairs = first.join(level.select("image", "y", "x", F.col("g").alias("b")), ["image", "y", "x"])
    both = pairs.select("image", "dy", "dx", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("image", "dy", "dx", "p.*")
    n = both.groupBy("image", "dy", "dx", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image", "dy", "dx")))
    d = F.col("a") - F.col("b")
    sums = p.groupBy("image", "dy", "dx").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") ** 2)).alias("energy"), F.sum(F.col("p") * F.col("a")).alias("m"), F.sum(F.col("p") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("p") * F.col("a") * F.col("b")).alias("ab"))
    var = F.col("aa") - F.col("m") ** 2
    correlation = F.when(var < 1e-12, 1.0).otherwise((F.col("ab") - F.col("m") ** 2) / var)  # of a symmetric matrix
    sums = sums.withColumn("correlation", correlation)
    return sums.groupBy("image").agg(*[F.avg(c).alias(f"glcm_{c}") for c in ("contrast", "homogeneity", "energy", "correlation")])


def longest_border_run(px: DataFrame) -> DataFrame:
    """The longest run of inside pixels along one edge of each image; runs on different edges don't add up."""
    size = px.groupBy("image").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    rows = px.where("in").join(size, "image")
    edges = F.array(*[F.when(c, F.struct(F.lit(i).alias("edge"), F.col(at).alias("at"))) for i, (c, at) in enumerate(((F.col("y") == 0, "x"), (F.col("y") == F.col("h"), "x"), (F.col("x") == 0, "y"), (F.col("x") == F.col("w"), "y")))])
    on = rows.select("image", F.explode(F.array_compact(edges)).alias("e")).select("image", "e.*")
    runs = on.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("image", "edge").orderBy("at")))
    longest = runs.groupBy("image", "edge", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("image").agg(F.max("n").alias("longest_run"))
    return px.select("image").distinct().join(longest, "image", "left").select("image", F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def quality_flags(area_fraction: Column, selected_fraction: Column, longest_run: Column, least_run: int = 14) -> Column:
    """Why a mask isn't to be trusted, joined by ;, or ok."""
    flags = F.concat_ws(";", F.when(area_fraction < 0.012, "tiny_mask"), F.when(area_fraction > 0.78, "large_mask"), F.when(selected_fraction < 0.9, "multiple_components"), F.when(longest_run >= least_run, "touches_border"))
    return F.when(area_fraction.isNull(), "empty_mask").when(flags == "", "ok").otherwise(flags)


def gradients(px: DataFrame) -> DataFrame:
    """(image, cy, cx, g): Sobel's gradient of the pixels inside the mask eroded by one; edges repeat beyond the image."""
    size = px.groupBy("image").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    inner = eroded(px, 1).where("in").select("image", "y", "x")
    at = shifted(inner, EIGHT).join(size, "image")
    at = at.select("image", (F.col("y") - F.col("dy")).alias("cy"), (F.col("x") - F.col("dx")).alias("cx"), "dy", "dx", F.greatest(F.lit(0), F.least("y", "h")).alias("y"), F.greatest(F.lit(0), F.least("x", "w")).alias("x"))
    v = at.join(px.select("image", "y", "x", "v"), ["image", "y", "x"])
    side = lambda a, b: F.sum(F.col(a) * F.when(F.col(b) == 0, 2).otherwise(1) * F.col("v")) / 4
    g = v.groupBy("image", "cy", "cx").agg(side("dy", "dx").alias("gy"), side("dx", "dy").alias("gx"))
    return g.select("image", "cy", "cx", F.sqrt((F.col("gy") ** 2 + F.col("gx") ** 2) / 2).alias("g"))


def gradient(px: DataFrame) -> DataFrame:
    """Mean and deviation of the gradient inside the mask eroded by one pixel."""
    return gradients(px).groupBy("image").agg(F.avg("g").alias("grad_mean"), F.stddev_pop("g").alias("grad_std"))


def otsu(values: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """(image, cut): the bin centre that parts each image's values with the greatest variance between the classes; of
    equal values, the value."""
    ends = values.groupBy("image").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1))
    n = values.join(ends, "image").groupBy("image", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    upto, all_ = Window.partitionBy("image").orderBy("bin"), Window.partitionBy("image")
    n = n.withColumns({"w1": F.sum("n").over(upto), "s1": F.sum(F.col("n") * F.col("centre")).over(upto), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("centre")).over(all_)})
    w2 = F.col("w") - F.col("w1")
    between = F.when(w2 > 0, F.col("w1") * w2 * (F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / w2) ** 2)
    best = n.groupBy("image", "lo", "hi").agg(F.max_by("centre", F.struct(F.coalesce(between, F.lit(-1.0)), -F.col("bin"))).alias("cut"))
    return best.select("image", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("cut")).alias("cut"))


def edge_density(px: DataFrame) -> DataFrame:
    """The part of the eroded mask whose gradient is above Otsu's cut."""
    g = gradients(px)
    return g.join(otsu(g, "g"), "image").groupBy("image").agg(F.avg((F.col("g") > F.col("cut")).cast("double")).alias("edge_density"))


def local_patterns(px: DataFrame) -> DataFrame:
    """(image, y, x, code): uniform local binary patterns of eight samples at distance one, of the 256 grey levels inside
    the mask eroded by one pixel. Codes 0 to 8 count the samples at least as bright, if they change twice at most; others
    are 9. Samples between pixels are interpolated."""
    grey = px.withColumn("g", F.bround(F.col("v") * 255))
    inner = eroded(grey, 1).where("in").select("image", "y", "x", "g")
    name = lambda dy, dx: f"n{EIGHT.index((dy, dx))}"
    at = shifted(inner, EIGHT).join(grey.select("image", "y", "x", "g"), ["image", "y", "x"], "left")
    at = at.select("image", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "dy", "dx", F.coalesce("g", F.lit(0.0)).alias("g"))
    sides = at.groupBy("image", "y", "x").agg(*[F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("g"))).alias(name(dy, dx)) for dy, dx in EIGHT])
    rows, d = inner.join(sides, ["image", "y", "x"]), 0.5**0.5
    samples = []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)):
        corner = F.col(name(dy, dx))
        if dy and dx:
            corner = F.col("g") * (1 - d) ** 2 + (F.col(name(dy, 0)) + F.col(name(0, dx))) * d * (1 - d) + corner * d * d
        samples.append((corner - F.col("g") >= -1e-9).cast("int"))
    rows = rows.withColumn("bits", F.array(*samples))
    changes = sum((F.col("bits")[i] != F.col("bits")[(i + 1) % 8]).cast("int") for i in range(8))
    return rows.select("image", "y", "x", F.when(changes <= 2, F.aggregate("bits", F.lit(0), lambda a, b: a + b)).otherwise(9).alias("code"))


def pattern_texture(px: DataFrame) -> DataFrame:
    """Uniformity and entropy in bits of the local patterns."""
    n = local_patterns(px).groupBy("image", "code").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    return p.groupBy("image").agg(F.sum(F.col("p") ** 2).alias("lbp_uniformity"), F.sum(-F.col("p") * F.log2("p")).alias("lbp_entropy"))


def entropy(px: DataFrame) -> DataFrame:
    """Entropy in bits of the 256 grey levels inside the mask."""
    n = px.where("in").groupBy("image", F.bround(F.col("v") * 255).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    return p.groupBy("image").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))
