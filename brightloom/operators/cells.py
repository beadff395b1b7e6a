"""One row of measures for each picture: shape, intensity and texture of the largest component of its mask, with flags."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators import raster
from brightloom.session import checkpointed

#: The measures of a picture, by kind.
MEASURES = {
    "shape": ["area", "perimeter", "equivalent_diameter_area", "major_axis_length", "minor_axis_length", "eccentricity", "solidity", "extent", "circularity"],
    "intensity": ["intensity_cell_mean", "intensity_cell_std", "intensity_cell_p05", "intensity_cell_p50", "intensity_cell_p95", "intensity_background_ring_mean", "intensity_cell_minus_ring_mean", "intensity_cell_to_ring_std_ratio"],
    "texture": ["texture_entropy", "texture_grad_mean", "texture_grad_std", "texture_edge_density", "texture_lbp_uniformity", "texture_lbp_entropy", "texture_glcm_contrast", "texture_glcm_homogeneity", "texture_glcm_energy", "texture_glcm_correlation"],
}
#: Pixels that a mask needs for measures of texture, and the radius of the ring around it.
TEXTURED, RING = 16, 5


def _cross(a: tuple, b: tuple, p: tuple) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def hull_pixels(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
    """How many pixel centres lie in the convex hull of a region's pixels, each taken with the middles of its four sides;
    the region is given by the first and last pixel of each row."""
    points = sorted({(float(a), float(b)) for r, x0, x1 in zip(y, low, high, strict=True) for a, b in ((r, x0 - 0.5), (r, x1 + 0.5), (r - 0.5, x0), (r + 0.5, x0), (r - 0.5, x1), (r + 0.5, x1))})
    chains = []
    for way in (points, points[::-1]):
        chain: list[tuple] = []
        for p in way:
            while len(chain) > 1 and _cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain)
    # Both chains run over the rows; between them lies the hull's part of a row.
    rows = np.arange(int(y.min()), int(y.max()) + 1)
    ends = np.sort([np.interp(rows, *np.array(sorted(c)).T) for c in chains], axis=0)
    return int((np.floor(ends[1] + 1e-9) - np.ceil(ends[0] - 1e-9) + 1).sum())


def solidity(px: DataFrame) -> DataFrame:
    """(image, convex_area, solidity): the mask's part of its convex hull. Of a picture, two numbers for each row meet."""
    rows = px.where("in").groupBy("image", "y").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        convex = hull_pixels(group.y.to_numpy(), group.low.to_numpy(), group.high.to_numpy())
        return pd.DataFrame({"image": group.image.iloc[:1], "convex_area": [convex], "solidity": [group.n.sum() / convex]})

    image = rows.schema["image"].dataType.simpleString()
    return rows.groupBy("image").applyInPandas(hull, f"image {image}, convex_area long, solidity double")


def measured(px: DataFrame, least_run: int = 14) -> DataFrame:
    """One row for each image of px (image, y, x, v, in): all measures, component_count, area_fraction,
    selected_fraction, qc_flags and qc_ok. The mask is narrowed to its largest component; a picture without any has null
    measures and the flag empty_mask; measures of texture are null below TEXTURED pixels."""
    pictures = px.groupBy("image").agg(F.count(F.lit(1)).alias("pixels"))
    own = checkpointed(raster.largest(px.withColumn("raw", F.col("in"))))
    parts = own.groupBy("image").agg(F.max("component_count").alias("component_count"), F.max("selected_fraction").alias("selected_fraction"))
    shape = raster.shape(own).withColumnsRenamed({"equivalent_diameter": "equivalent_diameter_area", "major_axis": "major_axis_length", "minor_axis": "minor_axis_length"})
    intensity = raster.intensity(own)
    intensity = intensity.withColumnsRenamed({c: f"intensity_{c}" for c in intensity.columns[1:]})
    grown = raster.dilated(own, RING).where(F.col("in") & ~F.col("raw"))
    ring = grown.groupBy("image").agg(F.avg("v").alias("intensity_background_ring_mean"), F.stddev_pop("v").alias("ring_std"))
    textured = own.join(shape.where(F.col("area") >= TEXTURED).select("image"), "image", "left_semi")
    texture = raster.entropy(textured).withColumnRenamed("entropy", "texture_entropy")
    gradient, patterns, glcm = raster.gradient(textured), raster.pattern_texture(textured), raster.glcm(textured)
    out = pictures
    for some in (parts, shape, raster.perimeter(own), solidity(own).drop("convex_area"), intensity, ring, raster.longest_border_run(own), texture, gradient.withColumnsRenamed({c: f"texture_{c}" for c in gradient.columns[1:]}), raster.edge_density(textured).withColumnRenamed("edge_density", "texture_edge_density"), patterns.withColumnsRenamed({c: f"texture_{c}" for c in patterns.columns[1:]}), glcm.withColumnsRenamed({c: f"texture_{c}" for c in glcm.columns[1:]})):
        out = out.join(some, "image", "left")
    out = out.withColumns({
        "circularity": F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / F.col("perimeter") ** 2),
        "intensity_cell_minus_ring_mean": F.col("intensity_cell_mean") - F.col("intensity_background_ring_mean"),
        "intensity_cell_to_ring_std_ratio": F.when(F.col("ring_std") > 0, F.col("intensity_cell_std") / F.col("ring_std")),
        "area_fraction": F.col("area") / F.col("pixels"),
    })
    out = out.withColumn("qc_flags", raster.quality_flags(F.col("area_fraction"), F.col("selected_fraction"), F.col("longest_run"), least_run))
    names = [name for kind in MEASURES.values() for name in kind]
    return out.select("image", *[F.col(n).cast("double").alias(n) for n in names], F.coalesce("component_count", F.lit(0)).alias("component_count"), "area_fraction", "selected_fraction", "qc_flags", (F.col("qc_flags") == "ok").alias("qc_ok"))
