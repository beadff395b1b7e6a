"""Raw pictures made ready: the bar on top found and cut off, the box around the cell found, padded and cut out.

Tables of pixels as in `raster`, with grey levels v from 0 to 255. Blurs, and squares grown or shrunk, are one pass along the
rows and one along the columns of a picture, so that what a task takes up is a line, not a picture.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.operators.raster import EIGHT, components
from brightloom.session import stored

#: Fixed values of the bar: the part of the height and the rows it may take, the level below which a pixel is dark, the part
#: of them that makes a row dark, the rows after which the first other row ends it, and what lies above its edge.
BAR_PART, BAR_ROWS, DARK, DARK_ROW, PLAUSIBLE, ABOVE = 0.30, 220, 55, 0.70, 8, 0.55
#: Fixed values of the box: blurs as (radius, deviation), squares of the closing and the opening, and what a component may be.
BLUR, GROUND, CLOSING, OPENING = (3, 1.4), (63, 21.0), 4, 2
LEAST_PART, MOST_PART, FLAT, TALL, CENTRAL = 0.004, 0.70, 6.0, 0.15, 6.0


def top_bars(px: DataFrame) -> DataFrame:
    """(image, bar): how many rows on top are a dark bar. Rows count as they come: the first that isn't dark, once there
    are as many as make a bar plausible, ends it. The strongest change of a row's mean takes its place where that lies
    deeper and what is above it is dark enough."""
    rows = px.groupBy("image", "y").agg(F.avg((F.col("v") < DARK).cast("double")).alias("dark"), F.avg("v").alias("mean"))
    height = px.groupBy("image").agg((F.max("y") + 1).alias("h"))
    most = F.least(F.floor(F.col("h") * BAR_PART), F.lit(BAR_ROWS)).cast("int")
    top = rows.join(height.select("image", most.alias("most")), "image").where(F.col("y") < F.col("most"))
    whole, down = Window.partitionBy("image"), Window.partitionBy("image").orderBy("y")  # at most BAR_ROWS rows
    is_dark = F.col("dark") >= DARK_ROW
    top = top.withColumn("from", F.min(F.when(is_dark & (F.col("y") >= PLAUSIBLE - 1), F.col("y"))).over(whole))
    top = top.withColumn("stop", F.min(F.when(~is_dark & (F.col("y") > F.col("from")), F.col("y"))).over(whole))
    top = top.withColumns({"step": F.abs(F.col("mean") - F.lag("mean").over(down)), "above": F.avg("dark").over(down.rowsBetween(Window.unboundedPreceding, -1))})
    edge = F.max_by(F.struct("y", "above"), F.struct(F.round("step", 9), -F.col("y")))  # the first of equals
    found = top.groupBy("image", "most").agg(F.max(F.when(is_dark & (F.col("stop").isNull() | (F.col("y") < F.col("stop"))), F.col("y") + 1)).alias("end"), F.max(F.when(F.col("y") > 0, F.col("y"))).alias("any"), edge.alias("edge"))
    fits = F.col("edge.y").between(6, F.col("most") - 2) & (F.col("edge.above") >= ABOVE)
    bar = F.greatest(F.coalesce("end", F.lit(0)), F.when(fits, F.col("edge.y")).otherwise(0))
    bar = F.when(F.col("most") > 4, F.least(bar, F.col("most"))).otherwise(0)
    return height.select("image").join(found.select("image", bar.alias("bar")), "image", "left").select("image", F.coalesce("bar", F.lit(0)).cast("int").alias("bar"))


def along(px: DataFrame, axis: str, work: Callable[[np.ndarray], np.ndarray], value: str = "v") -> DataFrame:
    """(image, y, x, value) with `work` done to each line of whole pictures along an axis, x or y."""
    other = "y" if axis == "x" else "x"
    lines = px.groupBy("image", other).agg(F.array_sort(F.collect_list(F.struct(axis, F.col(value).cast("double").alias("v")))).alias("line"))
    lines = lines.select("image", other, F.col("line.v").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [work(np.asarray(line.values)) for line in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.list_(pa.float64()))], ["image", other, "line"])

    kinds = dict(px.dtypes)
    return lines.mapInArrow(run, f"image {kinds['image']}, {other} {kinds[other]}, line array<double>").select("image", other, F.posexplode("line").alias(axis, value))


def gaussian(radius: int, deviation: float) -> Callable[[np.ndarray], np.ndarray]:
    """A blur along a line, which is reflected at its ends without repeating them."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * deviation**2))
    k /= k.sum()
    return lambda line: np.convolve(np.pad(line, radius, mode="reflect"), k, "valid")


def extreme(radius: int, largest: bool) -> Callable[[np.ndarray], np.ndarray]:
    """The greatest or least value up to a distance along a line."""
    of, beyond = (np.max, -np.inf) if largest else (np.min, np.inf)
    return lambda line: of(np.lib.stride_tricks.sliding_window_view(np.pad(line, radius, constant_values=beyond), 2 * radius + 1), axis=1)


def blurred(px: DataFrame, radius: int, deviation: float) -> DataFrame:
    """Whole levels again: halves go up."""
    out = along(along(px, "x", gaussian(radius, deviation)), "y", gaussian(radius, deviation))
    return out.select("image", "y", "x", F.floor(F.round("v", 6) + 0.5).cast("int").alias("v"))


def squared(px: DataFrame, radius: int, largest: bool) -> DataFrame:
    return along(along(px, "x", extreme(radius, largest)), "y", extreme(radius, largest))


def split_levels(px: DataFrame) -> DataFrame:
    """(image, cut): the whole level that parts a picture's with the greatest variance between what is above and the rest;
    0 where all are equal."""
    n = px.groupBy("image", "v").agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("image").orderBy("v"), Window.partitionBy("image")  # at most 256 levels
    n = n.withColumns({"w1": F.sum("n").over(upto), "s1": F.sum(F.col("n") * F.col("v")).over(upto), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("v")).over(whole)})
    apart = (F.col("w1") * F.col("s") - F.col("w") * F.col("s1")).cast("double")
    between = F.when(F.col("w1") < F.col("w"), apart * apart / (F.col("w1") * (F.col("w") - F.col("w1"))))
    best = n.groupBy("image").agg(F.max_by("v", F.when(between > 0, F.struct(between, -F.col("v")))).alias("cut"))
    return best.select("image", F.coalesce("cut", F.lit(0)).alias("cut"))


def foreground(px: DataFrame) -> DataFrame:
    """(image, y, x, in): where a blurred picture differs from its background, closed and opened by squares."""
    soft = stored(blurred(px, *BLUR), "soft")
    ground = blurred(soft, *GROUND).withColumnRenamed("v", "ground")
    differs = stored(soft.join(ground, ["image", "y", "x"]).select("image", "y", "x", F.abs(F.col("v") - F.col("ground")).alias("v")), "differs")
    mask = differs.join(split_levels(differs), "image").select("image", "y", "x", (F.col("v") > F.col("cut")).cast("double").alias("v"))
    closed = squared(squared(mask, CLOSING, True), CLOSING, False)
    return squared(squared(closed, OPENING, False), OPENING, True).select("image", "y", "x", (F.col("v") > 0.5).alias("in"))


def cell_boxes(px: DataFrame, ignore_top: float = 0.12) -> DataFrame:
    """(image, x1, y1, x2, y2): the box, ends exclusive, around the component of the foreground that is large and central;
    nulls where none has a fitting size and form, or starts below what is ignored on top."""
    size = px.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    parts = components(foreground(px), EIGHT).where("component is not null")
    box = parts.groupBy("image", "component").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), F.count(F.lit(1)).alias("area")).join(size, "image")
    pixels, form = F.col("h") * F.col("w"), F.col("bw") / F.col("bh")
    fits = F.col("area").between(pixels * LEAST_PART, pixels * MOST_PART) & (F.col("y") >= F.floor(F.col("h") * ignore_top)) & form.between(TALL, FLAT)
    off = ((F.col("x") + F.col("bw") / 2 - F.col("w") / 2) / F.col("w")) ** 2 + ((F.col("y") + F.col("bh") / 2 - F.col("h") / 2) / F.col("h")) ** 2
    score = F.col("area") / (1 + CENTRAL * off)
    best = box.where(fits).groupBy("image").agg(F.max_by(F.struct("x", "y", "bw", "bh"), F.struct(F.round(score, 9), -F.col("component"))).alias("b"))
    ends = [F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), (F.col("b.x") + F.col("b.bw")).alias("x2"), (F.col("b.y") + F.col("b.bh")).alias("y2")]
    return size.select("image").join(best.select("image", *ends), "image", "left")


def crops(px: DataFrame, bar: int | None = None, pad: int = 16, ignore_top: float = 0.12) -> DataFrame:
    """A record for each picture: image, raw_width, raw_height, top_bar_px (found, or the one given), roi_used, crop_x,
    crop_y, width and height. A bar leaves one row at least; the box is padded within the picture; without a box all below
    the bar is kept."""
    size = px.groupBy("image").agg((F.max("x") + 1).alias("raw_width"), (F.max("y") + 1).alias("raw_height"))
    bars = top_bars(px) if bar is None else size.select("image", F.lit(max(0, bar)).alias("bar"))
    known = stored(size.join(bars, "image").withColumn("bar", F.least("bar", F.col("raw_height") - 1)), "bars")
    below = px.join(known.select("image", "bar"), "image").where(F.col("y") >= F.col("bar")).select("image", (F.col("y") - F.col("bar")).alias("y"), "x", "v")
    found = known.join(cell_boxes(below, ignore_top), "image")
    high = F.col("raw_height") - F.col("bar")
    # The greatest and least of a column and a null is the column: without a box everything is kept.
    low, far = lambda c: F.greatest(F.lit(0), F.col(c) - pad), lambda c, most: F.least(most, F.col(c) + pad)
    cut = found.withColumns({"cx": low("x1"), "cy": low("y1"), "ex": far("x2", F.col("raw_width")), "ey": far("y2", high)})
    return cut.select("image", "raw_width", "raw_height", F.col("bar").alias("top_bar_px"), F.col("x1").isNotNull().alias("roi_used"), F.col("cx").alias("crop_x"), (F.col("bar") + F.col("cy")).alias("crop_y"), (F.col("ex") - F.col("cx")).alias("width"), (F.col("ey") - F.col("cy")).alias("height"))


def cropped(px: DataFrame, records: DataFrame) -> DataFrame:
    """The pixels inside the crops, with all their columns, counted from the crop's corner."""
    at = records.select("image", "crop_x", "crop_y", "width", "height")
    inside = px.join(at, "image").where(F.col("x").between(F.col("crop_x"), F.col("crop_x") + F.col("width") - 1) & F.col("y").between(F.col("crop_y"), F.col("crop_y") + F.col("height") - 1))
    return inside.withColumns({"y": F.col("y") - F.col("crop_y"), "x": F.col("x") - F.col("crop_x")}).select(*px.columns)


def processed(files: DataFrame, records: DataFrame, image: str = "origin", failed: Column | None = None) -> DataFrame:
    """The manifest: a row for each file with its crop's record, processed_path (the file's name keeps its ending, so that
    files that differ in it alone don't meet), preprocess_status and error."""
    bad = F.col("height") < 0 if failed is None else failed
    known = files.select(F.col(image).alias("image"), bad.alias("bad")).join(records, "image", "left")
    error = F.when(F.col("bad") | F.col("raw_width").isNull(), "image could not be decoded")
    return known.select("*", F.when(error.isNull(), F.concat(F.lit("images/"), "image", F.lit(".png"))).alias("processed_path"), F.when(error.isNull(), "ok").otherwise("error").alias("preprocess_status"), F.coalesce(error, F.lit("")).alias("error")).drop("bad")
