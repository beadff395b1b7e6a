"""Masks laid over pictures: which pictures get one, and their pixels, by joins over tables of pixels in three channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.filters import ContractError, first_failure

CHANNELS = ("r", "g", "b")
#: The colour, and the states of a mask that can be shown.
GREEN, SHOWN = (0, 255, 0), ("ok", "empty")


def overlay_jobs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_id, processed_path, mask_path, overlay_path, skipped) for each picture of a run. A picture is skipped, and
    skipped says why, if it wasn't made ready, has no mask, or its mask failed. The overlay's path follows the picture's,
    whose last .png goes if a name with an ending of its own is left. Masks are one for each picture."""
    masks = masks.select("image_id", F.col("status").alias("__status"), "mask_path")
    rows = images.join(masks, "image_id", "left")
    why = first_failure([(~F.col("preprocess_status").eqNullSafe("ok"), "picture not ready"), (F.col("__status").isNull(), "no mask"), (~F.col("__status").isin(*SHOWN), "mask failed"), (F.col("processed_path").isNull() | F.col("mask_path").isNull(), "no file")])
    inside = F.regexp_replace(F.regexp_replace("processed_path", r"^images/", ""), r"(\.[^./]+)\.png$", "$1")
    path = F.concat(F.lit("overlays/"), inside)
    return rows.select("image_id", "processed_path", "mask_path", F.when(why.isNull(), path).alias("overlay_path"), why.alias("skipped"))


def blended(px: DataFrame, mask: DataFrame, alpha: float = 0.4, colour: tuple[int, int, int] = GREEN) -> DataFrame:
    """Pixels (image, y, x, r, g, b) with a colour mixed in where the mask (image, y, x, in) is set; everywhere else they
    stay as they are. Levels are rounded, halves to even. Pictures and masks must have the same pixels."""
    if not 0 <= alpha <= 1:
        raise ContractError("alpha lies between 0 and 1")
    at = ["image", "y", "x"]
    both = px.select(*at, *CHANNELS).join(mask.select(*at, F.col("in").alias("__in")), at, "full")
    mixed = [F.when(F.col("__in"), F.bround(F.col(c) * F.lit(1.0 - alpha) + F.lit(float(k)) * F.lit(float(alpha))).cast("int")).otherwise(F.col(c)) for c, k in zip(CHANNELS, colour, strict=True)]
    # A pixel that one of the two lacks stops the job that meets it.
    whole = F.col("__in").isNotNull() & F.col(CHANNELS[0]).isNotNull()
    checked = F.when(whole, F.col("image")).otherwise(F.raise_error(F.concat(F.lit("picture and mask differ in size: "), F.col("image").cast("string"))))
    return both.select(checked.alias("image"), "y", "x", *[m.alias(c) for m, c in zip(mixed, CHANNELS, strict=True)])


def beside(px: DataFrame, overlay: DataFrame) -> DataFrame:
    """The pictures with their overlays to the right."""
    width = px.groupBy("image").agg((F.max("x") + 1).alias("w"))
    right = overlay.join(width, "image").select("image", "y", (F.col("x") + F.col("w")).alias("x"), *CHANNELS)
    return px.select("image", "y", "x", *CHANNELS).union(right)
