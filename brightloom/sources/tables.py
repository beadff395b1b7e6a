"""Readers: tables of a folder, CSV with or without inference of missing values, images and settings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions.clean import known
from brightloom.session import ship

#: Weights of red, green and blue in pictures and in masks; image files that a scan takes up.
LUMINANCE, LUMA = (0.2125, 0.7154, 0.0721), (0.299, 0.587, 0.114)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, missing: bool = False) -> DataFrame:
    """CSV with a header under a schema. Blank strings stay blank, unless missing values are to be told from their text;
    then all that such readers take for missing is null."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: known(c) for c in strings}) if missing else df.na.fill("", strings)


def scan_images(spark: SparkSession, folder: str, recursive: bool = True, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """(image_id, path, content, length) of the image files under a folder; image_id is the path relative to it. An
    error if there are none."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    df = df.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions))
    if df.select("path").isEmpty():
        raise FileNotFoundError(f"no images under {folder}")
    # Paths come with a scheme; the folder's own path, qualified alike, is cut off in front.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    return df.select(F.substr(plain, F.lit(len(root) + 2)).alias("image_id"), "path", "content", "length")


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image source: origin, height, width, nChannels, mode and the pixels as BGR bytes; files that can't be read
    have height -1."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*")


def image_sizes(spark: SparkSession, folder: str, group: str) -> DataFrame:
    df = decode_images(spark, folder).where("height > 0")
    return df.select(F.element_at(F.split("origin", "/"), -1).alias("filename"), F.lit(group).alias("group"), "width", "height", (F.col("width") * F.col("height")).alias("area_pixels"))


def _channels(part: pd.Series) -> np.ndarray:
    """A decoded picture as rows, columns and channels: red, green and blue, or three times the grey."""
    raw = np.frombuffer(part["data"], np.uint8).reshape(part["height"], part["width"], part["nChannels"])
    return raw[:, :, [2, 1, 0]] if part["nChannels"] >= 3 else np.repeat(raw[:, :, :1], 3, axis=2)


def _each_pixel(decoded: DataFrame, weights: tuple[float, float, float], column: str, kind: str, of) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.iterrows():
                rgb, width = _channels(part), int(part["width"])
                for k in range(0, len(rgb), 64):  # rows of a large picture, some at a time
                    some = (rgb[k : k + 64] * np.array(weights)).sum(2)
                    y, x = np.divmod(np.arange(some.size), width)
                    yield pd.DataFrame({"image": part["origin"], "y": (y + k).astype(np.int32), "x": x.astype(np.int32), column: of(some.ravel())})

    return decoded.where("height > 0").select("origin", "height", "width", "nChannels", "data").mapInPandas(run, f"image string, y int, x int, `{column}` {kind}")


def grey_pixels(decoded: DataFrame) -> DataFrame:
    """(image, y, x, v) of decoded pictures: the luminance from 0 to 1. Files that can't be read have no pixels."""
    return _each_pixel(decoded, LUMINANCE, "v", "double", lambda v: v / 255)


def mask_pixels(decoded: DataFrame) -> DataFrame:
    """(image, y, x, in) of pictures that are masks: inside is what is brighter than 127."""
    return _each_pixel(decoded, LUMA, "in", "boolean", lambda v: np.round(v) > 127)


def fingerprinted(files: DataFrame, content: str = "content", out: str = "sha256") -> DataFrame:
    return files.withColumn(out, F.sha2(content, 256))


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))
