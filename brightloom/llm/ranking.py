"""Ranks over a whole table, or over groups of any size, without putting a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.common import scratch_table


#: Rows of a bucket, on average, that are sorted in one task with its whole group in the same class.
BUCKET = 20_000


def hash32(col: str) -> Column:
    """32 bits of the digest of a value as text, alike in any engine; null is a value of its own."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def split_bits(rows: int) -> int:
    """Leading bits of a hash that split so many rows, were they all in one group, into buckets."""
    return min(32, max(0, (rows // BUCKET).bit_length()))


def ranked(df: DataFrame, levels: list[str], ties: list, by: list[str] = (), rank: str = "rank", name: str = "ranks", counted: DataFrame | None = None) -> DataFrame:
    """Adds rank, from 0 within each group of `by`: the order is by the levels, then by ties.

    The levels are non-null columns whose combinations split every group into small buckets. Buckets are counted, the
    counts are summed level by level over ever fewer rows, and only the order inside a bucket is found by sorting rows.
    Each step is a pure function of the rows, so a recomputed task gives the same ranks. counted: a table of the same
    rows' groups and levels that is cheaper to read, if there is one.
    """
    by = list(by)
    keys = by + levels
    counts = scratch_table((df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), name)
    starts, terms = counts.select(*keys), []
    for i in range(len(levels), 0, -1):
        upto = by + levels[:i]
        window = Window.partitionBy(*by, *levels[: i - 1]).orderBy(levels[i - 1]).rowsBetween(Window.unboundedPreceding, -1)
        totals = counts.groupBy(*upto).agg(F.sum("__n").alias("__t"))
        before = totals.select(*upto, F.coalesce(F.sum("__t").over(window), F.lit(0)).alias(f"__b{i}"))
        starts, terms = starts.join(before, upto), [*terms, F.col(f"__b{i}")]
    starts = starts.select(*keys, reduce(lambda a, b: a + b, terms).alias("__start"))
    inside = Window.partitionBy(*keys).orderBy(*ties)
    return df.join(starts, keys).withColumn(rank, F.col("__start") + F.row_number().over(inside) - 1).drop("__start")
