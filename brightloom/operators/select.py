"""Selections: samples in a seeded order, round robins, extremes, and sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.operators.filters import extreme_in_both, numbered


def seeded(seed: int, key: str):
    """An order that looks random and is the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def round_robin(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first of each group, then the second of each, and so on, until there are n."""
    # No group gives more than n: Spark keeps that many of each before it deals groups out, and sorts those alone.
    return numbered(df, [group], [key]).where(F.col("rn") <= n).orderBy("rn", group, key).limit(n)


def group_head(df: DataFrame, keys: list[str], key: str, n: int = 1, seed: int = 42) -> DataFrame:
    return numbered(df, keys, [seeded(seed, key), key]).where(F.col("rn") <= n).drop("rn")


def tiered_sample(df: DataFrame, flagged, keys: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """A third of n flagged rows, then one of each group, then any, each row once, n in all."""
    order = seeded(seed, key)
    some = df.where(flagged).orderBy(order, key).limit(n // 3).withColumn("tier", F.lit(0))
    rest = group_head(df, keys, key, 1, seed).withColumn("tier", F.lit(1)).unionByName(df.orderBy(order, key).limit(n).withColumn("tier", F.lit(2)))
    rows = some.unionByName(rest).withColumn("ord", order)
    first = rows.withColumn("again", F.row_number().over(Window.partitionBy(key).orderBy("tier"))).where("again = 1")
    return first.orderBy("tier", "ord", key).limit(n).drop("again", "ord")


def sequential_top(df: DataFrame, first: tuple[str, str, int], second: tuple[str, str, int], key: str, display: list) -> DataFrame:
    """The n most extreme rows by one column, of those the n by another, in the order of display."""
    for c, way, n in (first, second):
        df = df.orderBy(F.col(c).desc() if way == "high" else F.col(c).asc(), key).limit(n)
    return df.orderBy(*display)


def extremes(df: DataFrame, group: tuple[str, str], first: tuple[str, str], second: tuple[str, str], part: float, n: int, key: str, display: list) -> DataFrame:
    """Rows of a group beyond both of its quantiles; the n best by the mean of both scores, which are scaled by the range
    of the whole table and turned around for low ones."""
    ends = df.agg(*[f(c).alias(f"__{k}{i}") for i, (c, _) in enumerate((first, second)) for k, f in (("lo", F.min), ("hi", F.max))])
    chosen = extreme_in_both(df.where(F.col(group[0]) == group[1]), first, second, part).crossJoin(F.broadcast(ends))  # one row
    scores = []
    for i, (c, way) in enumerate((first, second)):
        s = F.try_divide(F.col(c) - F.col(f"__lo{i}"), F.col(f"__hi{i}") - F.col(f"__lo{i}"))
        scores.append(s if way == "high" else 1 - s)
    chosen = chosen.withColumn("combined_score", (scores[0] + scores[1]) / 2).drop("__lo0", "__hi0", "__lo1", "__hi1")
    return chosen.orderBy(F.desc("combined_score"), key).limit(n).orderBy(*display)


def pages(df: DataFrame, order: list, size: int = 12) -> DataFrame:
    """Page numbers of a bounded selection."""
    return df.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def union_missing(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return numbered(df, keys, order).where("rn = 1").drop("rn")


def except_names(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a that b doesn't have."""
    return a.select(column).distinct().join(b.select(column), column, "left_anti")
