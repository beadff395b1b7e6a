"""Connected components of a table of links, of any size, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import scratch_table


def _lowest(links: DataFrame, near: str, far: str) -> DataFrame:
    return links.groupBy(near).agg(F.min(far).alias("__low"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low")), F.bit_xor("low")).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(id, root) for every id that has a link to another: root is the smallest id that it reaches.

    Rounds of large-star and small-star (Kiveris et al. 2014): each id passes on the smallest of its neighbours. Links
    to a hub are split like any skewed join's rows, and every round is written to the shared folder. Loops and repeated
    links don't matter; without links the result is empty.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    pairs = scratch_table(pairs, "links")
    mark = _mark(pairs)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = pairs.select(F.col("high").alias("u"), F.col("low").alias("v")).union(pairs.select(F.col("low").alias("u"), F.col("high").alias("v")))
        low = _lowest(both, "u", "v").select("u", F.least("u", "__low").alias("__low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("high"), F.col("__low").alias("low")).distinct()
        large = scratch_table(large, "large-star")
        low = _lowest(large, "high", "low")
        moved = F.when(F.col("low") == F.col("__low"), F.col("high")).otherwise(F.col("low"))
        small = large.join(low, "high").select(moved.alias("high"), F.col("__low").alias("low")).distinct()
        pairs, before = scratch_table(small, "small-star"), mark
        mark = _mark(pairs)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components didn't settle within {rounds} rounds")
    return pairs.select(F.col("high").alias("id"), F.col("low").alias("root"))
