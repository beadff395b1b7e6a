"""Ranks within groups of any size, by a scan over ranges.

Rows are dealt out by ranges of their group and value, so a large group lies in many tasks, one range after the other. Each
task ranks what it has. What ranges carry over to others (how many rows lie before, or the least value behind) is a row for
each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import stored


def step_up(rows: DataFrame, p: Column, by: list[Column], key: list[Column]) -> DataFrame:
    """Adds q: for each row the least p * m / rank over the rows of its group from its own rank on, 1 at most; m is the
    group's size and ranks rise with p. Equal values get the same q. Rows that are equal in p are told apart by `key`, so
    that ranges can part them."""
    ties = F.xxhash64(*key) if key else F.monotonically_increasing_id()
    group = F.struct(*[c.alias(f"b{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("b0"))
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(F.struct("*").alias("row"), group.alias("by"), p.alias("p"), ties.alias("tie")).repartitionByRange(n, "by", "p", "tie")
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    at = ["by", "range"]
    upto = Window.partitionBy("by").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*at, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("by")).alias("m"))
    inside = Window.partitionBy(*at)
    ranked = dealt.join(sizes, at).withColumn("rank", F.col("before") + F.row_number().over(inside.orderBy("p", "tie")))
    ranked = ranked.withColumn("value", F.col("p") * F.col("m") / F.col("rank"))
    behind = Window.partitionBy("by").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy(*at).agg(F.min("value").alias("least")).select(*at, F.min("least").over(behind).alias("behind"))
    own = F.min("value").over(inside.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.join(least, at).select("row.*", F.least(own, F.coalesce("behind", F.lit(1.0)), F.lit(1.0)).alias("q"))
