"""Connected components by contraction.

In a round every vertex goes over to the one with the least hash among itself and its neighbours, and links between
vertices that went to the same one vanish. Hashes change with the round, so about half of the vertices of even a long path
are left after each, and the number of rounds grows with the logarithm of the table. Then the rounds are gone through
backwards, and every vertex learns the least id of where it ended up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.session import sorted_side, stored


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(id, root) for every id that has a link to another one: the least id that it reaches. Ids are of any type that can be
    ordered, structs too. Loops, repeated links and those with a null don't matter. An error if links are left after so many
    rounds, which chance makes as good as impossible."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col(a) != F.col(b))
    edges = stored(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    lows, levels = None, []
    for turn in range(rounds):
        if edges.isEmpty():
            break
        by_hash: Column = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("hash"), F.col(c).alias("id"))
        best = edges.groupBy("u").agg(F.min(by_hash("v")).alias("near"))
        went = stored(best.select("u", F.least("near", by_hash("u"))["id"].alias("to")), "contraction")
        low = went.select("to", F.col("u").alias("low")) if lows is None else went.join(sorted_side(lows), "u").select("to", "low")
        lows = stored(low.groupBy("to").agg(F.min("low").alias("low")).withColumnRenamed("to", "u"), "lows")
        levels.append((went, lows))
        edges = edges.join(sorted_side(went), "u").select(F.col("to").alias("u"), F.col("v").alias("w")).join(sorted_side(went.select(F.col("u").alias("w"), F.col("to").alias("v"))), "w").where("u <> v").select("u", "v").distinct()
        edges = stored(edges, "links")
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"components didn't settle within {rounds} rounds")
    out = None
    for went, lows in reversed(levels):
        ends = lows.select(F.col("u").alias("to"), "low")
        if out is not None:
            ends = ends.join(sorted_side(out.select(F.col("id").alias("to"), "root")), "to", "left").select("to", F.coalesce("root", "low").alias("low"))
        out = stored(went.join(sorted_side(ends), "to").select(F.col("u").alias("id"), F.col("low").alias("root")), "roots")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")) if out is None else out
