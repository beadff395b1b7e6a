"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.common import WORD, quoted, scratch_table, text_or_empty
from brightloom.llm.ranking import hash32, ranked, split_bits

#: Weights of the sources, in their order and repeating; what the mix takes of all sizes; the most of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (__s, __source, __source_size), a row for each source: adds __target and __rate, the copies expected of a document.

    Sources at their limit are a prefix when sorted by limit over weight; the rest share what is left by weight, which
    is where resharing the excess again and again ends.
    """
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("__w", weight).withColumn("__cap", F.col("__source_size") * F.lit(float(most)))
    level = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.sum("__source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("__level", left / F.sum("__w").over(level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("__level", F.max(F.when(F.col("__cap") / F.col("__w") > F.col("__level"), F.col("__level"))).over(everything))
    t = t.withColumn("__target", F.coalesce(F.least("__cap", F.col("__w") * F.col("__level")), F.col("__cap")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    return t.select("__s", "__source_size", "__target", rate.alias("__rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs with the columns to keep (all if None), then four columns more, always the last: the size in
    words, the source's size, its target, and the copies that the mix takes. They are named size, source_size, target and
    copies, with underscores before them where a kept column has that name.

    Within a source, documents stand in the order of their sizes, cut to five leading bits, and then of a hash of their
    ids; each adds its expected copies (target over source size) to a running sum that starts at a random offset of the
    source, and is taken once for each whole number that the sum passes. Neighbours in that order have nearly equal
    sizes, so the words taken of a source differ from its target by about one document. Null texts have size 0 and take
    part; a null source is a source, the last; ids may be of any type that has a text; repeated rows are documents of
    their own; rows with equal size and id are told apart by nothing, and any of them may be taken. A rerun takes the
    same copies. An empty table gives an empty result.
    """
    kept = list(docs.columns if keep is None else keep)
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    # What is kept travels in one column, so that no name of it meets one of ours.
    sized = docs.select(F.struct(*quoted(kept)).alias("row"), size.alias("size"), key.alias("s"), F.col(id_col).alias("id"), F.col(source).alias("__source"))
    sized = sized.withColumn("class", F.expr("shiftleft(shiftright(size, greatest(length(bin(size)) - 5, 0)), greatest(length(bin(size)) - 5, 0))"))
    sized = sized.withColumn("hash", hash32("id"))
    small = scratch_table(sized.drop("row"), "mix-sizes")
    goals = scratch_table(targets(small.groupBy(F.col("s").alias("__s")).agg(F.first("__source").alias("__source"), F.sum("size").alias("__source_size")), weights, share, most), "mix-targets")
    # The order is by the whole hash; how many of its bits split a class into buckets depends on the rows there are.
    bits = split_bits(small.count())
    part = F.shiftright("hash", 32 - bits)
    out = ranked(sized.withColumn("part", part), ["class", "part"], [F.col("hash"), F.col("size"), F.col("id").asc_nulls_last()], ["s"], "rank", "mix-ranks", counted=small.withColumn("part", part))
    # The hash's leading 52 bits, as a fraction.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("s"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    crossed = F.floor(offset + F.col("__rate") * (F.col("rank") + 1)) - F.floor(offset + F.col("__rate") * F.col("rank"))
    out = out.join(goals, F.col("s") == F.col("__s")).withColumn("copies", F.least(crossed, F.lit(most)).cast("int"))
    names = []
    for name in ("size", "source_size", "target", "copies"):
        while name in kept:
            name = f"_{name}"
        names.append(name)
    return out.select("row.*", *[F.col(c).alias(n) for c, n in zip(("size", "__source_size", "__target", "copies"), names, strict=True)])


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its own columns."""
    mixed = mix(docs, **how)
    copies = mixed.columns[-1]
    return mixed.withColumn(copies, F.explode(F.expr(f"if({copies} > 0, sequence(1, {copies}), array())"))).select(*quoted(docs.columns))
