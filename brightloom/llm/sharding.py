"""Sharding along a Hilbert curve over several metadata dimensions, cut into runs of equal length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import quoted, scratch_table, text_or_empty, with_group
from brightloom.llm.ranking import hash32, ranked, split_bits

SHARDS, BITS, ACCURACY = 16, 4, 10_000


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of coords, integers of so many bits (Skilling 2004): undo the excess
    work of each bit, Gray-code, then interleave."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ordinal(col: Column) -> Column:
    """A number that sorts like the string's first seven bytes."""
    return F.conv(F.substring(F.rpad(F.hex(F.encode(col, "utf-8")), 14, "0"), 1, 14), 16, 10).cast("long")


def with_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the place of each row's string among all distinct ones, in the order of whole strings."""
    sizes = scratch_table(rows.groupBy(value).agg(F.count(F.lit(1)).alias("__rows")), "shard-values")
    places = ranked(sizes.withColumn("__lead", ordinal(F.col(value))), ["__lead"], [F.col(value)], rank=out, name="shard-value-ranks")
    return with_group(rows, places.select(value, out, "__rows"), value, "__rows").drop("__rows")


def quantised(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Adds q_<dim>: which of 2**bits quantiles of the dimension the row is in. Only the quantiles come to the driver."""
    n = 1 << bits
    at = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = df.agg(*[F.percentile_approx(d, at, F.lit(ACCURACY)).alias(d) for d in dims]).first()
    for d in dims:
        # Equal cuts, from values that repeat, count once.
        edges = sorted(set(cuts[d] or []))
        df = df.withColumn(f"q_{d}", sum((F.when(F.col(d) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)) if edges else F.lit(0))
    return df


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("source", "lang"), bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id_col, size, text_crc32, the quantised dimensions, curve, shard, slot and, if there
    are columns to keep, a struct of those named row.

    Dimensions are the metadata columns, by the places of their values among all values, the size and, if it is a whole
    number, the id. Rows are sorted by their cell's place on the curve, then by a hash of the id, and the order is cut
    into runs whose counts differ by at most one; slot is the row's place in its run. A file for each run so covers a
    narrow range of every dimension. A null text has no bytes; null metadata count as empty, null ids as 0; repeated rows
    take places of their own; other columns don't matter. An empty table gives an empty result.
    """
    body = text_or_empty(text)
    numeric = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    carried = [F.struct(*quoted(keep)).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"m_{i}") for i, m in enumerate(metadata)], *carried)
    rows = scratch_table(rows.withColumn("hash", hash32("id")).withColumn("d_id", F.coalesce(F.col("id"), F.lit(0)) if numeric else F.lit(0)), "shard-rows")
    for i in range(len(metadata)):
        rows = with_rank(rows, f"m_{i}", f"d_{i}")
    dims = {**{f"d_{i}": m for i, m in enumerate(metadata)}, "size": "size", **({"d_id": "id"} if numeric else {})}
    rows = quantised(scratch_table(rows, "shard-ranks"), list(dims), bits)

    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack(cols), bits))

    curve = F.pandas_udf(index, "long")(*[F.col(f"q_{d}") for d in dims])
    n = rows.count()
    # A cell is split by bits of the hash, which is part of the order, so many as the rows there are ask for.
    rows = rows.withColumn("curve", curve).withColumn("part", F.shiftright("hash", 32 - split_bits(n)))
    rows = scratch_table(rows.withColumn("high", F.shiftright("curve", len(dims) * bits // 2)), "shard-cells")
    out = ranked(rows, ["high", "curve", "part"], ["hash", "d_id", "crc", "size"], rank="rank", name="shard-counts")
    few, more = divmod(n, shards)  # the first `more` runs hold one row more
    long_runs = more * (few + 1)
    shard = F.when(F.col("rank") < long_runs, F.floor(F.col("rank") / F.lit(few + 1))).otherwise(F.lit(more) + F.floor((F.col("rank") - long_runs) / F.lit(max(few, 1))))
    slot = F.when(F.col("rank") < long_runs, F.pmod("rank", F.lit(few + 1))).otherwise(F.pmod(F.col("rank") - long_runs, F.lit(max(few, 1))))
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), *[F.col(f"q_{d}").alias(f"q_{name}") for d, name in dims.items()], "curve", "shard", "slot", *(["row"] if keep else []))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **how) -> None:
    """Writes docs as Parquet, every row in its own place: a folder for each shard and in it as many files as its size
    asks for, rows in curve order; readers prune by the files' statistics. The folders' column is named shard, with an
    underscore before it where docs has such a column."""
    placed = hilbert_shards(docs, id_col=id_col, keep=tuple(docs.columns), **how).select("shard", "slot", "row")
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    out = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
