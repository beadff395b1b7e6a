"""What the operators of this subpackage share: columns, scratch tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import inspect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.session import checkpoint_folder, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word, for Java's and RE2's engines alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one class that may be sorted for the last places among the most frequent.
FEW = 1 << 16

#: A key of more than one row in so many is hot; bytes, as JSON, of a row about it that is sent to all tasks.
HOT, HOT_BYTES = 4096, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z only. Texts of single-byte characters take the fast path, which gives the same there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that later jobs neither recompute it nor depend on the
    executors that made it."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(names) -> list[Column]:
    """Columns by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"__{name}").lower() in taken:
            pass
        out.append(name)
    return out


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with the row of groups that has their key; size: the column of groups that counts the rows of a key.

    A key that more than one row in HOT has, of which there are fewer than HOT, doesn't meet its rows in one task: such
    rows of groups go to wherever their rows are, if they are all short enough to be sure of what that takes. Long keys
    come as digests.
    """
    groups = scratch_table(groups, "groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > max(1, total // HOT))
    hot = scratch_table(hot.where(F.octet_length(F.to_json(F.struct("*"))) <= HOT_BYTES), "hot-groups")
    if hot.isEmpty():
        return rows.join(groups, key)
    keys = F.broadcast(hot.select(key))
    cool = rows.join(keys, key, "left_anti").join(groups.join(keys, key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cool)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deals a small table out for work that is heavy for each row."""
    return df.repartition(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *cols)


def released() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy() -> None:
    """The same after garbage is collected: a Python worker stays for later tasks, of the JVM too, that need the memory."""
    gc.collect()
    released()


def tidied(work):
    """A function of a task, over batches or over a group, that tidies up behind itself."""

    def batches(found):
        try:
            yield from work(found)
        finally:
            tidy()

    def group(rows):
        try:
            return work(rows)
        finally:
            tidy()

    def both_groups(left, right):
        try:
            return work(left, right)
        finally:
            tidy()

    if inspect.isgeneratorfunction(work):
        return batches
    return group if len(inspect.signature(work).parameters) == 1 else both_groups


def most_frequent(df: DataFrame, n: str, most: int, few: int = FEW) -> DataFrame:
    """The rows with the largest counts, so many if there are; of equal counts, those with the smallest hash of the row.
    Only histograms come to the driver: of the counts' five leading bits, then, inside the class that doesn't fit whole,
    of further bits of the count and of the hash, until at most `few` rows are left there, which are sorted."""
    columns = df.columns
    df = scratch_table(df.withColumn("__tie", F.xxhash64(*columns)), "counts")
    lead = F.expr(f"shiftleft(shiftright({n}, greatest(length(bin({n})) - 5, 0)), greatest(length(bin({n})) - 5, 0))")
    counts = [-F.shiftright(n, k) for k in range(50, -1, -10)]
    hashes = [F.shiftrightunsigned("__tie", k) for k in (54, 44, 34, 24, 14, 4, 0)]
    taken, inside, left = F.lit(False), F.lit(True), most
    for key in (-lead, *counts, *hashes):
        # Up to the class that doesn't fit whole everything is taken; the next step looks into that class alone.
        full = None
        for r in sorted(df.where(inside).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: r.key):
            if r.rows > left:
                full = r
                break
            left -= r.rows
        if full is None:
            return df.where(taken | inside).select(*columns)
        taken, inside = taken | (inside & (key < full.key)), inside & (key == full.key)
        if not left or full.rows <= few:
            break
    best = df.where(taken)
    if left:
        best = best.union(df.where(inside).orderBy(F.desc(n), "__tie", *columns).limit(left))
    return best.select(*columns)


def pieces(batch: pa.RecordBatch, text: int, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most so many bytes of text each; a longer text has a range of its own."""
    col = batch.column(text)
    lengths = np.zeros(len(col), np.int64)
    if len(col):
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
