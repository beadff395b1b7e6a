"""Exact order statistics of groups of any size.

No task holds a group's values. Each group that is too large to be sorted is counted in bins of the leading digits of its
values; the bin that holds a rank is narrowed down in further rounds, until it has few rows or one value, and only that bin
is sorted. What goes between tasks are counts of bins, and in the end few rows for each rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import stored

#: Rows of a bin that are sorted in one task; bins of a round; intervals that are sent to all tasks.
FEW, BINS, SENT = 1 << 18, 1024, 20_000


def _lead(v: Column) -> Column:
    """A whole number that rises with v: its sign and the eighths of its power of two. Infinite values lie at the ends."""
    power = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0)) + 1101
    return F.when(v == 0, F.lit(0)).otherwise(F.floor(F.signum(v) * F.floor(power * 8))).cast("long")


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v between lo and hi, which rises with v: by the leading digits where those tell the ends apart, else so
    many equal parts. The ends never share a bin unless they are equal."""
    part = F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("long")
    return F.when(_lead(lo) != _lead(hi), _lead(v)).when(lo < hi, part).otherwise(0)


def _values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(k0, k1, ..., c, v): a row for each value that is neither null nor NaN, of groups whose keys aren't null."""
    given = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    parts = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    rows = df.select(*given, F.explode(parts).alias("p")).select(*[f"k{i}" for i in range(len(keys))], "p.c", "p.v")
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v")).dropna(subset=[f"k{i}" for i in range(len(keys))])


def _within(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the spans of their group that they lie in. Spans are sent to all tasks if they are known to be few; Spark
    splits large groups of the join otherwise."""
    few = spans.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(spans) if few else spans, by).where(F.col("v").between(F.col("lo"), F.col("hi")))


def _pick(wanted: DataFrame, counted: DataFrame, on: list[str], order: str) -> DataFrame:
    """For each rank the row of `counted`, which counts the rows (n) of parts of a span in their order, that it falls in;
    below: how many rows of the group lie before."""
    upto = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    left = F.col("rank") - F.col("below")
    return wanted.join(ends, on).where((left >= F.col("start")) & (left < F.col("end"))).withColumn("below", F.col("below") + F.col("start"))


def order_statistics(rows: DataFrame, by: list[str], ranks: Column, few: int = FEW) -> DataFrame:
    """(by, size, rank, value) of rows (by, v): for each group the values at the ranks (from 0) that the column `ranks`
    makes of its size, an array of longs."""
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = ends.select(*by, "size", "lo", "hi", F.col("size").alias("n"), F.explode(F.array_distinct(ranks)).alias("rank")).withColumn("below", F.lit(0).cast("long"))
    wanted, known, span = stored(wanted, "ranks"), [], [*by, "lo", "hi"]
    kept = [*by, "size", "rank", "value"]
    small = (F.col("size") <= few) & (F.col("lo") < F.col("hi"))
    sort_whole, todo = wanted.where(small), wanted.where(~small)
    ready = None
    while True:
        one = todo.where("lo = hi")
        known.append(one.withColumn("value", F.col("lo")).select(*kept))
        todo = todo.where("lo < hi")
        done = todo.where(F.col("n") <= few)
        ready = done if ready is None else ready.unionByName(done)
        todo = todo.where(F.col("n") > few)
        if todo.isEmpty():
            break
        spans = todo.select(*span).distinct()
        counted = _within(rows, spans, by).groupBy(*span, _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        todo = _pick(todo.drop("n"), counted, span, "bin").select(*by, "size", F.col("low").alias("lo"), F.col("high").alias("hi"), "n", "rank", "below")
        todo = stored(todo, "ranks")
    # Whole groups that are small: no join is needed to find their rows. Of large ones only the last bins are sorted.
    counts = [F.count(F.lit(1)).alias("n")]
    if not sort_whole.isEmpty():
        each = rows.groupBy(*by, "v").agg(*counts)
        large = wanted.where(~small).select(*by).distinct()
        if not large.isEmpty():
            sent = large.limit(SENT + 1).count() <= SENT
            each = rows.join(F.broadcast(large) if sent else large, by, "left_anti").groupBy(*by, "v").agg(*counts)
        known.append(_pick(sort_whole.drop("n", "lo", "hi"), each, by, "v").withColumn("value", F.col("v")).select(*kept))
    if not ready.isEmpty():
        each = _within(rows, ready.select(*span).distinct(), by).groupBy(*span, "v").agg(*counts)
        known.append(_pick(ready.drop("n"), each, span, "v").withColumn("value", F.col("v")).select(*kept))
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    return out


def quantiles(df: DataFrame, keys: list[str], wanted: list[tuple[str, str, float]], few: int = FEW) -> DataFrame:
    """For each group a row of its keys and the exact quantile of each (name, column, q), between neighbours in proportion.

    Nulls and NaN are left out, so are rows with a null key; -0.0 is 0.0; a group without values in any column has no row,
    one without values of a column a null there. Without keys the whole table is one group, and there is one row in any
    case.
    """
    columns = list(dict.fromkeys(c for _, c, _ in wanted))
    by = [*[f"k{i}" for i in range(len(keys))], "c"]
    rows = _values(df, keys, columns)
    place = lambda q: (F.col("size") - 1) * F.lit(float(q))
    needed = {c: sorted({q for _, x, q in wanted if x == c}) for c in columns}
    ranks = F.lit(None).cast("array<bigint>")
    for i, c in enumerate(columns):
        of = [f(place(q)).cast("long") for q in needed[c] for f in (F.floor, F.ceil)]
        ranks = F.when(F.col("c") == i, F.array(*of)).otherwise(ranks)
    found = order_statistics(rows, by, ranks, few)
    sums = []
    for name, c, q in wanted:
        here = F.col("c") == columns.index(c)
        low, high = (F.max(F.when(here & (F.col("rank") == f(place(q)).cast("long")), F.col("value"))) for f in (F.floor, F.ceil))
        part = F.max(F.when(here, place(q) - F.floor(place(q))))
        sums.append(F.when(part > 0, low * (1 - part) + high * part).otherwise(low).alias(name))
    out = found.groupBy(*by[:-1]).agg(*sums)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[f"`{name}`" for name, _, _ in wanted])


def medians(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "") -> DataFrame:
    return quantiles(df, keys, [(f"{c}{suffix}", c, 0.5) for c in columns])


def joined(groups: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds quantiles to the rows of the groups; groups without any have nulls."""
    if not keys:
        return groups.crossJoin(F.broadcast(found))  # a row each
    return groups.join(found, keys, "left")

