"""Summaries of groups, cross-tables, histograms and box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.quantiles import joined, medians, quantiles

STATS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


#: Rows of about as many groups that one task holds.
TASK_ROWS = 1 << 20


def group_counts(df: DataFrame, keys: list[str], rows: int | None = None, most: int = TASK_ROWS) -> DataFrame:
    """(keys, n). rows: about how many df has, for keys that tell most of them apart; they are dealt out so that no task
    gets more than about `most`, however many there are."""
    parts = -(-(rows or 0) // most)
    if parts > 1:
        df = df.repartition(parts, *keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def group_summary(df: DataFrame, keys: list[str], features: list[str], stats=("count", "median", "mean", "std")) -> DataFrame:
    """<feature>_<stat> for each group; groups with a null key are left out."""
    kept = df.dropna(subset=keys)
    sums = [STATS[s](f).alias(f"{f}_{s}") for f in features for s in stats if s != "median"]
    groups = kept.groupBy(*keys).agg(*sums) if sums else kept.select(*keys).distinct()
    if "median" in stats:
        groups = joined(groups, medians(kept, keys, features, "_median"), keys)
    return groups.select(*keys, *[f"{f}_{s}" for f in features for s in stats])


def describe(df: DataFrame, keys: list[str], feature: str) -> DataFrame:
    out = df.dropna(subset=keys).groupBy(*keys).agg(F.count(feature).alias("n"), F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("std"), F.min(feature).alias("min"), F.max(feature).alias("max"))
    parts = quantiles(df, keys, [("p25", feature, 0.25), ("p50", feature, 0.5), ("p75", feature, 0.75)])
    return joined(out, parts, keys).select(*keys, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def crosstab(df: DataFrame, rows: str, columns: str, values: list, per_cent: bool = False) -> DataFrame:
    """Counts of the given values in each row group, zero where there are none; or parts of the row's total."""
    out = df.dropna(subset=[rows, columns]).groupBy(rows).pivot(columns, values).count().na.fill(0)
    if per_cent:
        total = sum(F.col(str(v)) for v in values)
        out = out.withColumns({str(v): F.try_divide(F.col(str(v)) * 100.0, total) for v in values})
    return out


def long_profile(df: DataFrame, keys: list[str], features: list[str], stats=("mean", "median", "std"), digits: int = 3) -> DataFrame:
    """A row for each feature and group: the summary turned on its side."""
    wide = group_summary(df, keys, features, stats)
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.bround(F.col(f"{f}_{s}"), digits).alias(s) for s in stats]) for f in features])).alias("p")
    return wide.select(*keys, parts).select(*keys, "p.*")


def z_across_groups(df: DataFrame, key: str, features: list[str], stat: str = "mean") -> DataFrame:
    """Each group's mean or median, standardised over the groups (sample deviation)."""
    groups = group_summary(df, [key], features, (stat,))
    # One row of moments, which is joined back.
    moments = groups.agg(*[c for i, f in enumerate(features) for c in (F.avg(f"{f}_{stat}").alias(f"__m{i}"), F.stddev_samp(f"{f}_{stat}").alias(f"__s{i}"))])
    z = [F.try_divide(F.col(f"{f}_{stat}") - F.col(f"__m{i}"), F.col(f"__s{i}")).alias(f"{f}_z") for i, f in enumerate(features)]
    return groups.crossJoin(F.broadcast(moments)).select(key, *z)


def histogram(df: DataFrame, key: str, feature: str, bins: int = 25, shared: bool = True) -> DataFrame:
    """(key, bin, n) over equal bins; edges from the whole table, or each group's own. The last bin holds its upper edge."""
    rows = df.where(F.col(feature).isNotNull() & F.col(key).isNotNull())
    ends = rows.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi")) if shared else rows.groupBy(key).agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    rows = rows.crossJoin(F.broadcast(ends)) if shared else rows.join(ends, key)  # shared: one row
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(feature) - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(0)), F.lit(bins - 1))
    return rows.groupBy(key, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, key: str, feature: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (the outermost values within `reach` quartile ranges) and the number beyond them."""
    rows = df.where(F.col(feature).isNotNull() & F.col(key).isNotNull())
    q = quantiles(rows, [key], [("q1", feature, 0.25), ("med", feature, 0.5), ("q3", feature, 0.75)])
    inside = F.col(feature).between(F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    out = rows.join(q, key).groupBy(key, "q1", "med", "q3")
    return out.agg(F.min(F.when(inside, F.col(feature))).alias("whisker_low"), F.max(F.when(inside, F.col(feature))).alias("whisker_high"), F.count_if(~inside).alias("fliers"))


def ranges(df: DataFrame, feature: str, key: str, value) -> DataFrame:
    """Minimum and maximum over all rows, and over one group."""
    one = F.when(F.col(key) == value, F.col(feature))
    return df.agg(F.min(feature).alias("all_min"), F.max(feature).alias("all_max"), F.min(one).alias("group_min"), F.max(one).alias("group_max"))


def status_counts(df: DataFrame, status: str, good=("ok",)) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col(status).isin(*good), F.lit(False))).alias("errors"))


def uniform_groups(df: DataFrame, key: str, condition) -> DataFrame:
    """Groups in which the condition holds for every row come first, then by name."""
    return df.groupBy(key).agg(F.bool_and(condition).alias("uniform")).orderBy(~F.col("uniform"), F.lower(key))
