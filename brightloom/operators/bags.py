"""Bags: one row for each sample, from rows of instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.filters import common_groups, require_levels, require_single


def bag_features(df: DataFrame, bag: str, features: list[str], memberships: list[str], least: float = 1) -> DataFrame:
    """n, xg_<j> (means), c_<k> (summed memberships), xk<k>_<j> (means weighted by membership, null below `least`).

    A null feature is left out of the numerator but its weight stays in the denominator. All in one aggregation.
    """
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"xg_{j}") for j, x in enumerate(features, 1)]]
    for k, m in enumerate(memberships, 1):
        weight = F.sum(m)
        sums.append(weight.alias(f"c_{k}"))
        for j, x in enumerate(features, 1):
            total = F.coalesce(F.sum(F.col(m) * F.col(x)), F.lit(0.0))
            sums.append(F.when(weight >= least, F.try_divide(total, weight)).alias(f"xk{k}_{j}"))
    return df.where(F.col(bag).isNotNull()).groupBy(bag).agg(*sums)


def cluster_counts(df: DataFrame, bag: str, cluster: str, clusters: list, label: str | None = None) -> DataFrame:
    """c_<cluster> for each bag, its one label, and n; bags without a label are left out."""
    counts = [F.count_if(F.col(cluster) == c).cast("double").alias(f"c_{c}") for c in clusters]
    out = df.where(F.col(bag).isNotNull()).groupBy(bag).agg(*counts, *([F.max(label).alias(label)] if label else []), F.count(F.lit(1)).alias("n"))
    return out.where(F.col(label).isNotNull()) if label else out


def composition(df: DataFrame, bag: str, cluster: str, label: str, clusters: list, least_rows: int = 10, least_bags: int = 2) -> DataFrame:
    """Bag counts of the clusters with enough rows, renamed c_1.. in their order; each bag has one label, each label
    enough bags. Bags are sorted by label and name."""
    kept = common_groups(df, [cluster], least_rows)
    require_single(kept, bag, label)
    found = {r[0] for r in kept.where(F.col(cluster).isin(*clusters)).select(cluster).distinct().collect()}
    present = [c for c in clusters if c in found]
    out = cluster_counts(kept, bag, cluster, present, label).withColumnsRenamed({f"c_{c}": f"__{i}" for i, c in enumerate(present, 1)})
    out = out.withColumnsRenamed({f"__{i}": f"c_{i}" for i in range(1, len(present) + 1)})
    return require_levels(out, label, least_bags, bag).orderBy(label, bag)


def mean_parts(bags: DataFrame, label: str, counts: list[str]) -> DataFrame:
    """Mean percentages of bags with equal weight, for each label."""
    return bags.groupBy(label).agg(*[F.avg(F.col(c) * 100.0 / F.col("n")).alias(f"{c}_pct") for c in counts])


def stacked(bags: DataFrame, target: str, counts: list[str], bins: int = 10) -> DataFrame:
    """Percentages of bags summed over bins of a target (right-closed, the lowest edge widened by a thousandth of the
    range), renormalised to 100, with the bin's middle."""
    ends = bags.agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    rows = bags.crossJoin(F.broadcast(ends)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)  # one row
    rows = rows.withColumn("bin", F.greatest(F.ceil(F.try_divide(F.col(target) - F.col("lo"), F.col("w"))), F.lit(1)).cast("long"))
    low = F.col("lo") + (F.col("bin") - 1) * F.col("w") - F.when(F.col("bin") == 1, (F.col("hi") - F.col("lo")) * 0.001).otherwise(0.0)
    rows = rows.withColumn("mid", (low + F.col("lo") + F.col("bin") * F.col("w")) / 2)
    out = rows.groupBy("bin", "mid").agg(*[F.sum(F.col(c) * 100.0 / F.col("n")).alias(c) for c in counts], F.sum("n").alias("n"))
    total = sum(F.col(c) for c in counts)
    return out.select("bin", "mid", *[(F.col(c) / total * 100).alias(f"{c}_pct") for c in counts], "n")
