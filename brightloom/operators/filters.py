"""Filters and contracts over whole tables and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.clean import contains_any, finite
from brightloom.operators.quantiles import quantiles
from brightloom.session import stored


class ContractError(ValueError):
    """A table doesn't have a form that an operator needs."""


def passing(df: DataFrame, status: str | None = None, quality: str | None = None, disease: str | None = None, include_flagged: bool = False) -> DataFrame:
    """Rows whose status column is ok, whose quality column holds (unless flagged rows are to stay), and of one disease
    group where that is asked for."""
    if status:
        df = df.where(F.col(status) == "ok")
    if quality and not include_flagged:
        df = df.where(F.col(quality))
    return df.where(F.col("disease_group") == disease) if disease else df


def without_names(df: DataFrame, column: str, parts, fold: bool = False) -> DataFrame:
    return df.where(~contains_any(column, parts, fold))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (finite(F.col(c).cast("double")).isNotNull() if t not in ("string", "boolean") else F.col(c).isNotNull() for c, t in df.select(*columns).dtypes), F.lit(True)))


def common_groups(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with so many rows at least. Only the frequent groups' keys are joined, as sizes are summed first; they
    are written before, so that rows aren't shuffled for keys that turn out to be few."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(stored(sizes, "common-groups"), keys, "left_semi")


def cutoffs(df: DataFrame, wanted: list[tuple[str, str, float]]) -> DataFrame:
    """One row: the exact quantile of each (name, column, q)."""
    return quantiles(df, [], wanted)


def extreme_in_both(df: DataFrame, first: tuple[str, str], second: tuple[str, str], part: float) -> DataFrame:
    """Rows at or beyond the quantile of both features: (column, 'high' or 'low') with quantile 1 - part or part."""
    pairs = [(f"__cut{i}", c, 1 - part if way == "high" else part) for i, (c, way) in enumerate((first, second))]
    row = df.crossJoin(F.broadcast(cutoffs(df, pairs)))  # one row
    for (name, c, _), (_, way) in zip(pairs, (first, second), strict=True):
        row = row.where(F.col(c) >= F.col(name) if way == "high" else F.col(c) <= F.col(name))
    return row.drop(*[p[0] for p in pairs])


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one finite value, by one pass of minima and maxima."""
    row = df.agg(*[f(finite(F.col(c).cast("double"))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    return [c for i, c in enumerate(columns) if row[f"a{i}"] is not None and row[f"a{i}"] != row[f"b{i}"]]


def degenerate(df: DataFrame, column: str, small: float = 1e-10) -> bool:
    """Whether a feature can't carry a model: no value, all about zero, or a population variance that is too small."""
    r = df.agg(F.count(column).alias("n"), F.max(F.abs(F.col(column))).alias("m"), F.var_pop(column).alias("v")).first()
    return not r.n or r.m <= 1e-8 or r.v < small


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """The message of the first check that holds, else null."""
    return F.coalesce(*[F.when(c, m) for c, m in checks]) if checks else F.lit(None).cast("string")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if (r := df.groupBy(*keys).count().where("count > 1").first()) is not None:
        raise ContractError(f"{keys} repeat: {r.asDict()}")
    return df


def require_single(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key has one value only."""
    if (r := df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1").first()) is not None:
        raise ContractError(f"{key} {r[key]!r} has {r.n} values of {value}")
    return df


def require_levels(df: DataFrame, column: str, least: int, of: str | None = None) -> DataFrame:
    """At least so many distinct values, or so many distinct `of` for each value."""
    if of is None:
        if df.agg(F.count_distinct(column)).first()[0] < least:
            raise ContractError(f"{column} has fewer than {least} values")
    elif (r := df.groupBy(column).agg(F.count_distinct(of).alias("n")).where(F.col("n") < least).first()) is not None:
        raise ContractError(f"{column} {r[column]!r} has {r.n} of {of} only")
    return df


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
