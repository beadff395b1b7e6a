"""Scaling of features: population z-scores, exact median imputation, and matrices ready for models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.clean import finite
from brightloom.operators.filters import varying_columns
from brightloom.operators.quantiles import medians


def zscore(df: DataFrame, features: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0. The moments are one row."""
    m = df.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(m)).withColumns({f"{c}{suffix}": F.when(F.col(f"__s{i}") > 0, (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}")).when(F.col(c).isNotNull(), 0.0) for i, c in enumerate(features)})
    return out.drop(*[f"__{n}{i}" for i in range(len(features)) for n in "ms"])


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    m = medians(df, [], features).toDF(*[f"__m{i}" for i in range(len(features))])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m{i}")) for i, c in enumerate(features)}).drop(*[f"__m{i}" for i in range(len(features))])


def prepare_matrix(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns that vary, with non-finite values as missing, medians for those, and z-scores; no columns if none vary."""
    kept = varying_columns(df, features)
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in kept}) if kept else df
    return (zscore(impute_median(clean, kept), kept) if kept else clean), kept


def group_median_z(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    scaled, kept = prepare_matrix(df, features)
    return medians(scaled, [key], kept, "_z") if kept else scaled.select(key).dropna().distinct()
