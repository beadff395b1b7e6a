"""Tables behind charts: effects by term and target, ordered terms, and sides turned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.clean import stars


def effects_table(effects: DataFrame, targets: list[str], value: str = "coef", missing: float = 0.0) -> DataFrame:
    """A row for each term with the effect of each target and, beside it, the stars of its q."""
    marked = effects.withColumn("__s", stars("q"))
    out = marked.groupBy("term").pivot("target", targets).agg(F.first(value).alias("effect"), F.first("__s").alias("stars"))
    return out.withColumns({f"{t}_effect": F.coalesce(f"{t}_effect", F.lit(missing)) for t in targets} | {f"{t}_stars": F.coalesce(f"{t}_stars", F.lit("")) for t in targets})


def forest(effects: DataFrame, n: int = 30) -> DataFrame:
    """The first terms by name with their effects and intervals, as ratios where the family has them."""
    ratio = F.col("exp_coef").isNotNull()
    return effects.orderBy("term", "target").limit(n).select("target", "term", F.when(ratio, F.exp("coef")).otherwise(F.col("coef")).alias("effect"), F.when(ratio, F.exp("ci_lo")).otherwise(F.col("ci_lo")).alias("lo"), F.when(ratio, F.exp("ci_hi")).otherwise(F.col("ci_hi")).alias("hi"), "q")


def transposed(df: DataFrame, key: str, columns: list[str], keys: list) -> DataFrame:
    """Columns become rows, and the given keys columns."""
    long = df.unpivot([key], columns, "feature", "value")
    return long.groupBy("feature").pivot(key, keys).agg(F.first("value"))
