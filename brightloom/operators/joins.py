"""Joins of manifests: lookups, overrides, and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.filters import require_unique


def lookup(left: DataFrame, right: DataFrame, key: str, suffix: str = "_mask", unique: bool = True) -> DataFrame:
    """All rows of left with what right has for the key; columns that both have get the suffix on the right."""
    if unique:
        require_unique(right, [key])
    shared = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c != key}
    return left.join(right.withColumnsRenamed(shared), key, "left")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return lookup(require_unique(left, [key]), right, key)


def override(frame: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Labels that aren't blank replace the frame's; keys that the frame doesn't have are ignored."""
    if unknown := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"no such columns: {unknown}")
    new = labels.select(key, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"__{c}") for c in columns])
    out = frame.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}").cast(frame.schema[c].dataType), F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def reusable(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose content key a finished record has: nothing of them needs doing again."""
    return todo.join(done.where(F.col("status") == "ok"), keys, "left_semi")


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.where(F.col("status") == "ok"), keys, "left_anti")


def carried_over(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """The new rows and those of the manifest before that weren't visited; columns that either lacks are null there."""
    return now.unionByName(before.join(now.select(key), key, "left_anti"), allowMissingColumns=True)


def mapped(df: DataFrame, column: str, names: dict, out: str, prefix: str = "") -> DataFrame:
    """A column by a small fixed mapping; values without an entry get the prefix and their own text."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    found = F.try_element_at(table, F.col(column)) if table is not None else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(found, F.concat(F.lit(prefix), F.col(column).cast("string"))))
