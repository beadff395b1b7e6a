"""Run folders: a table and settings for each stage, kept so that a run can go on where it was left."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators.joins import carried_over


def settings_digest(spark: SparkSession, settings: dict) -> str:
    """A digest of the settings that doesn't depend on their order: of one line of JSON for each, sorted."""
    lines = [(json.dumps([name, value], sort_keys=True),) for name, value in settings.items()]
    rows = spark.createDataFrame(lines, "line string")
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256)).first()[0]


class RunStore:
    """Stage tables as Parquet under one base path, which any file system of Spark can hold."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def save(self, name: str, df: DataFrame, mark: str = "") -> DataFrame:
        """Writes a new version in a folder of its own; only when that is complete (Spark's _SUCCESS file) do readers see
        it, and only then do older versions go, so that a failure at any moment leaves the table before or after. mark:
        what the version is told by afterwards (see `marked`), letters and digits."""
        before = self._versions(name)
        version = f"{self.base}/{name}/v{(int(before[-1][1:9]) if before else 0) + 1:08d}"
        df.write.mode("overwrite").parquet(version + (f"-{mark}" if mark else ""))
        for old in before[:-1]:  # the one before stays for whoever still reads it
            fs, p = self._fs(f"{self.base}/{name}/{old}")
            fs.delete(p, True)
        return self.load(name)

    def marked(self, name: str, mark: str) -> bool:
        """Whether the table's last version has this mark."""
        versions = self._versions(name)
        return bool(versions) and versions[-1][10:] == mark

    def _versions(self, name: str) -> list[str]:
        """Folders of complete versions of a table, in their order."""
        fs, p = self._fs(f"{self.base}/{name}")
        if not fs.exists(p):
            return []
        folders = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(f for f in folders if f[:1] == "v" and f[1:9].isdigit() and self._has(f"{self.base}/{name}/{f}/_SUCCESS"))

    def _has(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}/{self._versions(name)[-1]}")

    def merge(self, name: str, rows: DataFrame, key: str, mark: str = "") -> DataFrame:
        """A manifest's new rows, with those before that weren't visited."""
        return self.save(name, carried_over(rows, self.load(name), key) if self.exists(name) else rows, mark)

    def save_settings(self, stage: str, settings: dict, overwrite: bool = False) -> str:
        """Keeps a stage's settings; an error if others are kept already, unless they are to be replaced."""
        at = f"settings-{stage}"
        if self.exists(at) and not overwrite and (old := json.loads(self.load(at).first().value)) != settings:
            raise ValueError(f"{stage} was run with other settings: {old}")
        self.save(at, self.spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1))
        return settings_digest(self.spark, settings)

    def drop_stale(self, before: list[str], now: list[str]) -> list[str]:
        """Deletes artefacts that the last run listed and this one didn't make: bare names of pictures and tables only."""
        gone = [n for n in before if n not in now and "/" not in n and n.endswith((".png", ".csv"))]
        for n in gone:
            fs, p = self._fs(f"{self.base}/{n}")
            fs.delete(p, True)
        return gone


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """CSV parts with a header; lists are joined by ;."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, header=True)


def write_effects(df: DataFrame, path: str, target: str = "target") -> None:
    """A folder of CSV for each target."""
    df.withColumn("_target", F.col(target)).repartition(target).write.mode("overwrite").partitionBy("_target").csv(path, header=True)
