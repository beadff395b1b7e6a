"""Sessions: what the library needs of one."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass the session that the cluster gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
    for k, v in ({"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"} | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each application, for sessions whose workers don't have it on their
    path, and bounds the batches that Python workers get."""
    # Rows are whole documents, some of them very long: batches for Python workers are bounded by bytes as well. Set once
    # for each session, so that what its user sets later stays.
    if not getattr(spark, "_brightloom_batches", False):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
        spark._brightloom_batches = True
    sc = spark.sparkContext
    if getattr(sc, "_brightloom_shipped", False):
        return spark
    root = Path(__file__).parent
    to = os.path.join(tempfile.mkdtemp(prefix="brightloom-"), "brightloom_package.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(to)
    sc._brightloom_shipped = True
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session of one machine, as in tests, gets a
    folder of its own where none is set; on a cluster that is an error, as other machines wouldn't see it."""
    sc = spark.sparkContext
    if (root := sc.getCheckpointDir()) is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="brightloom-"))
        root = sc.getCheckpointDir()
    return root


def checkpointed(df):
    """Cuts the lineage of df by writing it to the shared folder of checkpoints."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df, name: str = "table"):
    """Writes df once to the shared folder and reads it back: later jobs neither make it again nor need the executors that
    made it."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_side(df):
    """A side of a join that grows with the input: it is sorted where its rows are, and never sent through the driver, not
    even while it is small, as many such joins in a row would add up there."""
    return df.hint("merge")
