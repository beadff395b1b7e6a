"""Text covariates, rows without a cluster, and manifests of streams that are run again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import glm
from brightloom.operators.filters import ContractError
from brightloom.sources.runs import RunStore
from brightloom.streaming.incremental import follow


def test_text_covariates(spark):
    rng = random.Random(1)
    rows = [(i % 30, float(i % 11), "abc"[i % 3], bool(i % 2), 2.0 * (i % 11) + 3 * (i % 3 == 1) - (i % 3 == 2) + 5 * (i % 2) + rng.gauss(0, 0.1)) for i in range(300)]
    df = spark.createDataFrame([*rows, (1, 1.0, None, True, 1e6)], "bag long, x double, kind string, `is so` boolean, y double")
    got = {r.term: r for r in glm.feature_association(df, ["y"], ["x"], "bag", covariates=["kind", "is so"]).collect()}
    assert set(got) == {"x", "kind[b]", "kind[c]", "is so[True]"} and got["x"].nobs == 300
    design = np.array([[1, x, k == "b", k == "c", s] for _, x, k, s, _ in rows], float)
    beta = np.linalg.lstsq(design, np.array([r[-1] for r in rows]), rcond=None)[0]
    assert np.allclose([got[t].coef for t in ("x", "kind[b]", "kind[c]", "is so[True]")], beta[1:])
    assert got["x"].q is not None and got["kind[b]"].q is None
    many = df.withColumn("kind", F.concat("kind", F.monotonically_increasing_id().cast("string")))
    with pytest.raises(ContractError):
        glm.fit(many, [glm.Model("y", ["x", "kind"])])


def test_rows_without_a_cluster_are_left_out(spark):
    rng = random.Random(2)
    rows = [(i % 20 if i % 4 else None, float(i % 7), i % 7 + rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "bag long, x double, y double")
    some = glm.fit(df, [glm.Model("y", ["x"])], "bag").collect()
    assert {r.nobs for r in some} == {150} and some == glm.fit(df.where("bag is not null"), [glm.Model("y", ["x"])], "bag").collect()


def test_a_batch_that_is_run_again_leaves_one_version(spark, tmp_path):
    store, calls = RunStore(spark, f"{tmp_path}/run"), []

    def work(rows):
        calls.append(rows.count())
        return rows.withColumn("status", F.lit("ok"))

    def run():
        stream = spark.readStream.schema("id long, sha string").parquet(f"{tmp_path}/in")
        follow(stream, store, "masks", "id", ["sha"], work, f"{tmp_path}/checkpoint").awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b")], "id long, sha string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    first = store._versions("masks")
    # The stream stops after the version is complete, before its own checkpoint is.
    for f in (tmp_path / "checkpoint" / "commits").glob("*0*"):
        f.unlink()
    run()
    assert store._versions("masks") == first and len(calls) == 1
    spark.createDataFrame([(3, "c")], "id long, sha string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert len(store._versions("masks")) == 2 and calls == [2, 1]
    assert sorted(r.id for r in store.load("masks").collect()) == [1, 2, 3]
    # A version that isn't complete doesn't count.
    (next((tmp_path / "run" / "masks").glob(store._versions("masks")[-1])) / "_SUCCESS").unlink()
    assert store._versions("masks") == first
