"""What a task holds, what is shuffled and what comes to the driver don't grow faster than the tables."""

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brightloom.llm import lm
from brightloom.operators import filters, raster, summary
from brightloom.operators.graph import connected


def test_counts_of_many_groups_are_dealt_out(spark):
    df = spark.range(4000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 1000).alias("b"))
    out = summary.group_counts(df, ["a", "b"], df.count(), most=500)
    held = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("n").alias("n")).collect()
    assert len(held) == 8 and max(r.n for r in held) < 1000
    want = Counter((i % 7, i % 1000 if i % 11 else None) for i in range(4000))
    assert {(r.a, r.b): r.n for r in out.collect()} == want == {(r.a, r.b): r.n for r in summary.group_counts(df, ["a", "b"]).collect()}
    assert filters.common_groups(df, ["a"], 572).select("a").distinct().count() == 3 and filters.common_groups(df, ["b"], 500).count() == 0


def test_joins_of_pixels_and_links_pass_nothing_through_the_driver(spark):
    rows = [(i, [float((i * 7 + k * k) % 11) for k in range(16)]) for i in range(2)]
    px = raster.masked(raster.pixels(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", 4))
    links = spark.range(3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for df in (raster.dilated(px, 1), raster.largest(px), connected(links)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, plan


def test_rows_gathered_some_at_a_time_give_the_same_sums():
    rng = np.random.default_rng(3)
    table, bias = rng.normal(size=(500, 8)).astype(np.float32), rng.normal(size=(40, 8)).astype(np.float32)
    for n in (0, 1, lm.AT_ONCE, 2 * lm.AT_ONCE + 7):
        places, cls = [rng.integers(0, 500, n) for _ in range(3)], rng.integers(0, 40, n)
        assert np.array_equal(lm._added(table, places), table[places[0]] + table[places[1]] + table[places[2]])
        assert np.array_equal(lm._added(table, places, lm._rows(bias, cls)), bias[cls] + table[places[0]] + table[places[1]] + table[places[2]])


def test_language_model_cuts_texts_into_words_once(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.col("id").cast("string")).alias("text"))
    path = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/texts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = lm.score(spark.read.parquet(path), F.col("doc_id") % 7 != 2)
    assert got.count() == 40 and not [f for f in got.inputFiles() if "/texts-" in f]


def test_sums_of_rows_by_place_and_softmax_of_any_values():
    rng = np.random.default_rng(4)
    for n, places in ((1, 1), (300, 7), (5000, 900), (5000, 5000)):
        at, error = (rng.integers(0, places, n) ** 2 // places), rng.normal(size=(n, 6)).astype(np.float32)
        found, times, sums = lm._sums(error, at)
        want = {p: error[at == p].astype(float).sum(0) for p in np.unique(at)}
        assert sorted(found) == sorted(want) and dict(zip(found.tolist(), times.tolist())) == Counter(at.tolist())
        assert np.allclose(sums, [want[p] for p in found], atol=1e-4)
    for shift in (0, 50, 200, -200, -1e4):
        z, chosen = rng.normal(size=(50, 8)).astype(np.float32) * 3 + np.float32(shift), rng.integers(0, 8, 50)
        e = np.exp(z.astype(float) - z.max(1, keepdims=True))
        want = e / e.sum(1, keepdims=True)
        assert np.allclose(lm._log_of(z.copy(), chosen), np.log(want[np.arange(50), chosen]), atol=1e-3)
        assert np.allclose(lm._errors(z.copy(), chosen), want - np.eye(8)[chosen], atol=1e-3)


def test_numbers_of_many_words_come_back_from_their_halves():
    texts = [None, " Once  more\tonce ", "", " ".join(f"w{i}" for i in range(70_000)), "ONCE w7 w69999"]
    words, numbers, lengths = lm.numbered(pa.array(texts))
    numbers = lm._numbers(lm._packed((numbers & 65535).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()))
    words = lm._own(lm._packed(b" ".join(words)))
    cut = [(t or "").encode().lower().split() for t in texts]
    assert lengths.tolist() == [len(c) for c in cut] and [words[i] for i in numbers] == sum(cut, []) and words[0] == b"once"
    assert lm._own(lm._packed(b"")) == [] and not len(lm._numbers(lm._packed(b"")))
