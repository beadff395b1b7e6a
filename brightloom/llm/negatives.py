"""Hard negatives for contrastive training, exactly, by a secondary sort.

A given set of anchors is scored against all rows in blocks. A first pass keeps each block's few best rows of an anchor's
label, from which its positives come; their scores open windows. A second pass keeps, of each block, what can be among the
first of a window. Both passes give a bounded number of pairs for an anchor and block, so no pair that can't matter is
shuffled. Pairs are packed into keys of anchor, descending score, kind and id; a shuffle by anchor that sorts within its
partitions (DataFrame's repartitionAndSortWithinPartitions) brings them to a streaming iterator, which holds one anchor's
open windows and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.common import scratch_table, tidied

#: Rows and anchors of a block, about; anchors of a block that are scored at once.
ROWS, ANCHORS, AT_ONCE = 8192, 4096, 256

#: An integer up to which sums of products are exact in double precision.
EXACT = 2.0**53
LIMIT = 2**63 - 1

PAIRS = "anchor bigint, id bigint, score bigint"


def prepared(vectors: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as integers. Rows with a null id, label or vector, or with a null or
    non-finite component, take no part. An id that comes with several labels or vectors counts as one row, that with the
    least label, then vector; components that don't fit in 64 bits are cut off there."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vec).isNotNull() & ~F.coalesce(F.exists(x, odd), F.lit(False))
    whole = lambda c: F.when(F.abs(c) * scale < 2.0**62, F.floor(F.least(F.greatest(c * scale, F.lit(-(2.0**62))), F.lit(2.0**62)))).otherwise((F.signum(c) * 2.0**62).cast("long"))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(x, whole).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    col = col.combine_chunks()
    lengths = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, int)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, of which those beyond 64 bits are cut off there."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest score of a negative for a positive's score; low and high in hundredths of it."""
    return -((-low * positive) // 100), (high * positive) // 100


def _first(order: np.ndarray, scores: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
    """The first n places of a descending order whose scores lie in a window."""
    falling = -scores[order]
    at = np.searchsorted(falling, -high, "left")
    return order[at : min(at + n, np.searchsorted(falling, -low, "right"))]


def _pack(anchor: Column, score: Column, kind: int, key: Column) -> Column:
    """Bytes that sort by anchor, falling score, kind and id."""
    eight = lambda c: F.lpad(F.hex(F.expr("-9223372036854775808").cast("long").bitwiseXOR(c)), 16, "0")
    return F.unhex(F.concat(eight(anchor), eight(F.bitwise_not(score)), F.lit(f"{kind:02x}"), eight(key)))


def unpack(key: bytes) -> tuple[int, int, int, int]:
    flip = lambda b: int.from_bytes(b, "big") - 2**63
    return flip(key[:8]), ~flip(key[8:16]), key[16], flip(key[17:])


def windows(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Goes once through sorted keys: a positive opens its window, and a negative is given out for every open window that
    holds it, until the window has its number. Positives stand before negatives of the same score."""
    here, open_ = None, []
    for anchor, score, kind, key in map(unpack, keys):
        if anchor != here:
            here, open_, opened = anchor, [], 0
        if kind == 0:
            if opened < positives:
                opened += 1
                open_.append([key, score, *window(score, low, high), 0])
            continue
        for w in open_:
            if w[4] < negatives and w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], key, w[1], score
        if any(w[4] >= negatives or score < w[2] for w in open_):
            open_ = [w for w in open_ if w[4] < negatives and score >= w[2]]


def _blocks(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, work) -> DataFrame:
    """Every block of anchors meets every block of rows in one call of `work`: anchors are dealt out to q and copied to each
    r, rows the other way round."""
    q, r = max(1, math.ceil(n_anchors / ANCHORS)), max(1, math.ceil(n / ROWS))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    of = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    anchors = anchors.toDF(*anchors.columns)  # columns of its own, as it may stem from the same rows
    left = anchors.withColumn("r", each(r)).withColumn("q", of(q))
    right = rows.withColumn("q", each(q)).withColumn("r", of(r))
    return left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(tidied(work), PAIRS)


def _table(anchor: list, ids: list, scores: list) -> pa.Table:
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return pa.table({"anchor": join(anchor), "id": join(ids), "score": join(scores)})


def _scored(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """For some anchors at a time: their places, the scores of all rows, which rows have their label, and the rows' ids,
    which rise, so that a stable order puts the smaller first."""
    rows = rows.sort_by("vec_id")
    ids, a, b = rows["vec_id"].to_numpy(), _matrix(anchors["v"]), _matrix(rows["v"])
    _, codes = np.unique(np.array(anchors["label"].to_pylist() + rows["label"].to_pylist(), object), return_inverse=True)
    for k in range(0, len(a), AT_ONCE):
        own = codes[k : k + AT_ONCE][: len(a) - k]
        yield range(k, k + len(own)), products(a[k : k + len(own)], b), own[:, None] == codes[None, len(a) :], ids


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row for which the
    condition holds, and each of its best rows of the same label, the best rows of another label whose score is at least
    `low` and at most `high` hundredths of the positive's. Scores are inner products of integers; equal ones go by id.

    Which rows take part, and what becomes of repeated ids, is told at `prepared`; other columns don't matter. An anchor
    without positives, or a positive without negatives in its window (as any with a score below zero), has no rows; vectors
    of different lengths are held against each other as if the shorter ended in zeros; an empty table gives an empty one.
    """
    rows = scratch_table(prepared(vectors, vec, scale), "vectors")
    asking = rows.where(anchors)
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(anchors)).first()

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            names = a["vec_id"].to_numpy()
            for at, scores, same, ids in _scored(a, b):
                for i, s, m in zip(at, scores, same, strict=True):
                    own = np.flatnonzero(m & (ids != names[i]))
                    own = own[np.argsort(-s[own], kind="stable")][:positives]
                    out[0].append(np.full(len(own), names[i])), out[1].append(ids[own]), out[2].append(s[own])
        return _table(*out)

    best = scratch_table(_blocks(rows, asking, n, n_anchors, near), "positives")
    # At most `positives` of each block: their best are kept without more than as many at a time.
    ranks = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    best = best.withColumn("rn", ranks).where(F.col("rn") <= positives).drop("rn")
    best = scratch_table(best, "best")
    opened = asking.join(best.groupBy("anchor").agg(F.collect_list("score").alias("scores")).withColumnRenamed("anchor", "vec_id"), "vec_id")

    def hard(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            names, wanted = a["vec_id"].to_numpy(), a["scores"].to_pylist()
            for at, scores, same, ids in _scored(a, b):
                for i, s, m in zip(at, scores, same, strict=True):
                    other = np.flatnonzero(~m)
                    order = other[np.argsort(-s[other], kind="stable")]
                    found = np.unique(np.concatenate([_first(order, s, *window(p, low, high), negatives) for p in wanted[i]]))
                    out[0].append(np.full(len(found), names[i])), out[1].append(ids[found]), out[2].append(s[found])
        return _table(*out)

    pairs = _blocks(rows, opened, n, n_anchors, hard)
    keyed = best.select("anchor", _pack(F.col("anchor"), F.col("score"), 0, F.col("id")).alias("key")).unionByName(pairs.select("anchor", _pack(F.col("anchor"), F.col("score"), 1, F.col("id")).alias("key")))
    partitions = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    schema = pa.schema([(c, pa.int32() if c == "rank" else pa.int64()) for c in names])

    @tidied
    def stream(batches):
        found = windows((k for b in batches for k in b.column(0).to_pylist()), positives, negatives, low, high)
        some: list[tuple] = []
        for x in found:
            some.append(x)
            if len(some) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return keyed.repartition(partitions, "anchor").sortWithinPartitions("key").select("key").mapInArrow(stream, ", ".join(f"{c} {'int' if c == 'rank' else 'bigint'}" for c in names))

