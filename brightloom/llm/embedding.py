"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits the vectors again and again by a random direction at the median of a sample; vectors near a split go to
both sides. Vectors that share a leaf of any tree, and a label, are compared exactly. A pair counts in the first leaf that
it shares, so that links are summed up without listing pairs, and each leaf hands on only a forest of its links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import scratch_table, tidied, with_group
from brightloom.llm.components import connected_components

#: Cosine of a link, trees, vectors that a leaf should hold, the sample that splits are fitted on, and how near to a
#: split, as a part of the projections' spread, a vector goes to both sides.
COSINE, TREES, LEAF, SAMPLE, SPILL, SEED = 0.93, 6, 512, 20_000, 0.06, 11
#: Members of a leaf compared in one task; a larger leaf is compared block by block.
BLOCK = 2048


class Forest:
    """For each tree and inner node, in heap order: a direction, a threshold and a margin."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = SEED):
        dim, inner = sample.shape[1], (1 << depth) - 1
        rng = np.random.default_rng([seed, dim, depth])
        self.depth = depth
        self.directions = rng.standard_normal((trees, inner, dim)).astype(np.float32)
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts, self.margins = np.zeros((trees, inner), np.float32), np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                at = members.pop(node)
                p = sample[at] @ self.directions[t, node]
                cut = float(np.median(p)) if len(at) else 0.0
                self.cuts[t, node], self.margins[t, node] = cut, spill * (float(p.std()) if len(at) > 1 else 0.0)
                members[2 * node + 1], members[2 * node + 2] = at[p < cut], at[p >= cut]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves, a pair for each leaf that a vector is in, by row; leaves are numbered over all trees."""
        rows_of, leaf_of, inner = [], [], (1 << self.depth) - 1
        for t in range(len(self.directions)):
            row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", vectors[row], self.directions[t, node]) - self.cuts[t, node]
                both = np.abs(p) < self.margins[t, node]
                left, right = (p < 0) | both, (p >= 0) | both
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows_of.append(row)
            leaf_of.append(node - inner + (t << self.depth))
        row, leaf = np.concatenate(rows_of), np.concatenate(leaf_of)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, of any finite vectors but zero: first scaled, so that no square is too large or too small."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True, initial=0)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vector: str, label: str, id_col: str) -> Column:
    """Whether a row can have links at all: label and id aren't null, the vector's components are finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _in_leaves(classes: DataFrame, forest: Forest) -> DataFrame:
    """(label, leaf, rep, n, v, leaves): a row for each leaf of each class of equal vectors. Components stay as wide as
    they are, leaves are four bytes each."""
    sent = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                raw = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                row, leaf = sent.value.leaves(unit(raw).astype(np.float32))
                upto = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
                lists = pa.array([leaf[x:y].astype("<u4").tobytes() for x, y in zip(upto[:-1], upto[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(leaf), *[part.column(i).take(pa.array(row)) for i in (1, 2, 3)], lists.take(pa.array(row))], ["label", "leaf", "rep", "n", "v", "leaves"])

    fields = [classes.schema["label"], T.StructField("leaf", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), classes.schema["v"], T.StructField("leaves", T.BinaryType())]
    return classes.select("label", "rep", "n", "v").mapInArrow(tidied(run), T.StructType(fields))


def _earlier_leaves(leaves: list[np.ndarray], leaf: int) -> np.ndarray:
    """Members by leaves before this one: 1 where a member is in it. Two rows' product counts what they share."""
    known, at = np.unique(np.concatenate(leaves), return_inverse=True)
    row = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    out = np.zeros((len(leaves), len(known)), np.float32)
    out[row, at] = 1
    return out[:, known < leaf]


def compare(table: pa.Table, cosine: float = COSINE) -> pa.Table:
    """One leaf's links (or those of a pair of its blocks): rows (a, links, null), the weight of a's partners, and rows
    (a, 0, b), links that connect what all links here connect."""
    rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
    side = table.column("side").to_numpy()
    v = unit(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1))
    earlier = _earlier_leaves([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("leaves")], table.column("leaf")[0].as_py())
    one = bool(side.max() == side.min())
    group, found, edges = np.arange(len(rep)), np.zeros(len(rep), np.int64), []
    left = np.flatnonzero(side == side.min())
    right = left if one else np.flatnonzero(side == side.max())
    for k in range(0, len(left), 512):
        rows = left[k : k + 512]
        near = v[rows] @ v[right].T >= cosine
        if one:
            near &= rep[rows][:, None] < rep[right][None, :]
        # A pair counts in the first leaf that it shares.
        near &= earlier[rows] @ earlier[right].T == 0
        found[rows] += near @ n[right]
        found[right] += n[rows] @ near
        for i in np.flatnonzero(near.any(1)):
            others = right[near[i]]
            _, first = np.unique(group[others], return_index=True)
            for j in others[first]:
                if group[j] != group[rows[i]]:
                    edges.append((rep[rows[i]], rep[j]))
                    group[group == group[j]] = group[rows[i]]
    at = np.flatnonzero(found)
    a = np.concatenate([rep[at], np.array([e[0] for e in edges], np.int64)])
    return pa.table({"a": pa.array(a), "links": pa.array(np.append(found[at], np.zeros(len(edges), np.int64))), "b": pa.array([None] * len(at) + [int(e[1]) for e in edges], pa.int64())})


def _dimension_links(classes: DataFrame, trees: int, leaf: int, cosine: float, block: int) -> DataFrame:
    total = classes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
    # Bounded by the hash alone, so that the trees don't depend on the files: about SAMPLE rows, wherever they lie.
    bounded = min(1.0, SAMPLE / max(1, total))
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(bounded * (1 << 30))).select("v").toPandas()
    # Splits need some vectors of the sample on either side; leaves that stay large are compared by blocks.
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) / 8)))))
    fitted = unit(np.stack(sample.v.to_numpy())).astype(np.float32) if len(sample) else np.zeros((0, 1), np.float32)
    placed = scratch_table(_in_leaves(classes, Forest(fitted, depth, trees)), f"leaves-{uuid.uuid4().hex[:6]}")
    sizes = placed.groupBy("label", "leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = placed.join(sizes, ["label", "leaf"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A member of a split leaf goes to the pair of its own block with every block.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("x"), F.greatest("own", other).alias("y")))
    dealt = rows.select("label", "leaf", "rep", "n", "v", "leaves", F.col("own").alias("side"), F.inline(pairs))
    return dealt.groupBy("label", "leaf", "x", "y").applyInArrow(lambda t: compare(t, cosine), "a long, links long, b long")


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept.

    Links are pairs of equal labels whose cosine, in double precision, is found to reach the threshold. Vectors that are
    null, zero or hold null or non-finite components, and those whose label or id is null, have none; their component is
    their own id. Equal vectors of a label are one class, linked among themselves. Vectors of different lengths never
    link. Rows that repeat an id count as vectors of their own, each with the links of its own vector. Other columns
    don't matter; an empty table gives an empty result.
    """
    key, v = "key", F.col(vector).cast("array<double>")
    wide = vectors.schema[vector].dataType != T.ArrayType(T.FloatType())
    body = v if wide else F.col(vector)
    digest = F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(SEED), "v"), F.size("v"), F.col("label").cast("string"))
    good = vectors.where(usable(vector, label, id_col)).select(F.col(id_col).alias("id"), body.alias("v"), F.col(label).alias("label"))
    # Numbered as they are written; an id may have several vectors.
    classes = good.groupBy("label", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = scratch_table(classes.select(F.monotonically_increasing_id().alias("rep"), "label", "v", "first", "n", digest.alias(key)), "vector-classes")
    if not classes.groupBy(key).count().where("count > 1").isEmpty():
        raise RuntimeError("two vectors have one digest")  # 128 bits: not to be expected
    links = None
    for (dim,) in classes.select(F.size("v")).distinct().collect():
        some = _dimension_links(classes.where(F.size("v") == dim), trees, leaf, cosine, block)
        links = some if links is None else links.union(some)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, links long, b long")
    links = scratch_table(links, "vector-links")
    roots = connected_components(links.where("b is not null"), "a", "b")
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("rep", key, "first", "n").join(counts, classes.rep == counts.a, "left").join(roots, F.col("rep") == roots.id, "left")
    named = scratch_table(named.select(key, "first", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "vector-roots")
    # The smallest id of a component, over all of its classes; joined to classes first, which equal vectors share.
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = with_group(named, least, "root", "classes").select(key, "n", "n_links", "component_id")
    linked = with_group(good.select("id", digest.alias(key)), named, key, "n").select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = vectors.where(~usable(vector, label, id_col)).select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
