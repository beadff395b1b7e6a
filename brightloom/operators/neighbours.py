"""A graph of nearest neighbours, and a layout of it in the plane, as rounds of joins.

The graph is found by descent: rows are sorted along random directions, within cells of random planes, and compared with
those beside them; then, round by round, the neighbours of a row (and rows whose neighbour it is) are compared with each
other, and what comes nearer than a row's furthest neighbour takes its place. A task compares one row's neighbours at a
time, so nothing grows with the table but the number of such groups.

The layout follows McInnes et al. (2018): distances become weights through a bandwidth of each row, weights of both
directions are joined, and positions move along sampled edges, away from random rows. Rows are dealt out to blocks of a
bounded size. In a round each block moves its own rows several times, with the others where the last round left them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import stored

#: Rows that are compared with each other along a direction; what each row gives out of a comparison.
BESIDE, GIVEN = 64, 10
#: What one group of neighbours gives out for each of its rows.
FROM_GROUP = 4
#: Rows of a block of the layout, about; rows of each block that others are pushed away from.
BLOCK, PUSHING = 1024, 2048


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with vectors of one length: shorter ones end in zeros. Rows with a null id or vector, or a component that is
    null or not finite, are left out; of repeated ids the row with the least vector stays."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("float"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size("v"))))


def _packed(vectors: DataFrame) -> DataFrame:
    """Vectors as bytes, which are moved as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], ["id", "v"])

    return vectors.mapInArrow(run, "id bigint, v binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 1))


def _squares(x: np.ndarray) -> np.ndarray:
    n = (x * x).sum(1)
    return np.maximum(n[:, None] + n[None, :] - 2 * x @ x.T, 0)


def _table(ids: list, others: list, squares: list) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return pa.RecordBatch.from_pydict({"id": join(ids, np.int64), "other": join(others, np.int64), "distance": np.sqrt(join(squares, np.float64))})


def _near(ids: np.ndarray, x: np.ndarray, most: int, below: np.ndarray | None, out: tuple, fresh: np.ndarray | None = None) -> None:
    """Adds each row's nearest among the others, so many at most, if they are nearer than what it has, and one of the two
    is fresh."""
    d = _squares(x)
    d[ids[:, None] == ids[None, :]] = np.inf
    if fresh is not None:
        d[~(fresh[:, None] | fresh[None, :])] = np.inf
    if below is not None:
        d[d >= below[:, None]] = np.inf
    n = min(most, len(ids) - 1)
    if n < 1:
        return
    at = np.argpartition(d, n - 1, axis=1)[:, :n]
    found = np.take_along_axis(d, at, 1)
    row, col = np.nonzero(np.isfinite(found))
    out[0].append(ids[row]), out[1].append(ids[at[row, col]]), out[2].append(found[row, col])


EDGES = "id bigint, other bigint, distance double"


def _beside(vectors: DataFrame, n: int, orders: int, seed: int, partitions: int) -> DataFrame:
    """First neighbours: those beside a row along several directions, within cells of so many planes that a cell has a few
    hundred rows. Equal places are told apart by the id, so that copies are spread over tasks."""
    planes = max(0, int(math.log2(max(1, n / 256))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for t in range(orders if len(x) else 0):
                rng = np.random.default_rng(seed + t)
                cell = (x @ rng.normal(size=(x.shape[1], planes)) > 0) @ (1 << np.arange(planes)) if planes else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(cell.astype(np.int64)), pa.array(x @ rng.normal(size=x.shape[1]))], ["id", "v", "t", "cell", "place"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), None
        for b in batches:
            more = _matrix(b.column(1))
            ids, x = np.concatenate([ids, b.column(0).to_numpy()]), more if x is None else np.concatenate([x, more])
            out: tuple[list, list, list] = ([], [], [])
            while len(ids) >= 2 * BESIDE:
                _near(ids[:BESIDE], x[:BESIDE], GIVEN, None, out)
                ids, x = ids[BESIDE // 2 :], x[BESIDE // 2 :]
            yield _table(*out)
        if len(ids):
            out = ([], [], [])
            _near(ids, x, GIVEN, None, out)
            yield _table(*out)

    placed = vectors.mapInArrow(place, "id bigint, v binary, t int, cell bigint, place double")
    order = ["t", "cell", "place", F.xxhash64("id")]
    return placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("id", "v").mapInArrow(compare, EDGES)


def _best(edges: DataFrame, k: int, partitions: int) -> DataFrame:
    """The k nearest of each row, each once; fresh is what wasn't there before."""
    once = edges.repartition(partitions, "id").groupBy("id", "other").agg(F.min("distance").alias("distance"), F.bool_and("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).where(F.col("rank") <= k)


def _some(links: DataFrame, most: int, turn: int) -> DataFrame:
    """So many members of each group, by chance: rows that are near to very many don't make a large group."""
    chance = F.row_number().over(Window.partitionBy("at").orderBy(F.xxhash64("at", "id", F.lit(turn)), "id"))
    return links.withColumn("rn", chance).where(F.col("rn") <= most).drop("rn")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows (at, id, fresh, furthest, v), one after the other; a group may go on in the next batch."""
    parts, x = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)], None
    out: tuple[list, list, list] = ([], [], [])

    def group(i: int, j: int) -> None:
        _, ids, fresh, far = (p[i:j] for p in parts)
        _near(ids, x[i:j], FROM_GROUP, far**2, out, fresh)

    for b in batches:
        more = _matrix(b.column(4))
        parts = [np.concatenate([p, b.column(i).to_numpy(zero_copy_only=False)]) for i, p in enumerate(parts)]
        x = more if x is None else np.concatenate([x, more])
        ends = np.flatnonzero(np.diff(parts[0])) + 1
        for i, j in zip([0, *ends[:-1]], ends, strict=False):
            group(i, j)
        last = ends[-1] if len(ends) else 0
        parts, x = [p[last:] for p in parts], x[last:]
        yield _table(*out)
        out = ([], [], [])
    if len(parts[0]):
        group(0, len(parts[0]))
        yield _table(*out)


def _members(edges: DataFrame, most: int, turn: int) -> DataFrame:
    """(at, id, fresh): what is compared in this round. Fresh links lead both ways; to each row that has any come, as many
    at most, others of its links, and the row itself."""

    def links(of: DataFrame) -> DataFrame:
        return _some(of.select(F.col("id").alias("at"), F.col("other").alias("id")).union(of.select(F.col("other").alias("at"), "id")).repartition("at").distinct(), most, turn)

    fresh = links(edges.where("fresh"))
    at = fresh.select("at").distinct()
    others = links(edges.where("not fresh")).join(at, "at", "left_semi").union(at.select("at", F.col("at").alias("id")))
    both = fresh.withColumn("fresh", F.lit(True)).union(others.withColumn("fresh", F.lit(False)))
    return both.groupBy("at", "id").agg(F.bool_or("fresh").alias("fresh"))


def nearest(df: DataFrame, key: str, vector: str, k: int = 15, wide: int = 2, orders: int = 6, rounds: int = 12, members: int = 30, still: float = 0.0005, seed: int = 42) -> DataFrame:
    """(id, other, distance, rank): the k nearest other rows of each row, Euclidean, almost all of them right. On the way
    `wide` times as many are kept, and so many links of a row are followed in a round, both ways, fresh and others.

    Rounds end when distances get shorter by less than `still` of their sum. What becomes of rows that can't be compared,
    and of repeated ids, is told at `prepared`. Rows have fewer neighbours where there are no more; an empty table, or one
    of a single row, has none.
    """
    vectors = stored(_packed(prepared(df, key, vector)), "vectors")
    n = vectors.count()
    partitions = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    new = lambda found: found.withColumn("fresh", F.lit(True))
    edges = stored(_best(new(_beside(vectors, n, orders, seed, partitions)), wide * k, partitions), "neighbours")
    before = None
    for turn in range(rounds):
        size, length = edges.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if not size or (before and size == before[0] and before[1] - length <= still * before[1]):
            break
        before = (size, length)
        furthest = edges.groupBy("id").agg(F.when(F.count(F.lit(1)) >= wide * k, F.max("distance")).otherwise(float("inf")).alias("furthest"))
        known = vectors.join(furthest, "id", "left").select("id", F.coalesce("furthest", F.lit(float("inf"))).alias("furthest"), "v")
        groups = _members(edges, members, turn).join(known, "id").select("at", "id", "fresh", "furthest", "v")
        found = groups.repartition(partitions, "at").sortWithinPartitions("at", "id").mapInArrow(_compared, EDGES)
        old = edges.select("id", "other", "distance", F.lit(False).alias("fresh"))
        edges = stored(_best(old.union(new(found)), wide * k, partitions), "neighbours")
    return edges.where(F.col("rank") <= k).select("id", "other", "distance", "rank")


# ---- layout


def curve(least: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a * d ** (2 * b)), which comes nearest to 1 up to the least distance and a falling exponential
    from there on (Gauss and Newton's method)."""
    d = np.linspace(0.01, 3 * spread, 300)
    want = np.where(d < least, 1.0, np.exp(-(d - least) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        p = d ** (2 * b)
        y = 1 / (1 + a * p)
        slopes = np.stack([-(y**2) * p, -(y**2) * a * p * 2 * np.log(d)], 1)
        step = np.linalg.lstsq(slopes, want - y, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-3, b + 0.5 * step[1])
    return float(a), float(b)


def bandwidths(distances: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For rows of rising distances (NaN where there are none): the least above zero, and the bandwidth with which the
    weights of what lies beyond it sum up to log2 of their number. By bisection, all rows at once."""
    k = np.isfinite(distances).sum(1)
    least = np.nanmin(np.where(distances > 0, distances, np.nan), axis=1, initial=np.inf)
    least = np.where(np.isfinite(least), least, 0.0)
    beyond = np.maximum(np.nan_to_num(distances, nan=np.inf) - least[:, None], 0)
    want, lo, hi, mid = np.log2(np.maximum(k, 2)), np.zeros(len(k)), np.full(len(k), np.inf), np.ones(len(k))
    for _ in range(rounds):
        total = np.exp(-beyond / mid[:, None]).sum(1)
        hi, lo = np.where(total > want, mid, hi), np.where(total > want, lo, mid)
        mid = np.where(np.isfinite(hi), (lo + hi) / 2, 2 * mid)
    mean = np.nan_to_num(np.nanmean(np.where(np.isfinite(distances), distances, np.nan), axis=1, keepdims=False) if distances.size else np.zeros(len(k)))
    return least, np.maximum(mid, np.maximum(1e-3 * mean, 1e-12))


def weights(graph: DataFrame) -> DataFrame:
    """(id, other, weight) in both directions: how surely two rows are neighbours, in one's view or the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, others = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist()
            if not lists:
                continue
            d = np.full((len(lists), max(map(len, lists))), np.nan)
            for i, x in enumerate(lists):
                d[i, : len(x)] = x
            least, width = bandwidths(d)
            w = np.exp(-np.maximum(d - least[:, None], 0) / width[:, None])
            row, col = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_pydict({"id": ids[row], "other": np.array([others[i][j] for i, j in zip(row, col, strict=True)], np.int64), "weight": w[row, col]})

    lists = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("x"))
    one = lists.select("id", "x.distance", "x.other").mapInArrow(run, "id bigint, other bigint, weight double")
    pair = one.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("weight").alias("w1"), F.max("weight").alias("w2"), F.count(F.lit(1)).alias("n"))
    both = F.when(F.col("n") == 1, F.col("w1")).otherwise(F.col("w1") + F.col("w2") - F.col("w1") * F.col("w2"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")
    return pair.select(ways, both.alias("weight")).select("e.*", "weight")


def _moved(pos: np.ndarray, ends: np.ndarray, others: np.ndarray, here: np.ndarray, fixed: np.ndarray, weight: np.ndarray, away: np.ndarray, rates: np.ndarray, a: float, b: float, rng, pushes: int) -> np.ndarray:
    """Moves a block's rows once for each rate. An edge leads from row `ends` to row `others` of the block where that is
    not below 0, else to its fixed place."""
    for rate in rates:
        used = np.flatnonzero(rng.random(len(weight)) < weight)
        u = ends[used]
        target = np.where(here[used, None], pos[others[used]], fixed[used])
        d = pos[u] - target
        q = (d * d).sum(1)
        pull = np.where(q > 0, -2 * a * b * np.maximum(q, 1e-12) ** (b - 1) / (1 + a * q**b), 0)
        step = np.zeros_like(pos)
        np.add.at(step, u, np.clip(pull[:, None] * d, -4, 4))
        if len(away):
            for _ in range(pushes):
                d = pos[u] - away[rng.integers(0, len(away), len(u))]
                q = (d * d).sum(1)
                push = 2 * b / ((0.001 + q) * (1 + a * q**b))
                np.add.at(step, u, np.where(q[:, None] > 0, np.clip(push[:, None] * d, -4, 4), 0))
        # As one edge after the other would, but no row moves further than a single edge may for each that it has.
        pos = pos + rate * np.clip(step, -8, 8)
    return pos


def _mover(rates: np.ndarray, seed: list[int], a: float, b: float, pushes: int):
    """What a block does in a round. Its rows come as kind 0 (its own, with their places), 1 (edges from them, with the
    places they lead to) and 2 (places to be pushed away from). They are put in order first, so that a lost task that is
    run again gives the same."""

    def run(key, rows):
        kind, xy = rows["kind"].to_numpy(), np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], 1)
        ids, others, own = (rows[c].fill_null(0).to_numpy() for c in ("id", "other", "kind"))
        own = np.flatnonzero(own == 0)
        own = own[np.argsort(ids[own])]
        names, e = ids[own], np.flatnonzero(kind == 1)
        e = e[np.isin(ids[e], names)]
        e = e[np.lexsort((others[e], ids[e]))]
        to = np.minimum(np.searchsorted(names, others[e]), max(0, len(names) - 1))
        here = names[to] == others[e] if len(names) else np.zeros(len(e), bool)
        away = xy[kind == 2]
        away = away[np.lexsort((away[:, 1], away[:, 0]))]
        rng = np.random.default_rng([*seed, key[0].as_py()])
        pos = _moved(xy[own], np.searchsorted(names, ids[e]), to, here, xy[e], rows["weight"].fill_null(0).to_numpy()[e], away, rates, a, b, rng, pushes)
        return pa.table({"id": names, "x": pos[:, 0], "y": pos[:, 1]})

    return run


def layout(graph: DataFrame, starts: DataFrame, rounds: int = 12, inner: int = 16, least: float = 0.1, rate: float = 0.3, pushes: int = 5, seed: int = 42) -> DataFrame:
    """(id, x, y): positions in which the neighbours of a graph (id, other, distance) lie together, from those of `starts`.

    Rows without neighbours stay where they start; rows that the graph alone names have no place. An empty graph moves
    nothing.
    """
    a, b = curve(least)
    links = weights(graph)
    top = links.agg(F.max("weight")).first()[0] or 1.0
    n = starts.count()
    blocks = max(1, math.ceil(n / BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    links = stored(links.withColumn("weight", F.col("weight") / top), "links")
    part = min(1.0, PUSHING / max(1, n))
    place, total = starts.select("id", "x", "y"), rounds * inner

    for turn in range(rounds):
        at = stored(place, "places")
        moving = at.select(block("id").alias("block"), F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("weight"), "x", "y")
        edges = links.join(at.withColumnRenamed("id", "other"), "other").select(block("id").alias("block"), F.lit(1).alias("kind"), "id", "other", "weight", "x", "y")
        # A sample of a bounded size that every block is pushed away from.
        pushing = at.where(F.pmod(F.xxhash64("id", F.lit(f"{seed}:{turn}")), F.lit(1 << 30)) < int(part * (1 << 30))).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("weight"), "x", "y")
        rates = rate * (1 - (turn * inner + np.arange(inner)) / total)

        place = moving.union(edges).union(pushing).groupBy("block").applyInArrow(_mover(rates, [seed, turn], a, b, pushes), "id bigint, x double, y double")
    return place


def plane(df: DataFrame, key: str, vector: str, k: int = 15, least: float = 0.1, seed: int = 42, init: str = "pca", graph: DataFrame | None = None) -> DataFrame:
    """(id, x, y): neighbours in the plane, for rows that can be compared (see `prepared`). init: 'pca', or 'random' for
    places by the hash of the id. Fewer than four rows, or less than two dimensions, are too few for a layout: such rows
    keep their first places."""
    from brightloom.operators import models

    vectors = stored(prepared(df, key, vector), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    by_hash = lambda c: (F.pmod(F.xxhash64("id", F.lit(f"{seed}{c}")), F.lit(1 << 20)) / float(1 << 20) * 20 - 10).alias(c)
    small = n < 4 or (width or 0) < 2
    if init == "random" or small:
        starts = vectors.select("id", by_hash("x"), by_hash("y"))
    else:
        rows = models.plane(vectors, "v")
        span = rows.agg(F.max(F.greatest(F.abs("pc1"), F.abs("pc2")))).first()[0] or 1.0
        noise = lambda c: F.col(c) * F.lit(10.0 / span)
        starts = rows.select("id", (noise("pc1")).alias("x"), (noise("pc2")).alias("y"))
        starts = starts.select("id", *[(F.col(c) + by_hash(c) * 1e-4).alias(c) for c in "xy"])
    if small:
        return starts
    return layout(graph if graph is not None else nearest(vectors, "id", "v", min(k, n - 1), seed=seed), starts, least=least, seed=seed)
