"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of characters that it holds, each scaled by the log ratio of the texts that hold
it among toxic and other ones (Wang and Manning 2012), the whole vector to about length one. A logistic regression, in which
both classes weigh the same, is trained on them in rounds: every shard of the sample moves the common weights by gradient
steps over its rows, and the results are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.bpe import text_bytes
from brightloom.llm.common import free_names, pieces, quoted, scratch_table, tidied

#: Lengths of n-grams in characters, hash buckets, labelled texts of each class that are learned from at most.
NGRAMS, BUCKETS, SAMPLE = (3, 4, 5, 6, 7), 1 << 20, 10_000
#: Texts in a shard of the sample and shards at most, rounds of averaging, the gradient's step, and the texts that a
#: ratio's prior counts for: so many must hold an n-gram before its ratio outweighs that of all texts.
SHARD_ROWS, SHARDS, ROUNDS, STEP, PRIOR = 1500, 12, 3, 0.3, 20.0
#: The bias at most, so that a text without telling n-grams isn't called toxic, and what is added to a squared length, so
#: that a few n-grams of a short text don't weigh like a whole text's.
LEAN, SHORT = -0.5, 100.0
#: Bytes of text taken up at a time, of many texts or of one; pieces that a vector of weights is summed up in.
PIECE, CHUNKS = 1 << 20, 16


def hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the buckets of the n-grams that begin at each code point; those that would run over the end are
    left out. A-Z count as a-z."""
    points = points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint32)
    h, upto = np.zeros(len(points), np.uint32), 0
    for n in NGRAMS:
        for k in range(upto, n):
            h *= np.uint32(0x01000193)
            h[: max(0, len(h) - k)] += points[k:]
        upto = n
        g = h[: max(0, len(h) - n + 1)].copy()
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA6B + 2 * n)
        g ^= g >> np.uint32(13)
        g &= np.uint32(BUCKETS - 1)
        yield g


def features(text: bytes) -> np.ndarray:
    """The buckets of the n-grams that a text holds between two spaces, each once; of a long text, a piece at a time."""
    if len(text) <= PIECE:
        grams = np.concatenate(list(hashes(_points(b" " + text + b" "))))
        # Of a bucket that occurs again only the last place stays.
        last, places = _last(), np.arange(len(grams), dtype=np.int32)
        last[grams] = places
        return grams[last[grams] == places]
    seen, before = np.zeros(BUCKETS, bool), np.array([32], np.uint32)
    for k in range(0, len(text), PIECE):
        low, high = _character(text, k), _character(text, k + PIECE)
        points = np.concatenate([before, _points(text[low:high]), [32] if high == len(text) else []]).astype(np.uint32)
        for h in hashes(points):
            seen[h] = True
        before = points[-(NGRAMS[-1] - 1) :]
    return np.flatnonzero(seen).astype(np.uint32)


def packed_grams(grams: np.ndarray) -> bytes:
    """The buckets in their order: how many have each value of the upper bits, then the lower 16 bits of each."""
    grams = np.sort(grams)
    return np.bincount(grams >> 16, minlength=BUCKETS >> 16).astype("<u4").tobytes() + (grams & 0xFFFF).astype("<u2").tobytes()


def unpacked_grams(raw) -> np.ndarray:
    upper = BUCKETS >> 16
    counts = np.frombuffer(raw, "<u4", upper)
    return np.frombuffer(raw, "<u2", offset=4 * upper).astype(np.uint32) + np.repeat(np.arange(upper, dtype=np.uint32) << 16, counts)


@cache
def _last() -> np.ndarray:
    """Scratch room for each process; what is read there was written just before."""
    return np.zeros(BUCKETS, np.int32)


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)


def _character(text: bytes, at: int) -> int:
    """The first place from there on where a character begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


class ToxicityModel:
    """For each bucket the ratio and the weight of its scaled feature, and a bias."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float):
        self.bias = float(bias)
        # What an n-gram adds to the sum and to the squared length, side by side.
        self.adds = np.stack([ratio * weights, ratio * ratio], 1).astype(np.float32)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE, rounds: int = ROUNDS) -> ToxicityModel:
        """Learns from rows of docs that have a label: a sample of at most `most` texts of each class, chosen by a hash.
        An id with several labels counts as toxic if any says so; null labels teach nothing. An id with several texts
        teaches one of them. Without labels of both classes, all texts get one score, below a half."""
        spark = docs.sparkSession
        marked = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
        draws = marked.join(docs.select(F.col(id_col).alias("__id")).where("__id is not null").distinct(), "__id", "left_semi").withColumn("h", F.pmod(F.xxhash64("__id"), F.lit(1 << 30)))
        draws = scratch_table(draws, "toxic-labels")
        sizes = {r.y: r.n for r in draws.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        # A bound on the hash lets a few more than wanted pass, so that a limit gathers no more than those.
        passed = [draws.where((F.col("y") == y) & (F.col("h") < int(min(1.0, 1.2 * most / n) * (1 << 30)))).orderBy("h", "__id").limit(most) for y, n in sorted(sizes.items())]
        chosen = draws.limit(0)
        for some in passed:
            chosen = chosen.union(some)
        chosen = scratch_table(chosen.select("__id", "y"), "toxic-ids")
        shards = max(1, min(SHARDS, chosen.count() // SHARD_ROWS))
        # At most 2 * most ids: a bound that doesn't grow. A repeated id's texts meet in one row, where they are first.
        sample = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
        sample = sample.groupBy("__id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))
        spread = sample.repartition(shards, F.xxhash64("__id", F.lit(1))).coalesce(shards).sortWithinPartitions(F.xxhash64("__id", F.lit(2)), "__id")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high in pieces(batch, 1, PIECE):
                    some = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([packed_grams(features(t.as_py().encode())) for t in some.column(1)], pa.binary())], ["y", "grams"])

        # Written once, an n-gram as two bytes; every round streams it. A file of it is a shard, in its rows' order.
        packed = scratch_table(spread.select("y", "text").mapInArrow(tidied(pack), "y int, grams binary"), "toxic-grams")

        def summed(work, kind: type, *sizes: int) -> list[np.ndarray]:
            """The sums over all shards of the vectors, of numbers of that kind, that work makes of a shard's rows. Tasks
            without rows add nothing, however finely the files are read."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = ((y.as_py(), unpacked_grams(g.as_buffer())) for batch in batches for y, g in zip(batch.column(0), batch.column(1), strict=True))
                for no, vector in enumerate(work(rows)):
                    parts = np.array_split(np.asarray(vector, kind), CHUNKS)
                    yield pa.RecordBatch.from_arrays([pa.array([no] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["no", "chunk", "part"])

            def add(table: pa.Table) -> pa.Table:
                total = sum(np.frombuffer(p.as_buffer(), kind).astype(np.float64) for p in table.column("part"))
                return pa.table({"no": table.column("no")[:1], "chunk": table.column("chunk")[:1], "total": pa.array([total.astype(np.float64).tobytes()], pa.binary())})

            found = packed.mapInArrow(tidied(run), "no int, chunk int, part binary").groupBy("no", "chunk").applyInArrow(tidied(add), "no int, chunk int, total binary").collect()
            at = {(r.no, r.chunk): np.frombuffer(bytes(r.total), np.float64) for r in found}
            return [np.concatenate([at[no, c] for c in range(CHUNKS)]) if (no, 0) in at else np.zeros(n) for no, n in enumerate(sizes)]

        def count(rows):
            seen, n = np.zeros((2, BUCKETS), np.uint32), np.zeros(2, np.uint32)
            for y, grams in rows:
                seen[y, grams] += 1
                n[y] += 1
            return (seen[0], seen[1], n) if n.any() else ()

        other, toxic, (n0, n1) = summed(count, np.uint32 if 2 * most > 65_535 else np.uint16, BUCKETS, BUCKETS, 2)
        if not n0 or not n1:
            return cls(np.zeros(BUCKETS), np.zeros(BUCKETS), -1.0)
        prior = PRIOR / (n0 + n1)
        ratio = np.log((toxic / n1 + prior) / (other / n0 + prior) / ((n1 + PRIOR) / n1) * ((n0 + PRIOR) / n0)).astype(np.float32)
        w, bias = np.zeros(BUCKETS, np.float32), LEAN
        weight = np.array([(n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)])
        for _ in range(rounds):
            state = spark.sparkContext.broadcast((w, bias, ratio, weight))

            def improve(rows):
                w, bias, ratio, weight = state.value  # noqa: B023
                w, n = w.copy(), 0
                for y, grams in rows:
                    x = ratio[grams]
                    x /= math.sqrt(float(x @ x) + SHORT)
                    error = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[grams] @ x) + bias)))) - y
                    w[grams] -= np.float32(STEP * weight[y] * error) * x
                    bias = min(LEAN, bias - 0.05 * STEP * weight[y] * error)
                    n += 1
                if n:
                    yield from (w * np.float32(n), np.array([bias * n, n]))

            total, (biases, n) = summed(improve, np.float32, BUCKETS, 2)
            w, bias = (total / n).astype(np.float32), float(biases / n)
            state.unpersist()
        return cls(ratio, w, bias)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability for each text."""
        out = np.zeros(len(offsets) - 1)
        raw = data.tobytes()
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            grams = features(raw[low:high])
            total, squares = self.adds[grams].sum(0, dtype=np.float64)
            out[i] = total / math.sqrt(squares + SHORT) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def score(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, out: str = "score") -> DataFrame:
        """One row for each row of docs, with the columns to keep (all if None) and the score, from 0 to 1.

        Only the text goes to Python, the other columns wait beside it. Null texts score as empty ones, which have next
        to no n-grams and get about the score of the bias; repeated rows come back as often as they are there, an empty
        table gives an empty result, columns of any other names don't matter.
        """
        kept = list(docs.columns if keep is None else keep)
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def of_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = sent.value
            for batch in texts:
                rows = pa.RecordBatch.from_arrays([batch], ["text"])
                yield pa.array(np.concatenate([model.scores(*text_bytes(batch.slice(low, high - low))) for low, high in pieces(rows, 0, PIECE)] or [np.zeros(0)]))

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from tidied(of_batches)(texts)

        run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return docs.select(*quoted(kept), F.arrow_udf(run, T.DoubleType())(F.col(text)).alias(out))


def clean(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; training: where to learn, if not all of
    docs. Null and empty texts stay, repeated rows fare alike, an empty table gives an empty result."""
    model = ToxicityModel.fit(docs if training is None else training, labels, **how)
    (score,) = free_names(docs, "toxic")
    return model.score(docs, out=score).where(F.col(score) < threshold).drop(score)
