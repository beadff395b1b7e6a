"""Scores of texts under language models: a smoothed unigram base, and a hashed maximum-entropy model whose softmax is
factored into classes and words.

Texts are cut into words once, in blocks of documents, which are kept as numbers of the block's distinct words; training
and scores read those, so what depends on a word alone is looked up once for each distinct word of a block. Exact word
counts come from the blocks, too: each sends its distinct words, dealt into buckets, and gets their counts in the corpus
back, so that no vocabulary is ever whole in one place. The maximum-entropy model predicts the
class of the next word, then its entry in that class, from hashed features of the words before. Every word has a class:
the most frequent words are entries of their own, all others share an entry with words of like beginning and end, and
among those the counts decide. It is trained by gradient updates in every partition, which start from the counts and
whose results are averaged over a tree, each parameter by how often it was updated.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import most_frequent, pieces, scratch_table, tidied

#: Classes of frequent words and entries in each; the same for all other words, by hashes of their first and of their last
#: bytes; rows of hashed word pairs; hashed rows of weights, one for each entry of a class.
CLASSES, PER, AFFIX, PAIRS, WEIGHTS = 32, 32, 2, 1 << 13, 1 << 14
#: Bytes of text in a block and documents at most; tokens of an update; step; partial results that one task adds up.
BLOCK, BLOCK_DOCS, TOKENS, STEP, FAN_IN, CHUNKS = 1 << 23, 60_000, 8192, 0.15, 64, 16
#: Rows of a place that are added up together with those of other places.
TOGETHER = 32
#: Tokens whose rows are gathered at a time.
AT_ONCE = 1024
#: Entries of frequent words, and in all; what stands before a text is one symbol more.
SIZE, ENTRIES = CLASSES * PER, 2 * CLASSES * PER
SYMBOLS = ENTRIES + 1
ROWS = 2 * SYMBOLS + PAIRS
END = b""
#: Scores between these need no shift before they are exponents of float32.
LOW, HIGH = -60, 80


def numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts (A-Z lower-cased, cut at ASCII white space; null counts as empty), the number of each
    word in them, text by text, and how many words each text has. Frequent words come first, equally frequent ones in
    order, as both numbers and words take less room then."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths, coded = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
    words, numbers = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    empty = pc.index(words, b"").as_py()
    if empty >= 0:  # before white space that begins a text, and behind what ends it
        doc, there = np.repeat(np.arange(len(lengths)), lengths), numbers != empty
        numbers, lengths = numbers[there], np.bincount(doc[there], minlength=len(lengths))
    order, times = pc.sort_indices(words).to_numpy(), np.bincount(numbers, minlength=len(words))
    order = order[np.argsort((65535 - np.minimum(times[order], 65535)).astype(np.uint16), kind="stable")]
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    return words.take(pa.array(order[: len(words) - (empty >= 0)])).to_pylist(), number[numbers], lengths


def buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(w) % buckets for w in words], np.int64)


def shared_entry(word: bytes) -> int:
    """The entry that a word shares, unless it is a frequent one: its class by the beginning, its place there by the end."""
    return SIZE + zlib.crc32(word[:AFFIX]) % CLASSES * PER + zlib.crc32(word[-AFFIX:]) % PER


# ---- counts


def _ranges(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    for low, high in pieces(batch, text, BLOCK):
        for k in range(low, high, BLOCK_DOCS):
            yield batch.slice(k, min(high, k + BLOCK_DOCS) - k)


def word_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """From (id, train, text): for each block and bucket the distinct words and how often each stands in training
    documents. A block's row of bucket -1 has all of its words and its documents, as the numbers of their words among
    the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _ranges(batch, 2):
                words, numbers, lengths = numbered(part.column(2))
                train = np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool)
                taught = np.bincount(numbers[np.repeat(train, lengths)], minlength=len(words)).astype("<i8")
                bucket = buckets_of(words, buckets)
                chosen = np.argsort(bucket, kind="stable")
                at_word = np.searchsorted(bucket[chosen], np.arange(buckets + 1))
                block, out = uuid.uuid4().hex, []
                for b in range(buckets):
                    w = chosen[at_word[b] : at_word[b + 1]]
                    if len(w):
                        out.append((b, b" ".join([words[i] for i in w.tolist()]), taught[w].tobytes()))
                cols = list(zip(*out, strict=True)) if out else [()] * 3
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.string()), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]], *[pa.nulls(k, pa.binary())] * 2, *[pa.nulls(k, f.type) for f in extra]], names)
                whole = [pa.array([x], pa.binary()) for x in (_packed(b" ".join(words)), _packed((numbers & 65535).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()))]
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), x) for x in (part.column(0), part.column(1), pa.array(lengths))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), *[pa.nulls(1, pa.binary())] * 2, *whole, *lists], names)

    kinds = [rows.schema["id"].dataType, T.BooleanType(), T.LongType()]
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["block", "bucket", "words", "taught", "own", "numbers", "ids", "trains", "lengths"]
    extra = [pa.field("x", pa.list_(to_arrow_type(k))) for k in kinds]
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in names[2:6]], *[T.StructField(c, T.ArrayType(k)) for c, k in zip(names[6:], kinds, strict=True)]])
    return rows.select("id", "train", "text").mapInArrow(tidied(run), schema)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _own(packed: bytes) -> list[bytes]:
    words = _unpacked(packed)
    return words.split(b" ") if words else []


def _numbers(packed: bytes) -> np.ndarray:
    """Their lower halves come first, then their upper ones."""
    low, high = np.frombuffer(_unpacked(packed), "<u2").reshape(2, -1)
    return low + (high.astype(np.int64) << 16)


def bucket_counts(blocks: DataFrame, top: int = SIZE) -> DataFrame:
    """For each bucket and block the training counts of the block's words; a row of each bucket without a block has the
    bucket's most frequent words, its tokens and its distinct words, these two also by the entries that words share."""

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = defaultdict(count().__next__)
        words = [[number[w] for w in raw.as_py().split(b" ")] for raw in table.column("words")]
        places, taught = [np.array(w, np.int64) for w in words], [np.frombuffer(t.as_py(), "<i8") for t in table.column("taught")]
        totals = np.zeros(len(number), np.int64)
        for at, n in zip(places, taught, strict=True):
            totals[at] += n  # a block's words are distinct
        counts = dict(zip(number, totals.tolist(), strict=True))
        back = [totals[at].astype("<i8").tobytes() for at in places]
        # Only words that are as frequent as the last of the most frequent ones are sorted.
        least = max(1, np.partition(totals, -top)[-top]) if len(totals) > top else 1
        best = sorted((-n, w) for w, n in counts.items() if n >= least)[:top]
        k = table.num_rows
        shared = np.array([shared_entry(w) - SIZE for w in counts], np.int64)
        entries = [np.bincount(shared, x, SIZE).astype(np.int64).tolist() for x in (totals, totals > 0)]
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), None], pa.string()), "bucket": pa.array([*table.column("bucket").to_pylist(), table.column("bucket")[0].as_py()], pa.int32()), "counts": pa.array([*back, None], pa.binary()),
            "words": pa.array([None] * k + [[w for _, w in best]], pa.list_(pa.binary())), "ns": pa.array([None] * k + [[-n for n, _ in best]], pa.list_(pa.int64())),
            "total": pa.array([None] * k + [sum(counts.values())], pa.int64()), "known": pa.array([None] * k + [sum(1 for n in counts.values() if n)], pa.int64()),
            "entry_n": pa.array([None] * k + [entries[0]], pa.list_(pa.int64())), "entry_v": pa.array([None] * k + [entries[1]], pa.list_(pa.int64())),
        })

    return blocks.where("bucket >= 0").select("block", "bucket", "words", "taught").groupBy("bucket").applyInArrow(tidied(run), "block string, bucket int, counts binary, words array<binary>, ns array<long>, total long, known long, entry_n array<long>, entry_v array<long>")


# ---- the maximum-entropy model


class Maxent:
    """Parameters: biases of classes and entries from counts, rows of class weights for each feature, and hashed rows of
    the entries' weights for each feature and class. head: the frequent words; shared: for each other entry, the tokens and distinct
    words of the training texts that share it."""

    def __init__(self, head: list[tuple[bytes, int]], shared: np.ndarray):
        self.number = {w: i for i, (w, _) in enumerate(head)}
        counts = np.zeros(SIZE)
        counts[: len(head)] = [n for _, n in head]
        # A shared entry has the weight of its tokens, one more for each word, and one for all words that weren't seen.
        self.log_shared = np.log10(shared.sum(0) + 1.0)
        mass = np.append(counts, shared.sum(0) + 1.0).reshape(2 * CLASSES, PER)
        total = mass.sum(1) + 0.5
        self.class_bias = np.log(total / total.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.word_bias = np.maximum(np.log(mass), -60).astype(np.float32)
        self.rows, self.weights = np.zeros((ROWS, 2 * CLASSES), np.float32), np.zeros((WEIGHTS, PER), np.float32)

    def entries(self, words: list[bytes]) -> np.ndarray:
        """The entry of each word; a number below SIZE is a word's own."""
        own = self.number
        return np.array([own[w] if w in own else shared_entry(w) for w in words], np.uint16)

    def sequence(self, entries: np.ndarray, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the words and the end of each text, and where texts begin."""
        ends = np.cumsum(lengths + 1) - 1
        return with_ends(entries[numbers], ends, self.number[END]), ends - lengths

    def features(self, sequence: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: rows of the word before, of the word before that (a skip), and of both together. Texts begin
        at starts; what stands before is one symbol more."""
        one, two = np.full_like(sequence, SYMBOLS - 1), np.full_like(sequence, SYMBOLS - 1)
        one[1:], two[2:] = sequence[:-1], sequence[:-2]
        one[starts] = two[starts] = SYMBOLS - 1
        second = starts + 1
        two[second[second < len(two)]] = SYMBOLS - 1
        both = (one.astype(np.uint32) * np.uint32(0x9E3779B1) + two.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIRS.bit_length() + 1)
        return one, SYMBOLS + two, 2 * SYMBOLS + both.astype(np.int64)

    def places(self, features: tuple, cls: np.ndarray) -> list[np.ndarray]:
        """For each feature, the row with the weights of all entries of each token's class."""
        out, own = [], cls.astype(np.uint32) * np.uint32(0x85EBCA6B)
        for f in features:
            h = (f.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) + own
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            out.append((h & np.uint32(WEIGHTS - 1)).astype(np.int64))
        return out

    def class_scores(self, features: tuple) -> np.ndarray:
        z = _added(self.rows, features)
        z += self.class_bias
        return z

    def word_scores(self, places: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        return _added(self.weights, places, _rows(self.word_bias, cls))

    def log10s(self, sequence: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's entry."""
        features, cls, out = self.features(sequence, starts), sequence // PER, np.empty(len(sequence))
        places, entry = self.places(features, cls), sequence % PER
        for k in _parts(len(sequence)):
            out[k] = _log_of(self.class_scores([f[k] for f in features]), cls[k])
            out[k] += _log_of(self.word_scores([p[k] for p in places], cls[k]), entry[k])
        return out / np.log(10)

    def update(self, sequence: np.ndarray, starts: np.ndarray, seen: dict) -> None:
        """One gradient step on the tokens. seen: squares of the gradients, and how often each parameter moved."""
        features, cls = self.features(sequence, starts), sequence // PER
        places, entry = self.places(features, cls), sequence % PER
        error, inner = np.empty((len(sequence), 2 * CLASSES), np.float32), np.empty((len(sequence), PER), np.float32)
        for k in _parts(len(sequence)):
            error[k] = _errors(self.class_scores([f[k] for f in features]), cls[k])
        for f in features:
            found, times, g = _sums(error, f)
            squares = seen["row_squares"][found] + np.einsum("ij,ij->i", g, g) / g.shape[1]
            seen["row_squares"][found] = squares
            g *= (STEP / np.sqrt(squares))[:, None]
            _put(self.rows, found, np.subtract(_rows(self.rows, found), g, out=g))
            seen["row_times"][found] += times
        for k in _parts(len(sequence)):
            inner[k] = _errors(self.word_scores([p[k] for p in places], cls[k]), entry[k])
        for p in places:
            found, times, g = _sums(inner, p)
            squares = _rows(seen["weight_squares"], found)
            squares += g * g
            _put(seen["weight_squares"], found, squares)
            g *= STEP
            g /= np.sqrt(squares, out=squares)
            _put(self.weights, found, np.subtract(np.take(self.weights, found, 0, out=squares, mode="clip"), g, out=g))
            seen["weight_times"][found] += times


def with_ends(values: np.ndarray, ends: np.ndarray, end) -> np.ndarray:
    """Values of the words of texts with one for the end of each, which stand at ends."""
    out = np.empty(len(values) + len(ends), values.dtype)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = values, end
    return out


def _parts(n: int) -> list[slice]:
    return [slice(k, min(n, k + AT_ONCE)) for k in range(0, n, AT_ONCE)]


def _put(table: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """table[places] = rows, each row as one value."""
    row = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(row)[:, 0][places] = rows.view(row)[:, 0]


def _rows(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """table[places], for places that are there, without a check of each."""
    return np.take(table, places, 0, mode="clip")


def _added(table: np.ndarray, places, z: np.ndarray | None = None) -> np.ndarray:
    """The sums of the rows at the places of all features, on top of z. Some tokens at a time, over the same room, as fresh
    memory for all of them takes longer than the sums."""
    n, places = len(places[0]), list(places)
    if z is None:
        z = _rows(table, places.pop(0))
    room = np.empty((min(n, AT_ONCE), table.shape[1]), table.dtype)
    for k in range(0, n, AT_ONCE):
        part = z[k : k + AT_ONCE]
        for p in places:
            part += np.take(table, p[k : k + AT_ONCE], 0, out=room[: len(part)], mode="clip")
    return z


def _sums(error: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places that occur, how often, and the sums of the rows of each. Most places occur a few times: the first rows of
    all are added up together, then the second ones, and so on, and what frequent places have beyond that by itself.
    Places with more rows come first, so that those with a k-th row are together."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(first, len(at)))
    lacks = (TOGETHER - np.minimum(times, TOGETHER)).astype(np.uint8)
    by = np.argsort(lacks, kind="stable")
    first, times, having = first[by], times[by], np.cumsum(np.bincount(lacks, minlength=TOGETHER))
    sums = _rows(error, order[first])
    room = np.empty((having[TOGETHER - 2], error.shape[1]), error.dtype)
    for k in range(1, TOGETHER):
        m = having[TOGETHER - 1 - k]
        if not m:
            break
        sums[:m] += np.take(error, order[first[:m] + k], 0, out=room[:m], mode="clip")
    for i in np.flatnonzero(times[: having[0]] > TOGETHER).tolist():
        sums[i] += _rows(error, order[first[i] + TOGETHER : first[i] + times[i]]).sum(0)
    return ordered[first], times, sums


def fresh() -> dict:
    """What updates keep account of, before the first."""
    return {"row_squares": np.full(ROWS, 1e-4, np.float32), "row_times": np.zeros(ROWS), "weight_squares": np.full((WEIGHTS, PER), 1e-2, np.float32), "weight_times": np.zeros(WEIGHTS)}


def _exponents(z: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen entry of each row, and the sum of the row's exponentials, which take the place of z. Rows whose values
    float32 has no exponentials of are shifted, all of z with them."""
    each = np.arange(len(z))
    picked = z[each, chosen]
    if z.size and not (z.max() < HIGH and picked.min() > LOW):
        z -= z.max(1, keepdims=True)
        picked = z[each, chosen]
    np.exp(z, out=z)
    return picked, z @ np.ones(z.shape[1], z.dtype)


def _log_of(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The logarithm of each row's chosen entry of its softmax; z is used up."""
    picked, total = _exponents(z, chosen)
    return picked.astype(np.float64) - np.log(total.astype(np.float64))


def _errors(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The softmax of each row, less one at the chosen entry; z is used up."""
    _, total = _exponents(z, chosen)
    z *= (1 / total)[:, None]
    z[np.arange(len(z)), chosen] -= 1
    return z


def _sequences(model: Maxent, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """From blocks (own, numbers, trains, lengths): the sequence of each training text."""
    for own, numbers, trains, lengths in zip(*batch.columns, strict=True):
        lengths = lengths.values.to_numpy()
        sequence, starts = model.sequence(model.entries(_own(own.as_py())), _numbers(numbers.as_py()), lengths)
        for train, at, n in zip(trains.as_py(), starts.tolist(), lengths.tolist(), strict=True):
            if train:
                yield sequence[at : at + n + 1]


def _batches(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in found], np.int64)
    return np.concatenate(found, dtype=np.int64), np.cumsum(lengths) - lengths


def train(blocks: DataFrame, head: list[tuple[bytes, int]], shared: np.ndarray, passes: int = 1) -> Maxent:
    """Trains on the training documents of word_blocks, all of them, each once in a pass."""
    model = Maxent(head, shared)
    spark = blocks.sparkSession
    cuts = [np.linspace(0, n, CHUNKS + 1).astype(int) for n in (ROWS, WEIGHTS)]
    schema = "chunk int, part int, num binary, den binary"

    def add_up(table: pa.Table) -> pa.Table:
        total = None
        for num, den in zip(table.column("num"), table.column("den"), strict=True):
            pair = np.frombuffer(num.as_py(), np.float32), np.frombuffer(den.as_py(), np.float32)
            total = pair if total is None else (total[0] + pair[0], total[1] + pair[1])
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()), "num": pa.array([total[0].tobytes()]), "den": pa.array([total[1].tobytes()])})

    for _ in range(passes):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import copy

            from pyspark import TaskContext

            local = copy.copy(sent.value)  # noqa: B023
            local.rows, local.weights = local.rows.copy(), local.weights.copy()
            held, size, seen = [], 0, fresh()

            def step() -> None:
                # A long text is several updates.
                sequence, starts = _batches(held)
                for k in range(0, len(sequence), 4 * TOKENS):
                    upto = min(len(sequence), k + 4 * TOKENS)
                    inside = starts[(starts >= k) & (starts < upto)] - k
                    local.update(sequence[k:upto], np.union1d(inside, [0]), seen)
                held.clear()

            for batch in batches:
                for s in _sequences(local, batch):
                    held.append(s)
                    size += len(s)
                    if size >= TOKENS:
                        step()
                        size = 0
            if held:
                step()
            if not seen["row_times"].any():
                return
            part = TaskContext.get().partitionId()
            parts = []
            for c in range(CHUNKS):
                (a, b), (x, y) = ((k[c], k[c + 1]) for k in cuts)
                den = np.append(seen["row_times"][a:b], seen["weight_times"][x:y])
                num = np.append((local.rows[a:b] * seen["row_times"][a:b, None]).ravel(), (local.weights[x:y] * seen["weight_times"][x:y, None]).ravel())
                parts.append((c, part, num.astype(np.float32).tobytes(), den.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "part", "num", "den"])

        texts = blocks.where("bucket = -1").select("own", "numbers", "trains", "lengths")
        partial, tasks = texts.mapInArrow(tidied(run), schema), texts.rdd.getNumPartitions()
        while True:
            partial = partial.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("chunk", "group").applyInArrow(tidied(add_up), schema)
            tasks = -(-tasks // FAN_IN)
            if tasks <= 1:
                break
        for r in partial.collect():
            (a, b), (x, y) = ((k[r.chunk], k[r.chunk + 1]) for k in cuts)
            num, den = np.frombuffer(bytes(r.num), np.float32), np.frombuffer(bytes(r.den), np.float32)
            wide = np.append(np.repeat(den[: b - a], 2 * CLASSES), np.repeat(den[b - a :], PER))
            mean = np.divide(num, wide, out=np.zeros_like(num), where=wide > 0).astype(np.float32)
            model.rows[a:b], model.weights[x:y] = mean[: (b - a) * 2 * CLASSES].reshape(b - a, -1), mean[(b - a) * 2 * CLASSES :].reshape(y - x, -1)
        sent.unpersist()
    return model


def block_scores(blocks: DataFrame, counts: DataFrame, model: Maxent, buckets: int) -> DataFrame:
    """For each document: id, train, n_words, known (words with a count), sum, of log10(count + 1) over its words, and full,
    log10 of the text's probability: that of the entries of its words and its end, and of each word that isn't a frequent one
    among those that share its entry."""
    id_type = blocks.schema["ids"].dataType.elementType
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = sent.value
        words = _own(left.column("own")[0].as_py())
        numbers, lengths = _numbers(left.column("numbers")[0].as_py()), left.column("lengths")[0].values.to_numpy()
        bucket = buckets_of(words, buckets)
        chosen = np.argsort(bucket, kind="stable")
        at_word, c = np.searchsorted(bucket[chosen], np.arange(buckets + 1)), np.zeros(len(words), np.int64)
        for b, back in zip(right.column("bucket").to_pylist(), right.column("counts"), strict=True):
            c[chosen[at_word[b] : at_word[b + 1]]] = np.frombuffer(back.as_py(), "<i8")
        entries, logs = model.entries(words), np.log10(c + 1.0)
        among = np.where(entries >= SIZE, logs - model.log_shared[np.maximum(entries, SIZE) - SIZE], 0)
        sequence, starts = model.sequence(entries, numbers, lengths)
        full = np.empty(len(sequence))
        # Some tokens at a time, of which each knows the two before it.
        for k in range(0, len(sequence), TOKENS):
            low, upto = max(0, k - 2), min(len(sequence), k + TOKENS)
            inside = starts[np.searchsorted(starts, low) : np.searchsorted(starts, upto)] - low
            full[k:upto] = model.log10s(sequence[low:upto].astype(np.int64), inside)[k - low :]
        ends = starts + lengths
        full += with_ends(among[numbers], ends, 0)
        sums = [np.add.reduceat(x, starts) for x in (with_ends((c > 0)[numbers], ends, False).astype(np.int64), with_ends(logs[numbers], ends, 0), full)]
        flat = lambda x: left.column(x).combine_chunks().flatten()
        return pa.table([flat("ids"), flat("trains"), flat("lengths"), *map(pa.array, sums)], ["id", "train", "n_words", "known", "sum", "full"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("train", T.BooleanType()), T.StructField("n_words", T.LongType()), T.StructField("known", T.LongType()), T.StructField("sum", T.DoubleType()), T.StructField("full", T.DoubleType())])
    left = blocks.where("bucket = -1").select("block", "own", "numbers", "ids", "trains", "lengths").groupBy("block")
    return left.cogroup(counts.where("block is not null").select("block", "bucket", "counts").groupBy("block")).applyInArrow(tidied(run), schema)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text", passes: int = 1) -> DataFrame:
    """One row for each row of docs: id_col, train, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which `training` holds. Tokens are a text's words and one end; null texts have only the
    end. base_score sums log10((c + 1) / (N + V + 1)) over the tokens; score is log10 of the text's probability under
    the maximum-entropy model. Repeated rows count as often as they are there. Without training rows, N and V are 0 and
    both scores are those of the empty model.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text).alias("text"))
    buckets = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = scratch_table(word_blocks(rows, buckets), "word-blocks")
    counts = scratch_table(bucket_counts(blocks), "word-counts")
    summed = counts.where("block is null").agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
    taught = blocks.where("bucket = -1").agg(F.sum(F.size(F.filter("trains", lambda t: t)))).first()[0] or 0
    n_words, v_words = summed.n or 0, summed.v or 0
    best = most_frequent(counts.where("block is null").select(F.inline(F.arrays_zip("words", "ns"))), "ns", SIZE - 1).collect()
    head = sorted([(END, taught), *((bytes(r.words), r.ns) for r in best)], key=lambda x: (-x[1], x[0]))
    entries = counts.where("block is null").select(F.posexplode(F.arrays_zip("entry_n", "entry_v"))).groupBy("pos").agg(F.sum("col.entry_n").alias("n"), F.sum("col.entry_v").alias("v")).collect()
    shared = np.zeros((2, SIZE))
    for r in entries:
        shared[:, r.pos] = r.n, r.v
    for w, k in head:
        if w != END:  # frequent words have left the entries that they would share
            shared[:, shared_entry(w) - SIZE] -= k, 1
    model = train(blocks, head, shared, passes) if taught else Maxent(head, shared)
    scored = block_scores(blocks, counts, model, buckets)
    n, v = n_words + taught, v_words + (1 if taught else 0)
    n_tokens = F.col("n_words") + 1
    base = F.col("sum") + F.log10(F.lit(taught + 1.0)) - n_tokens * F.log10(F.lit(float(n + v + 1)))
    return scored.select(F.col("id").alias(id_col), "train", n_tokens.alias("n_tokens"), (F.col("known") + (1 if taught else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("full").alias("score"))
