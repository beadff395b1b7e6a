"""SimHash near-dedup: fingerprints are embedded as counts of set bits in their segments, joined on a grid within a
Manhattan distance that bounds the Hamming distance from below, and verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import free_names, quoted, scratch_table, tidied, with_group
from brightloom.llm.components import connected_components

#: Words of a shingle, differing bits of a link, seed of the hash.
WORDS, BITS, SEED = 3, 3, 42
#: Hashes counted at a time, and members of a grid cell that are compared pair by pair.
HASHES, CROWDED = 1 << 15, 512


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it; 0 for a text without words."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    starts, at = [], 0
    for w in found:
        starts.append(at)
        at += len(w) + 1
    if len(found) < words:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts, [s - 1 for s in starts[words:]] + [len(joined)])  # noqa: B905
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES):
        counts += np.unpackbits(hashes[k : k + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_of(text: str, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint of a column of texts, as a signed long; null counts as empty. Only the text goes to Python."""

    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words, seed) for t in batch], np.uint64).view(np.int64))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(of_batches)(batches)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.LongType())(F.col(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id_col, fp) for each row: the fingerprint as a signed long. Null texts count as empty."""
    return docs.select(F.col(id_col), fingerprint_of(text, words, seed).alias("fp"))


# ---- the embedding: 32 segments of two bits, whose counts 0, 1 or 2 stay packed in the segments' own bits

_ODD = 0x5555555555555555


def _both(fp: Column) -> Column:
    return F.shiftleft(fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_ODD)), 1)


def segment_counts(fp: Column) -> Column:
    return _both(fp).bitwiseOR(fp.bitwiseXOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_ODD)))


def thermometer(fp: Column) -> Column:
    """The counts as 00, 01 and 11, so that their Manhattan distance is a number of differing bits."""
    return _both(fp).bitwiseOR(fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_ODD)))


def cells(fps: DataFrame) -> DataFrame:
    """(fp, half, cell, home): the grid cells in which a fingerprint looks for others.

    Two fingerprints with at most three differing bits differ by at most one in the counts of one half's 16 segments,
    taken together. A cell is one value of a half's counts. Each fingerprint is at home in its own cell of either half;
    those with an even number of bits in the half also visit all cells at distance one, where only odd ones are at home.
    """
    counts = segment_counts(F.col("fp"))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), counts.bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(counts, 32).alias("cell"), F.shiftrightunsigned("fp", 32).alias("bits")),
    )
    rows = fps.select("fp", F.inline(halves))
    at_home = rows.select("fp", "half", "cell", F.lit(True).alias("home"))
    # Segment i counts (cell >> 2i) & 3: one more where it is below 2, one less where it is above 0.
    steps = F.expr(
        "flatten(transform(sequence(0, 15), i -> filter(array("
        "if((shiftright(cell, 2 * i) & 3) < 2, cell + shiftleft(1L, 2 * i), null), if((shiftright(cell, 2 * i) & 3) > 0, cell - shiftleft(1L, 2 * i), null)), c -> c is not null)))"
    )
    visits = rows.where(F.bit_count("bits") % 2 == 0).select("fp", "half", F.explode(steps).alias("cell"), F.lit(False).alias("home"))
    return at_home.union(visits)


def _odd(half: Column, fp: Column) -> Column:
    bits = F.when(half == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    return F.bit_count(bits) % 2 == 1


def crowded_links(fps: DataFrame) -> DataFrame:
    """(a, b) links that connect the same fingerprints as all pairs within three bits, in rows that grow with the
    fingerprints and not with their pairs.

    Each fingerprint names everything within one bit of it and everything within two. At a name, the smallest
    fingerprint within one bit is at most three bits from all that are there. For two fingerprints within three bits
    there is a name within one bit of the first and two of the second.
    """
    one = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    two = F.expr("flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))")
    near = fps.select("fp", F.explode(one).alias("name"), F.lit(True).alias("near"))
    far = fps.select("fp", F.explode(two).alias("name"), F.lit(False).alias("near"))
    named = near.union(far)
    hubs = near.groupBy("name").agg(F.min("fp").alias("hub"))
    return named.join(hubs, "name").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect what pairs within three bits connect.

    In a cell, whoever is at home is compared with the others there and with the visitors. Cells with more members than
    `crowded` aren't: all their members take the way of crowded_links, which loses nothing either.
    """
    grid = scratch_table(cells(fps), "grid")
    full = scratch_table(grid.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("any_home").where(F.col("n") > crowded).select("half", "cell"), "crowded")
    any_full = not full.isEmpty()
    calm = grid.join(full, ["half", "cell"], "left_anti") if any_full else grid
    here = calm.where("home").select("half", "cell", F.col("fp").alias("a"))
    there = calm.select("half", "cell", F.col("fp").alias("b"), "home")
    met = here.join(there, ["half", "cell"])
    # The bound over all segments first, then the exact distance.
    bound = F.bit_count(thermometer(F.col("a")).bitwiseXOR(thermometer(F.col("b"))))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    once = F.when(F.col("home"), F.col("a") < F.col("b")).otherwise(_odd(F.col("half"), F.col("a")))
    pairs = met.where(once & (bound <= BITS) & (exact <= BITS)).select("a", "b")
    if any_full:
        members = grid.join(full, ["half", "cell"], "left_semi").select("fp").distinct()
        pairs = pairs.union(crowded_links(members))
    return pairs


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """One row for each row of docs: id_col, fp (a signed long), component_id.

    component_id is the smallest id of the documents that can be reached over links, and links join fingerprints that
    differ in at most three bits. Texts without words, null ones too, have fingerprint zero and link like any other.
    Rows with a null id take part; a group of only such rows has a null component_id. Repeated rows come back as often
    as they are there; other columns don't matter; an empty table gives an empty result.
    """
    return grouped(scratch_table(fingerprints(docs, id_col, text, words), "fingerprints"), id_col, crowded)


def grouped(rows: DataFrame, id_col: str, crowded: int = CROWDED) -> DataFrame:
    """near_groups of rows (id_col, fp) that are cheap to read."""
    classes = scratch_table(rows.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("rows")), "fp-classes")
    reach = connected_components(fingerprint_links(classes.select("fp"), crowded))
    roots = classes.join(reach, classes.fp == reach.id, "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(names, "root").select("fp", "rows", "component_id")
    return with_group(rows, named, "fp", "rows").select(id_col, "fp", "component_id")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the one with the smallest id. A row that is
    repeated, or an id whose texts have one fingerprint, stays once; an id that has texts of several groups stays in each
    that it is the smallest of. Rows with a null id all stay, since nothing tells them apart. An empty table gives an
    empty result."""
    (fp,) = free_names(docs, "fp")
    full = scratch_table(docs.withColumn(fp, fingerprint_of(text, words)), "fingerprinted")
    named = full.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(fp).alias("fp"))
    kept = grouped(named, id_col, crowded).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col), F.col("fp").alias(fp)).distinct()
    stay = full.join(kept, [id_col, fp], "left_semi").dropDuplicates([id_col, fp])
    return stay.unionByName(full.where(F.col(id_col).isNull())).select(*quoted(docs.columns))


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
