"""A corpus pipeline in five stages. Each takes the documents that its predecessor kept, read back from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import bpe, exact, mixing, simhash, toxicity
from brightloom.llm.common import crc_mod, scratch_table, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half stay. The classifier learns from the same labels as op1's."""
    taught = crc_mod("doc_id", 5) != 0
    return toxicity.clean(docs, table(spark, sf_dir, "labels").where(taught), docs.where(taught))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.dedupe(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links, the document with the smallest id stays."""
    return simhash.dedupe(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: its ids, packed as little-endian unsigned 32-bit integers, their number, and
    digests of the ids and of the text that they decode to."""
    encoded = bpe.Codec.fit(docs).encode(docs, keep=("source", "lang"), decoded=True)
    return encoded.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Scores, fingerprints and ids aren't for SQL to make; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
