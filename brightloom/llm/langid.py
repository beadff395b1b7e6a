"""Language identification by compression: a text belongs to the language whose raw-content dictionary makes it smallest."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import scratch_table, tidied

UNKNOWN = "und"
#: Documents sampled for each language's dictionary, the characters of a long one that travel, the dictionary's size, to
#: which every one of them adds a passage, and the languages that there may be.
ROWS, LONGEST, SIZE, LANGUAGES = 128, 8000, 1 << 16, 2000
#: Texts are compressed in pieces of so many bytes, each from the dictionary alone, so that a long text doesn't become
#: its own dictionary. The margin is what the runner-up needs more, as a part; below NARROW a text is rejected.
PIECE, LEVEL, MIN_MATCH, NARROW = 2048, 6, 3, 0.02

#: Bytes that a dictionary has at least.
LEAST = 8

_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    """Runs of letters in lower case, with single spaces between; empty if there are none."""
    return _NOT_LETTERS.sub(" ", text or "").strip().lower().encode()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(dictionary), min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how)


def classify(compressors: list[tuple[str, zstandard.ZstdCompressor]], text: str | None) -> tuple[str, float]:
    """The language and the margin. compressors: the commonest language first, which takes ties."""
    raw = letters(text)
    if not raw or not compressors:
        return UNKNOWN, 0.0
    sizes = [sum(len(c.compress(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)) for _, c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = sizes[:best] + sizes[best + 1 :]
    return compressors[best][0], (min(others) - sizes[best]) / min(others) if others else 1.0


_ready: dict[str, list] = {}


class LanguageModel:
    """Dictionaries of the learned languages, the commonest first, sent to all workers."""

    def __init__(self, spark, dictionaries: list[tuple[str, bytes]]):
        self.languages = [lang for lang, _ in dictionaries]
        self.name, self.packed = uuid.uuid4().hex, spark.sparkContext.broadcast(dictionaries)

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> LanguageModel:
        """Learns from the rows of docs with a language: a sample of at most `rows` documents of each, chosen by a hash
        alone, whatever their length. Each teaches a passage from a place that a hash chooses, all of them equally long
        together SIZE bytes; shorter documents teach whole. Rows that are null in either column or have no letter teach
        nothing. More than LANGUAGES values are taken for an error, since a dictionary of each goes to all tasks."""
        known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
        known = known.withColumn("taught", F.rlike("text", F.lit(r"\p{L}")))
        counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("taught").alias("able"))
        counts = scratch_table(counts, "languages")
        if (found := counts.count()) > LANGUAGES:
            raise ValueError(f"{found} values of {lang}, more than {LANGUAGES}")
        # A hash below a bound that lets about four times as many pass, then the first of those. The counts, one row for
        # each language, are broadcast: else all texts would first be dealt out by language.
        draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
        wanted = F.col("h") < F.lit(float(1 << 30)) * 4 * rows / F.greatest(F.col("able"), F.lit(1))
        passed = known.where("taught").withColumn("h", draw).join(F.broadcast(counts), "lang").where(wanted)
        # Of a long text a passage with letters travels, from a place that the hash chooses.
        spoken = F.regexp_replace("text", r"\P{L}+", " ")
        start = F.pmod(F.col("h"), F.greatest(F.char_length(spoken) - LONGEST, F.lit(1)))
        passed = passed.withColumn("text", F.when(F.octet_length("text") > LONGEST, F.substr(spoken, (start + 1).cast("int"), F.lit(LONGEST))).otherwise(F.col("text")))
        first = Window.partitionBy("lang").orderBy("h", "id")
        chosen = passed.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows)

        def build(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("k")
            texts = [letters(t) for t in group.text]
            part = max(LEAST, SIZE // len(texts) - 1)
            starts = [int(h) % max(1, len(t) - part + 1) for h, t in zip(group.h, texts, strict=True)]
            body = b" ".join(t[at : at + part] for at, t in zip(starts, texts, strict=True))
            while 0 < len(body) < LEAST:
                body += b" " + body
            return pd.DataFrame({"lang": [group.lang.iloc[0]], "n": [group.n.iloc[0]], "body": [body]})

        built = chosen.groupBy("lang").applyInPandas(tidied(build), "lang string, n long, body binary").collect()
        # A language none of whose documents has a letter isn't known.
        return cls(docs.sparkSession, [(r.lang, bytes(r.body)) for r in sorted(built, key=lambda r: (-r.n, r.lang)) if len(r.body) >= LEAST])

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each row of docs: id_col, lang_pred, score, margin, rejected.

        lang_pred is `und`, score 0, for a text that is null or has no letter. The score grows with the margin from 0
        to 1; a text whose margin is narrow keeps its likeliest language but is marked as rejected. Repeated rows come
        back as often as they are there, an empty table gives an empty result, other columns don't matter.
        """
        name, packed = self.name, self.packed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _ready:
                _ready.clear()
                _ready[name] = [(lang, compressor(body)) for lang, body in packed.value]
            for batch in batches:
                found = [classify(_ready[name], t.as_py()) for t in batch.column(1)]
                margins = [m for _, m in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([1 - math.exp(-20 * m) for m in margins], pa.float64()), pa.array(margins, pa.float64()), pa.array([x == UNKNOWN or m < NARROW for x, m in found], pa.bool_())],
                    [id_col, "lang_pred", "score", "margin", "rejected"],
                )

        fields = [docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
        return docs.select(F.col(id_col), F.col(text).alias("__text")).mapInArrow(tidied(run), T.StructType(fields))
