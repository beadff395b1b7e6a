"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut after sentences whose own hash meets a condition, so that a cut depends on nothing that stands before the
sentence; each chunk gets an identifier, and texts are compared by their ordered lists of identifiers. An identifier is a
digest that has been verified: over the whole corpus, distinct chunks were compared by content, and a digest that stands
for two contents is not trusted. So a long document is moved at most once, as distinct chunks; what is grouped and joined
are recipes of a few bytes for each kB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import ascii_lower, free_names, quoted, scratch_table, text_or_empty, with_group

#: One unit (a sentence, a word where no sentence ends) in so many ends a chunk; characters in which a sentence is to end,
#: and of a chunk at most.
ONE_IN, LONGEST, MOST = 32, 256, 16_384
#: What is put in where a chunk ends, and what stands for the first of its characters in a text.
ESCAPE, CUT, SAME = "\x00", "\x00\x01", "\x00\x02"


def chunks(text: Column, one_in: int = ONE_IN, longest: int = LONGEST, most: int = MOST) -> Column:
    """Chunks of a text, from which it can be told in full; none for an empty text.

    A unit is a sentence, up to a full stop, exclamation mark, question mark or line break; where none comes within
    `longest` characters, a word with the white space behind it; in a longer unbroken run, what ends with one of some
    fixed characters, or one character. A unit whose hash meets the condition ends a chunk, whatever stands before it.
    Only a chunk of more than `most` characters is cut by length, up to where the next such unit ends it.
    """
    units = rf"(?s)[^.!?\n]{{0,{longest}}}[.!?\n]|\S{{0,64}}\s|[^a-m0-4A-M\s]{{0,15}}[a-m0-4A-M]|."
    found = F.regexp_extract_all(F.replace(text, F.lit(ESCAPE), F.lit(SAME)), F.lit(units), F.lit(0))
    marked = F.transform(found, lambda s: F.when(F.pmod(F.xxhash64(s), F.lit(one_in)) == 0, F.concat(s, F.lit(CUT))).otherwise(s))
    whole = F.filter(F.split(F.array_join(marked, ""), CUT, -1), lambda c: c != "")
    short = F.transform(whole, lambda c: F.when(F.char_length(c) > most, F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{most}}}"), F.lit(0))).otherwise(F.array(c)))
    return F.flatten(short)


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def with_recipe(docs: DataFrame, text: str = "text", digest: Callable[[Column], Column] = sha256, sha: str | None = None, keep: list[str] | None = None, **how) -> tuple[DataFrame, str]:
    """The rows of docs, with the columns to keep (all if None) and one, whose name is returned, of the ordered chunk
    identifiers; sha: a column to add with the digest of the normalised text. Null counts as empty, and the recipe of an
    empty text is empty. Equal recipes mean equal normalised texts."""
    kept = list(docs.columns if keep is None else keep)
    normal, parts, ids, recipe, key, bad = free_names(docs, "normal", "chunks", "ids", "recipe", "key", "bad")
    out = docs.withColumn(normal, ascii_lower(text_or_empty(text))).withColumn(parts, chunks(F.col(normal), **how))
    out = out.withColumn(ids, F.transform(parts, digest))
    if sha:
        out = out.withColumn(sha, F.sha2(F.col(normal).cast("binary"), 256))
    more = [ids, *([sha] if sha else [])]
    if text in kept:
        # Whole rows are written once; their texts are cut again for the check, rather than written twice.
        out = scratch_table(out.select(*quoted(kept), *more), "recipes").withColumn(parts, chunks(ascii_lower(text_or_empty(text)), **how))
    else:
        # Cut and hashed once; identifiers are checked against the chunks that were written beside them.
        out = scratch_table(out.select(*quoted(kept), *more, parts), "chunks")
    # An outer inline: else Spark first cuts each text to see whether it has chunks.
    found = out.select(F.inline_outer(F.arrays_zip(F.col(ids).alias("digest"), F.col(parts).alias("chunk")))).where("digest is not null")
    untrusted = found.distinct().groupBy("digest").count().where("count > 1").select("digest")
    untrusted = scratch_table(untrusted, "untrusted")
    listed = F.unhex(F.array_join(F.transform(ids, lambda d: F.hex(d)), ""))
    if untrusted.isEmpty():
        return out.withColumn(recipe, listed).drop(parts, ids), recipe
    # Wherever a digest isn't to be trusted, the chunks themselves stand beside the identifiers.
    out = out.withColumn(recipe, listed).withColumn(key, F.sha2(recipe, 256))
    marked = out.select(key, F.explode(ids).alias("digest")).join(untrusted, "digest", "left_semi").select(key).distinct().withColumn(bad, F.lit(True))
    content = F.array_join(F.transform(parts, lambda c: F.hex(F.encode(c, "utf-8"))), ",").cast("binary")
    out = out.join(marked, key, "left").withColumn(recipe, F.when(F.col(bad), F.concat(F.col(recipe), F.lit(b"\0"), content)).otherwise(F.col(recipe)))
    return out.drop(parts, ids, key, bad), recipe


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z) the row with the largest id stays. Rows with a null id belong to the group
    of their text but stay only if it has no other id; a repeated row is counted, and marked, as often as it is there.
    Other columns of docs don't matter. An empty table gives an empty result.
    """
    rows, recipe = with_recipe(docs.select(F.col(id_col), F.col(text)), text, sha="text_sha256", keep=[id_col], **how)
    # What is grouped are recipes, a small part of their texts; what is joined, as that of a long text is long, are digests.
    groups = rows.groupBy(recipe).agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    (mark,) = free_names(rows, "mark")
    marked = lambda df: df.withColumn(mark, F.unhex(F.sha2(recipe, 256))).drop(recipe)
    return with_group(marked(rows), marked(groups), mark, "group_size").select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all their columns. Each task first keeps the best of
    its own rows, so that a group of any size moves no more than one row from each task. Of rows with the same id any
    may stay; null ids count as the smallest; an empty table gives an empty result."""
    rows, recipe = with_recipe(docs, text, **how)
    whole = F.struct(*quoted(docs.columns))
    best = rows.groupBy(recipe).agg(F.max_by(whole, F.struct(F.col(id_col))).alias("row"))
    return best.select("row.*")
