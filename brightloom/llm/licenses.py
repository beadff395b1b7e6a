"""License scans by an exact set-similarity join, in DataFrame functions only.

A text is cut into blocks of words that overlap by half, so that every passage as long as a template lies whole in one. A
template is found in a block that holds at least a given part of its distinct words. Words are put in the order of how
often the whole corpus has them, rarest first. Three filters, none of which loses a block, keep the join small:

* prefix: a block with enough of a template's n words (say m) has one of its n - m + 1 rarest, so only those are joined;
* length: a block has at least m words of any template;
* position: from the first word that both have on, either must have m words left in the common order.

What passes is held against the template's words exactly. A template that must stand as it is, word by word, is then looked
up in the blocks that hold all of its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import ascii_lower, text_or_empty

#: A word of a text whose letters are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The part of a template's distinct words that a block must hold.
THRESHOLD = 0.8

#: Words from the start of one block to the start of the next, unless a template is longer. Blocks are twice as long.
STEP = 32


@dataclass(frozen=True)
class Template:
    """What a license is told by. phrase: its words must stand consecutively; else a part of them in one block is enough."""

    name: str
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        out = [""]
        for c in self.text:
            c = c.lower() if c.isascii() else c
            if c.isalnum() or not c.isascii():
                out[-1] += c
            elif out[-1]:
                out.append("")
        return [w for w in out if w]


#: The base phrases and their labels.
BASE = tuple(
    Template(f"base-{label}", label, text, True)
    for text, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
)

#: Beside the base, versions named in full, and openings of well-known license texts and notices.
OWN = (
    Template("gpl-2", "gpl-2.0", "gnu general public license version 2", True),
    Template("gpl-3", "gpl-3.0", "gnu general public license version 3", True),
    Template("apache-2", "apache-2.0", "apache license version 2 0", True),
    Template("cc-by-nc", "cc-by-nc", "cc by nc", True),
    Template("cc-by-sa", "cc-by-sa", "cc by sa", True),
    Template("mit-text", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("apache-notice", "apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd-text", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc-text", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    Template("mpl-notice", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    Template("unlicense-text", "unlicense", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES = (*BASE, *OWN)

MATCHES = "array<struct<name:string,label:string,block:bigint,places:array<bigint>,containment:double>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def corpus_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often all texts have the words of the templates: no more rows than the templates have words come back."""
    words = docs.select(F.explode(words_of(text_or_empty(f"`{text}`"))).alias("w")).where(F.col("w").isin(vocabulary))
    return {r.w: r.n for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _need(words: list[str], template: Template, threshold: float) -> int:
    return len(words) if template.phrase else max(1, math.ceil(round(threshold * len(words), 9)))


def _index(docs: DataFrame, templates: tuple[Template, ...], order: dict[str, int], threshold: float) -> tuple[DataFrame, list[str]]:
    """A row for each template and word of its prefix; and the words of all prefixes. As small as the templates are."""
    rows, firsts = [], set()
    for t in templates:
        words = sorted(set(t.words), key=order.__getitem__)
        need = _need(words, t, threshold)
        phrase = F.array(*map(F.lit, t.words)) if t.phrase else F.lit(None).cast("array<string>")
        for i, w in enumerate(words[: len(words) - need + 1]):
            firsts.add(w)
            rows.append(F.struct(F.lit(w).alias("t_word"), F.lit(t.name).alias("t_name"), F.lit(t.label).alias("t_label"), F.array(*map(F.lit, words)).alias("t_words"), phrase.alias("t_phrase"), F.lit(need).alias("t_need"), F.lit(len(words) - i).alias("t_left")))
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows))), sorted(firsts)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep: tuple[str, ...] | None = None, text: str = "text", threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """The columns of docs (or those of `keep`; a text among them is copied for each block that is looked at), n_words and
    matches, one for each template and block where it is found: its name and label, the place of the block's first word,
    the places where a phrase starts in the block's first half (that way each place counts once), and the part of the
    template's distinct words that the block holds.

    A null text counts as empty and has no words; an empty or wordless one has no matches; repeated rows and null ids each
    keep their own row; an empty table gives an empty one. A column of docs named n_words or matches gives way to the new
    one.
    """
    templates = tuple(t for t in templates if t.words)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "matches")]
    if not templates:
        return docs.select(*[f"`{c}`" for c in keep], F.size(words_of(text_or_empty(f"`{text}`"))).cast("long").alias("n_words"), F.array().cast(MATCHES).alias("matches"))
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = corpus_counts(docs, vocabulary, text)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index, firsts = _index(docs, templates, order, threshold)
    step = max(step, *(len(t.words) for t in templates))

    # What is kept is one column, so that none of it clashes with the columns made here.
    kept = F.struct(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).alias("row"))
    rows = docs.select(kept.alias("kept"), F.monotonically_increasing_id().alias("id"), words_of(text_or_empty(f"`{text}`")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    blocks = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("words", s + 1, 2 * step).alias("words")))
    any_first = F.arrays_overlap("words", F.array(*map(F.lit, firsts)))
    rows = rows.select("kept", "id", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.when(any_first, blocks)).alias("block"))
    # The block's words of any template, rarest first, and how many are left from each on.
    rows = rows.withColumn("own", F.array_intersect(F.array(*[F.lit(w) for w in order]), "block.words"))
    left = F.transform("own", lambda w, i: F.struct(w.alias("word"), (F.size("own") - i).alias("left")))
    rows = rows.select("kept", "id", "n_words", "block", F.posexplode_outer(F.filter(left, lambda x: x["word"].isin(firsts))).alias("no", "first"))
    near = rows.join(F.broadcast(index), (F.col("first.word") == F.col("t_word")) & (F.col("first.left") >= F.col("t_need")), "left")

    phrase = lambda p: F.slice("block.words", p + 1, F.size("t_phrase")) == F.col("t_phrase")
    near = near.withColumn("both", F.when(F.col("t_word").isNotNull(), F.array_intersect("t_words", "block.words")))
    # Of the prefix words that a block shares with a template, the first one stands for the pair.
    found = (F.get("both", F.lit(0)) == F.col("t_word")) & (F.size("both") >= F.col("t_need"))
    near = near.withColumn("places", F.when(found & F.col("t_phrase").isNotNull(), F.filter(F.sequence(F.lit(0), F.lit(step - 1)), phrase)))
    found = F.coalesce(found & (F.col("t_phrase").isNull() | (F.size("places") > 0)), F.lit(False))
    at = F.col("block.at").cast("long")
    match = F.struct(F.col("t_name").alias("name"), F.col("t_label").alias("label"), at.alias("block"), F.transform(F.coalesce("places", F.array().cast("array<int>")), lambda p: at + p).alias("places"), (F.size("both") / F.size("t_words")).alias("containment"))
    # One row of each text stays in any case.
    head = (F.coalesce(at, F.lit(0)) == 0) & (F.coalesce("no", F.lit(0)) == 0)
    near = near.where(found | head).select("kept", "id", "n_words", F.when(found, match).alias("match"))
    out = near.groupBy("id").agg(F.first("kept").alias("kept"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_list("match")).alias("matches"))
    return out.select(*(["kept.row.*"] if keep else []), "n_words", "matches")


def labels(matches: str | Column, of: tuple[Template, ...] = TEMPLATES) -> Column:
    """The distinct labels of the templates named, in their order, comma-joined."""
    names = [t.name for t in of]
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(matches, lambda m: m["name"].isin(names)), lambda m: m["label"]))), ",")


def places(matches: str | Column, of: tuple[Template, ...]) -> Column:
    """The first word of every place of the phrases named."""
    names = [t.name for t in of]
    return F.flatten(F.transform(F.filter(matches, lambda m: m["name"].isin(names)), lambda m: m["places"]))


def best(matches: str | Column) -> Column:
    """The greatest part of a template that a block holds; 0 if none is found."""
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))
