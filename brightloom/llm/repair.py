"""Repair of conversations: the cheapest edits that make the roles of each take turns, found by iterative deepening.

Rows of a conversation may be kept (K), given another role (R) or deleted (D), and empty ones may be put in (I), until the
initials of the roles read s?(ua)+ or nothing. A search goes through the edits depth first, in the order of their letters,
under a bound on the cost that grows to the least cost seen beyond it. States that failed are remembered with what they
could have spent, in that round and all that follow. So the first path that is accepted is the cheapest, and of equal ones
the least in the order of the letters.

Conversations pass through the tasks as streams in their order. A task holds one character and a fault for each row of one
conversation, the digests of its texts, and its edits; texts pass by. A second pass over the same order makes the digest of
what the edits give, as that can only be made from the first row to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import scratch_table, tidied

#: What edits cost; a truncated row that isn't deleted costs so much more.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

FINE, CUT, BLANK, COPY = range(4)
SPACES = " \t\n\x0b\x0c\r"

# What has been read: nothing, s, (s?)(ua)*u, or (s?)(ua)+; where a role's initial leads; what a row put in or renamed is.
START, S, U, A = range(4)
LEADS = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
GIVES = (U, U, A, U)
NAMES = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}

#: Finished conversations of a batch that a task gives back.
BATCH = 1024


def bounds(initials: str, faults: list[int]) -> list[list[int]]:
    """For each row and state, what the edits from there on cost at least: a row that fits is kept, and once a row must be
    mended, whichever state suits what follows best is taken for granted."""
    out = [[0, 2 * INSERT, INSERT, 0]]
    for c, f in zip(reversed(initials), reversed(faults), strict=True):
        after = out[-1]
        if f >= BLANK:
            out.append([DELETE + x for x in after])
            continue
        cost, best = TRUNCATED * (f == CUT), min(after)
        mended = min(DELETE, cost + min(RELABEL, INSERT)) + best
        out.append([min(mended, cost + after[LEADS[q][c]]) if c in LEADS[q] else mended for q in range(4)])
    return out[::-1]


def cheapest(initials: str, faults: list[int]) -> tuple[int, str]:
    """The least cost and the edits' letters, for rows with these roles' initials (one character each) and faults."""
    n, least = len(initials), bounds(initials, faults)
    failed = [-1] * (4 * n + 4)  # the most that could still be spent in a state that came to nothing
    bound = least[0][START]
    while True:
        above, letters = None, []
        stack = [(0, START, 0, iter("DIKR"))]
        while stack:
            i, q, g, edits = stack[-1]
            if i == n and q in (START, A):
                return g, "".join(letters)
            for e in edits:
                if e == "I":
                    i2, q2, g2 = i, GIVES[q], g + INSERT
                elif i == n:
                    continue
                elif e == "D":
                    i2, q2, g2 = i + 1, q, g + DELETE
                elif faults[i] >= BLANK or (e == "K" and initials[i] not in LEADS[q]):
                    continue
                else:
                    i2, q2, g2 = i + 1, LEADS[q][initials[i]] if e == "K" else GIVES[q], g + TRUNCATED * (faults[i] == CUT) + RELABEL * (e == "R")
                rest = max(least[i2][q2], failed[4 * i2 + q2] + 1)
                if g2 + rest > bound:
                    above = g2 + rest if above is None else min(above, g2 + rest)
                    continue
                letters.append(e)
                stack.append((i2, q2, g2, iter("DIKR")))
                break
            else:
                failed[4 * i + q] = max(failed[4 * i + q], bound - g)
                stack.pop()
                if letters:
                    letters.pop()
        bound = above


def fault(text: str, again: bool) -> int:
    """The first of a row's faults."""
    rest = text.rstrip(SPACES)
    if not rest:
        return BLANK
    return COPY if again else FINE if rest[-1] in ".!?" else CUT


class _Faults:
    """Takes a conversation's rows in their order."""

    def __init__(self):
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        self.faults.append(fault(text, mark in self.seen))
        self.seen.add(mark)
        self.illegal += bool(self.initials) and self.initials[-1] + role[:1] not in LEGAL
        self.initials.append(role[:1])

    def result(self) -> tuple:
        cost, audit = cheapest("".join(c or " " for c in self.initials), self.faults)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return gaps, self.faults.count(BLANK), self.faults.count(COPY), self.faults.count(CUT), self.illegal, cost, audit


class _Repaired:
    """Takes the edits, then a conversation's rows in their order, and makes the digest of what the edits give."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, START, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * bool(self.lines) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def given(self, text: str) -> None:
        self.state = GIVES[self.state]
        self.line(NAMES[self.state], text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.given("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = LEADS[self.state][role[:1]]
            self.line(role, text)
        elif edit == "R":
            self.given(text)

    def result(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _batches(schema: pa.Schema, done: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for r in done:
        rows.append(r)
        if len(rows) >= BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _ordered(rows: DataFrame, conv: str) -> DataFrame:
    """Heads of conversations, then their rows in their order, whole conversations in a task."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, conv).sortWithinPartitions(conv, "__head", F.col("__turn").asc_nulls_first(), "__role", "__text")


def repair(rows: DataFrame, every: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation named in `every`: its id; gaps in its turns; how many of its rows are blank, duplicates or
    truncated, each by the first of these faults; illegal pairs of neighbouring roles; the least cost of a repair, the
    edits' letters (audit) and the digest of what they give (repaired_sha256, of role:text lines).

    Rows are taken by turn, nulls first, then by role and text. A null role or text counts as one space, a null
    conversation is one of its own. One without rows has zeros, no edits and the digest of nothing. Repeated ids in `every`
    count once; rows of no conversation in it are left out; other columns are not looked at.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    plain = rows.select(F.col(f"`{conv}`").alias("__conv"), F.lit(1).alias("__head"), F.col(f"`{turn}`").cast("long").alias("__turn"), space(role).alias("__role"), space(text).alias("__text"))
    heads = every.select(F.col(f"`{conv}`").alias("__conv")).distinct().withColumn("__head", F.lit(0))
    kind = plain.schema["__conv"].dataType.simpleString()

    @tidied
    def found(batches):
        def done(rows):
            now = here = None
            for key, head, at, who, said in rows:
                if head == 0:
                    if now is not None:
                        yield here, *now.result()
                    now, here = _Faults(), key
                elif now is not None and (key == here or key is None and here is None):
                    now.add(at, who, said)
            if now is not None:
                yield here, *now.result()

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("__conv", first.schema.field(0).type), *[(c, pa.int64()) for c in FACTS], ("audit", pa.string())])
        yield from _batches(schema, done(_rows(_again(first, batches))))

    facts = ", ".join(f"{c} bigint" for c in FACTS)
    one = _ordered(plain.unionByName(heads, allowMissingColumns=True), "__conv").mapInArrow(found, f"__conv {kind}, {facts}, audit string")
    one = scratch_table(one, "repairs")

    @tidied
    def hashed(batches):
        def done(rows):
            now = here = None
            for key, head, _, who, said, *known in rows:
                if head == 0:
                    if now is not None:
                        yield *here, now.result()
                    now, here = _Repaired(known[-1]), (key, *known)
                elif now is not None and (key == here[0] or key is None and here[0] is None):
                    now.add(who, said)
            if now is not None:
                yield *here, now.result()

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("__conv", first.schema.field(0).type), *[(c, pa.int64()) for c in FACTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from _batches(schema, done(_rows(_again(first, batches))))

    both = plain.unionByName(one.withColumn("__head", F.lit(0)), allowMissingColumns=True)
    return _ordered(both, "__conv").mapInArrow(hashed, f"__conv {kind}, {facts}, audit string, repaired_sha256 string").withColumnRenamed("__conv", conv)


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by the digest of conv_id:turn: of twenty cases, one drops the row, one
    empties its text, one takes the ends of its sentences, one repeats it, and one says that a user spoke. Nulls of the
    role, of the text and in the digest are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(case == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), case.alias("case")).where("case <> 0")
    return rows.withColumn("again", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("case", "again")
