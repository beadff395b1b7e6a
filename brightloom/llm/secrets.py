"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its content. The ledger holds, for each blob and rule version, the findings of
the scan; a scan takes up only pairs that the ledger doesn't hold, and findings are joined back to every path that has
the blob, in any version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm.common import scratch_table, text_or_empty, with_group


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of the pattern are leftmost and don't overlap; those whose group has fewer characters
    than least are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order that settles ties of the start.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run of at least as many digits; shorter runs, of which prose is full, are not made first to be dropped then.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Beside the base: the head line of a private key.
RULES = (*BASE, Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1))

FINDINGS = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"
#: In the ledger a finding has its rule's key.
FOUND = "array<struct<start:bigint,end:bigint,rule:string>>"
LEDGER = f"blob binary, rules array<string>, findings {FOUND}"


def _hits(rule: Rule, no: int, text: Column) -> Column:
    """For each match: the characters since the match before it, its own, and its group's. The text is split only where
    the rule matches at all."""
    hits, gaps = (f(text, F.lit(rule.pattern)) for f in (lambda t, p: F.regexp_extract_all(t, p, F.lit(0)), lambda t, p: F.split(t, rule.pattern, -1)))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    size = lambda c: F.transform(c, F.char_length)
    zipped = F.zip_with(F.zip_with(size(hits), size(groups), lambda h, g: F.struct(h.alias("h"), g.alias("g"))), size(gaps), lambda m, gap: F.struct(F.lit(no).alias("kind_no"), m.h.alias("h"), m.g.alias("g"), gap.alias("gap")))
    # One gap more than matches: the end of the text, whose other fields are null.
    none = F.array().cast("array<struct<kind_no:int,h:int,g:int,gap:int>>")
    return F.when(F.rlike(text, F.lit(rule.pattern)), F.slice(zipped, 1, F.size(gaps) - 1)).otherwise(none)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text, pending) -> (blob, findings): findings of the pending rules in each text that has any."""
    found = [F.transform(_hits(r, no, F.col("text")), lambda m, i: F.struct(m.kind_no.alias("kind_no"), i.alias("i"), m.h.alias("h"), m.g.alias("g"), m.gap.alias("gap"))) for no, r in enumerate(rules)]
    empty = F.array().cast("array<struct<kind_no:int,i:int,h:int,g:int,gap:int>>")
    found = [F.when(F.array_contains("pending", r.key), f).otherwise(empty) for r, f in zip(rules, found, strict=True)]
    # An outer inline: else Spark first scans each text to see whether it has matches.
    rows = blobs.select("blob", F.inline_outer(F.concat(*found))).where("kind_no is not null")
    upto = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("h")).cast("long")).over(upto))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no") + 1)
    key = F.element_at(F.array(*[F.lit(r.key) for r in rules]), F.col("kind_no") + 1)
    rows = rows.where(F.col("g") >= least)
    span = F.struct((F.col("end") - F.col("h")).alias("start"), F.col("end"), key.alias("rule"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """What a scan adds to the ledger: (blob, rules, findings) for every blob of versions (blob, text) that has rule
    versions it wasn't scanned with. Blobs without findings are in it as well, so that they aren't scanned again."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = versions.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("pending")).where(F.size("pending") > 0)
    # Equal texts are combined before they are dealt out, by blob alone, so that they meet the pending rules where they are.
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    # Distinct blobs are written once with what was found; the texts themselves stay behind.
    return todo.withColumnRenamed("pending", "rules").join(scan(blobs, rules), "blob", "left").select("blob", "rules", F.coalesce("findings", F.array().cast(FOUND)).alias("findings"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return scratch_table(spark.createDataFrame([], LEDGER), "ledger")


def content_addressed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds blob, the digest of the text; null counts as empty."""
    return docs.withColumn("blob", F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row for each row of docs: id_col, blob, findings (by start, then kind).

    Null texts are empty and have no findings; equal texts, repeated rows among them, are scanned once; other columns
    don't matter. Only pairs of blob and rule version that the ledger doesn't hold are scanned, all of them without a
    ledger; what it then holds for exactly these rule versions is joined in.
    """
    rows = content_addressed(docs.select(F.col(id_col), text_or_empty(text).alias("text")))
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ledger
    ledger = ledger.unionByName(scratch_table(update_ledger(rows, ledger, rules), "ledger"))
    # Findings of other rules and of other versions stay in the ledger. Numbers of kinds are those of the rules given.
    no = F.array_position(F.array(*[F.lit(r.key) for r in rules]), F.col("f.rule")).cast("int")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), no)
    found = ledger.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]))
    span = F.struct(F.col("f.start").alias("start"), (no - 1).alias("kind_no"), kind.alias("kind"), F.col("f.end").alias("end"))
    found = found.select("blob", span.alias("f")).groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings"))
    paths = scratch_table(rows.select(id_col, "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("paths")).join(found, "blob", "left")
    return with_group(paths, blobs, "blob", "paths").select(id_col, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def spans(findings: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end of each finding, comma-joined."""
    chosen = F.col(findings) if kinds is None else F.filter(findings, lambda f: f.kind.isin(kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")


def count_kind(findings: str, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f.kind == kind)).cast("long")


