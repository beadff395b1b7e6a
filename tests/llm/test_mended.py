"""Names that clash or hold dots, long recipes of hot groups, and samples that don't look at lengths."""

import random

from pyspark.sql import functions as F

from brightloom.llm import common, exact, langid, mixing, sharding, simhash, toxicity


def test_any_column_names(spark, tmp_path):
    rows = [(i, f"text number {i % 7} " * 20, "en", "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("a.b", "__toxic", "toxic", "__mark", "recipe", "c`d")})
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for kept in (toxicity.clean(docs, labels), exact.dedupe(docs), simhash.dedupe(docs), mixing.mixture(docs)):
        assert kept.columns == docs.columns and kept.count() >= 0
    sharding.write_shards(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert set(docs.columns) <= set(back.columns) and back.count() == 40


def test_long_recipes_of_a_hot_group(spark, monkeypatch):
    """A long text that most rows repeat is joined by a digest, where its rows are."""
    long = " ".join(f"Sentence number {i} is short." for i in range(15_000))
    rows = [(i, long) for i in range(60)] + [(100 + i, f"other {i}") for i in range(40)]
    seen, was = [], common.scratch_table
    monkeypatch.setattr(common, "scratch_table", lambda df, name: seen.append((name, out := was(df, name))) or out)
    monkeypatch.setattr(common, "HOT", 16)
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 59, 60) for i in range(60)} | {(100 + i, 100 + i, 1) for i in range(40)}
    assert [out.count() for name, out in seen if name == "hot-groups"] == [1]


def test_wide_rows_about_hot_keys_are_not_sent(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    groups = spark.createDataFrame([(0, 100, "x" * 10_000), (1, 100, "y"), (2, 100, "z")], "k long, n long, what string")
    got = common.with_group(rows, groups, "k", "n").collect()
    assert len(got) == 300 and all(r.what[0] == "xyz"[r.k] for r in got)


def test_short_texts_teach_beside_others(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, " ".join(word("äöüß") for _ in range(8)), "de") for i in range(200)] + [(1000 + i, " ".join(word("abcdef") for _ in range(100)), "de") for i in range(200)] + [(2000 + i, " ".join(word("uvwxyz") for _ in range(100)), "en") for i in range(200)]
    model = langid.LanguageModel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    body = dict(model.packed.value)["de"].decode(errors="ignore")
    assert sum(c in "äöüß" for c in body) > 1000 < sum(c in "abcdef" for c in body)


def test_thirteen_queries():
    from brightloom.llm import queries

    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)
