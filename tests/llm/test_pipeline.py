"""The pipeline's stages against brute force, each on its own input; queries with SQL against DuckDB."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import toxicity_scores
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from brightloom.llm import bpe, queries, simhash

SF = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rows_of(df):
    return df.toPandas().to_dict("records")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert frames[-1].columns == columns
    raw, clean, exact, near, mixed, encoded = map(rows_of, frames)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").collect()]
    text = {r["doc_id"]: r["text"] for r in raw}
    taught = [(text[i], toxic[i]) for i in order if i in toxic and zlib.crc32(str(i).encode()) % 5]
    scores = dict(zip(order, toxicity_scores(taught, [text[i] for i in order]), strict=True))
    stay = Counter(r["doc_id"] for r in clean)
    assert all((s < 0.5) == bool(stay[i]) for i, s in scores.items() if abs(s - 0.5) > 1e-4)

    best = defaultdict(int)
    for r in clean:
        t = r["text"].translate(str.maketrans(UPPER, LOWER))
        best[t] = max(best[t], r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())

    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in exact}
    root = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[b] > root[a] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[b], changed = root[a], True
    assert sorted(r["doc_id"] for r in near) == sorted(set(root.values()))

    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in near} and max(times.values()) <= 2
    words = sum(len(r["text"].encode().split()) for r in near)
    largest = max(len(r["text"].encode().split()) for r in near)
    taken = sum(len(r["text"].encode().split()) for r in mixed)
    assert abs(taken - 1.5 * words) <= 20 * largest / 2

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in near}
    assert Counter(r["doc_id"] for r in encoded) == times
    for r in encoded:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


    # run() is those stages in turn.
    digest = lambda rows: Counter((r["doc_id"], r["source"], r["lang"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    assert digest(rows_of(entry.queries()["pipeline"](spark, SF))) == digest(encoded)


def test_stages_on_awkward_rows(spark):
    long = " ".join(f"word{i % 977}." for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, long, None, "s", 1), (None, "Abc def ghi", "en", None, 3), (4, "Abc def ghi", "en", "t", 3), (5, "abc DEF ghi", "en", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in ("score", "size", "fp", "row", "kept", "__fp", "__recipe", "copies")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "bpe" or out.columns == docs.columns
        got = out.collect()
        ids = Counter(r.doc_id for r in got)
        if name == "toxicity":
            assert len(got) == len(rows)
        elif name == "exact_dedup":
            assert ids == Counter([2, 3, 5])  # null texts are empty ones; of the rest the largest id stays
        elif name == "simhash_dedup":
            assert set(ids) == {1, 3, None, 4, 5} - ({5} if ids[5] == 0 else {4}) and ids[1] == 1
        elif name == "bpe":
            assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id == 2} == {0}
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    got = Counter(tuple(cell(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_all_ten_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
