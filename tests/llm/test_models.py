"""BPE, toxicity, language identification, LM scoring and embeddings: against libraries, brute force and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import buckets_of, toxicity_scores

from brightloom.llm import bpe, common, embedding, langid, lm, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977}." for i in range(30_000))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def strange_texts():
    rng = random.Random(1)
    bits = ["'", "'s", "'re", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "²", "!", "...", "<|endoftext|>", "<|endof", "中", " ", "😀", "'ll", "'t", "e", "\x1c", "​", "ing", "the"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, "x" * 3000, "ab" * 2000, " " * 500, LONG]


@pytest.mark.parametrize("most", [0, 500])
def test_bpe_like_the_library(spark, tokenizer, most):
    texts = strange_texts()
    df = docs(spark, texts).withColumn("ids", F.lit("clash"))
    codec = bpe.Codec.fit(df, most=most)
    out = {r.doc_id: r for r in codec.decode(codec.encode(df, decoded=True), out="again").collect()}
    assert len(out) == len(texts)
    for i, (t, e) in enumerate(zip(texts, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)):
        assert np.frombuffer(out[i].ids, "<u4").tolist() == e.ids and out[i].n_tokens == len(e.ids)
        assert out[i].decoded == out[i].again == tokenizer.decode(e.ids, skip_special_tokens=False)
    assert bpe.Codec.fit(df.limit(0)).encode(df.limit(0)).count() == 0


def test_lexicon_holds_its_words_only():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    lexicon = bpe.compile_lexicon(words)
    others = [w + b"x" for w in words[:100]] + [w[:-1] for w in words if w[:-1] and w[:-1] not in set(words)]
    found = bpe.look_up(lexicon, np.frombuffer(b"".join(words + others), np.uint8), np.cumsum([0, *map(len, words + others)])[:-1], np.array([*map(len, words + others)]))
    assert found[: len(words)].tolist() == list(range(len(words))) and (found[len(words) :] == -1).all()
    # Shared suffixes: far fewer states than a tree of prefixes has.
    assert len(lexicon["lex_base"]) < len({w[:k] for w in words for k in range(len(w) + 1)})
    assert (bpe.look_up(bpe.compile_lexicon([]), np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])) == -1).all()


def toxic_docs(n=600):
    rng = random.Random(4)
    words = ["river", "stone", "window", "garden", "morning", "paper", "winter", "bridge", "letter", "market", "silver", "forest"]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Idiot", "moron!", "idiots"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_docs()
    df = docs(spark, [t for _, t, _ in rows]).unionByName(spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, LONG, "en", "s", 0), (None, "no id", None, None, None), (9003, "Guten Tag", None, None, None)], SCHEMA)).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (9000, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.ToxicityModel.fit(df, labels)
    got = {r.doc_id: r.s for r in model.score(df.drop("score"), keep=("doc_id",), out="s").collect()}
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]
    held = [(got[i] >= 0.5, bool(y)) for i, _, y in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = toxicity.clean(df, labels)
    assert kept.columns == df.columns and {9000, 9001, 9002, 9003, None} <= {r.doc_id for r in kept.collect()}
    for none in (labels.limit(0), labels.where("toxic = 0")):
        unknown = toxicity.ToxicityModel.fit(df, none)
        assert unknown.score(df.drop("score")).where("score >= 0.5").count() == 0
    assert model.score(df.drop("score").limit(0)).count() == 0


def test_scores_like_brute_force():
    rng = np.random.default_rng(0)
    ratio, weights = rng.standard_normal(toxicity.BUCKETS), rng.standard_normal(toxicity.BUCKETS)
    model = toxicity.ToxicityModel(ratio, weights, 0.1)
    texts = ["", "a", "aBc ABC", "déjà vu, encore 😀ß", "", " ".join(f"Wört{i % 97}." for i in range(2000))]
    raw = [t.encode() for t in texts]
    got = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, s in zip(texts, got, strict=True):
        at = buckets_of(t)
        assert sorted(toxicity.features(t.encode()).tolist()) == at.tolist()
        assert s == pytest.approx(1 / (1 + math.exp(-(ratio[at] @ weights[at] / np.sqrt(ratio[at] @ ratio[at] + toxicity.SHORT) + 0.1))), abs=1e-5)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"größe{i % 977} 😀." for i in range(5000)).encode()
    whole = np.sort(toxicity.features(text))
    for piece in (64, 1000, 4097):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.sort(toxicity.features(text)).tolist() == whole.tolist()


def test_toxicity_trains_like_brute_force(spark):
    rows = [(i, t, y) for i, t, y in toxic_docs(120)]
    df, labels = docs(spark, [t for _, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    # An id with another text as well, and labels that say both: it teaches once, as toxic.
    df, labels = df.union(df.where("doc_id = 5")), labels.union(spark.createDataFrame([(5, 1)], labels.schema))
    model = toxicity.ToxicityModel.fit(df, labels)
    order = [r.doc_id for r in df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").collect()]
    truth = {i: (t, max(y, int(i == 5))) for i, t, y in rows}
    want = dict(zip(order, toxicity_scores([truth[i] for i in order], [truth[i][0] for i in order]), strict=True))
    got = {r.doc_id: r.score for r in model.score(df, keep=("doc_id",)).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_toxicity_query(spark):
    got = queries.op1_toxicity(spark, SF).toPandas()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.held_out.tolist() == held and got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language_id(spark, SF).join(truth, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == truth.count() and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "xx"), (2, "", "xx"), (3, "123 !?", "xx"), (4, "the " * 100, None), (5, "the and of " * 40, "en"), (6, "der und die " * 40, "de"), (6, "der und die " * 40, "de"), (None, LONG, "en")], "doc_id long, text string, lang string")
    model = langid.LanguageModel.fit(df)
    got = [(r.doc_id, r.lang_pred) for r in model.predict(df.withColumn("score", F.lit(1))).collect()]
    assert len(got) == 8 and {(1, "und"), (2, "und"), (3, "und"), (5, "en"), (6, "de")} <= set(got)
    nothing = langid.LanguageModel.fit(df.limit(0))
    assert {r.lang_pred for r in nothing.predict(df).collect()} == {"und"} and model.predict(df.limit(0)).count() == 0


def test_languages_of_short_or_long_texts_only(spark):
    short = [f"wie geht es dir {w}" for w in ("heute", "morgen", "gestern", "jetzt")]
    long = "0123 " * 2000 + "comment vas tu aujourd hui mon ami " * 400
    rows = [*[(i, t, "de") for i, t in enumerate(short)], *[(10 + i, long, "fr") for i in range(3)], (20, "how are you today my friend " * 20, "en"), (30, "ja", "xx"), (40, "12 34", "yy")]
    model = langid.LanguageModel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {"de", "fr", "en", "xx"}
    got = model.predict(spark.createDataFrame([(0, "wie geht es dir heute"), (1, "comment vas tu aujourd hui"), (2, "how are you today")], "doc_id long, text string"))
    assert {(r.doc_id, r.lang_pred) for r in got.collect()} == {(0, "de"), (1, "fr"), (2, "en")}


def test_lm_scores(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, LONG, "en", "s", 0), (-3, LONG, "en", "s", 0), (None, "Of THE", None, None, None)], SCHEMA)).withColumn("score", F.lit("clash"))
    got = lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).toPandas()
    rows = [(None if r.doc_id is None else r.doc_id, (r.text or "").encode().lower().split()) for r in df.select("doc_id", "text").collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, w in rows:
        if not held(i):
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = Counter((i if i is not None else "none", held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 4)) for i, w in rows)
    assert Counter((int(r.doc_id) if r.doc_id == r.doc_id else "none", not r.train, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got.itertuples()) == want
    assert (got.train_tokens == n).all() and (got.score < 0).all()
    out = got[~got.train]
    assert out.score.sum() > out.base_score.sum()
    assert lm.score(df.limit(0), F.lit(True)).count() == 0
    assert lm.score(df.limit(5), F.lit(False)).where("train_tokens = 0").count() == 5


SHARED = np.array([[3.0], [1.0]]) * (np.arange(lm.SIZE) % 5)


def test_maxent_is_a_distribution():
    rng = np.random.default_rng(2)
    model = lm.Maxent([(lm.END, 50), *((f"w{i}".encode(), 40 - i % 30) for i in range(lm.SIZE - 1))], SHARED)
    model.rows[:] = rng.standard_normal(model.rows.shape)
    model.weights[:] = rng.standard_normal(model.weights.shape)
    start = np.array([7, 900, lm.SIZE + 3])
    assert lm.ENTRIES == 2 * lm.SIZE
    total = sum(10 ** model.log10s(np.append(start, x), np.array([0]))[-1] for x in range(lm.ENTRIES))
    assert total == pytest.approx(1, abs=1e-5)
    # The gradient step raises the probability of what it has seen.
    sequence = rng.integers(0, lm.SIZE + 50, 500)
    seen = lm.fresh()
    before = model.log10s(sequence, np.array([0])).sum()
    for _ in range(5):
        model.update(sequence, np.array([0]), seen)
    assert model.log10s(sequence, np.array([0])).sum() > before


@pytest.mark.parametrize("few", [common.FEW, 3])
def test_most_frequent_fills_up(spark, few):
    rng = random.Random(7)
    for counts in ([100] * 900, [rng.randint(1, 1 << rng.randint(1, 40)) for _ in range(900)]):
        df = spark.createDataFrame([(f"w{i}".encode(), n) for i, n in enumerate(counts)], "word binary, n long").coalesce(2)
        for most in (0, 333, 2000):
            got = common.most_frequent(df, "n", most, few).collect()
            assert sorted((r.n for r in got), reverse=True) == sorted(counts, reverse=True)[:most]
            assert len({bytes(r.word) for r in got}) == len(got)
    assert common.most_frequent(df.limit(0), "n", 5, few).count() == 0


def test_words_see_both_words_before():
    rng = np.random.default_rng(5)
    model = lm.Maxent([(lm.END, 50), *((f"w{i}".encode(), 40) for i in range(lm.SIZE - 1))], SHARED)
    model.weights[:] = rng.standard_normal(model.weights.shape)
    # The same class and the same word before: what differs is the one before that.
    last = [model.log10s(np.array([w, 900, 7]), np.array([0]))[-1] for w in (5, 6, lm.SIZE + 1)]
    assert len({round(x, 6) for x in last}) == 3
    # Words that only the word two places before, or only both together, tell apart are learned.
    for right in (lambda a, b: 10 + a % 2, lambda a, b: 10 + (a + b) % 2):
        model = lm.Maxent([(lm.END, 50), *((f"w{i}".encode(), 40) for i in range(lm.SIZE - 1))], SHARED)
        texts = [np.array([a, b, right(a, b)]) for a, b in rng.integers(100, 108, (2000, 2))]
        sequence, starts = lm._batches(texts)
        seen = lm.fresh()
        for _ in range(30):
            model.update(sequence, starts, seen)
        assert model.log10s(sequence, starts)[2::3].mean() > math.log10(0.7)


def brute_links(rows, cosine):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and r[0] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        base = rng.standard_normal(32)
        for k in range(rng.integers(1, 8)):
            rows.append((len(rows), (base + rng.standard_normal(32) * rng.choice([0, 0.1, 0.25])).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(5)]
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [1.0, None] * 16, 1), (1003, [float("nan")] * 32, 1), (1004, rows[0][1], None), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit("clash"))
    got = {r.vec_id: r for r in embedding.near_groups(df, leaf=24, block=block).collect()}
    links = brute_links(rows, 0.93)
    degree = Counter(i for p in links for i in p)
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and all(got[r[0]].n_links <= degree[i] for i, r in enumerate(rows)) and found >= 0.95 * sum(degree.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1005)) and got[1006].component_id == 1005
    if found == sum(degree.values()):
        root = list(range(len(rows)))
        for _ in range(len(rows)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert all(got[r[0]].component_id == rows[root[i]][0] and got[r[0]].kept == (root[i] == i) for i, r in enumerate(rows))
    assert embedding.near_groups(df.limit(0)).count() == 0


def test_embeddings_of_any_size_and_repeated_ids(spark):
    big, w = [1e200, 1e200, 0.0], [0.0, 0.0, 1e-200]
    rows = [(1, big, 0), (2, [1e200, 1.01e200, 0.0], 0), (1, w, 0), (3, w, 0), (4, w, 0), (5, big, 1), (None, big, 0)]
    got = Counter(tuple(r) for r in embedding.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    # An id with two vectors comes twice, each time with what that vector is linked to.
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (None, 0, None, True)])


def test_lm_score_against_a_plain_softmax(spark, monkeypatch):
    texts = [None, "", " \t\n", "  The end\x0bof\x0cTHE  road ", "a\x1cb \x85 é ü Ünder a", "\n", "x" * 40]
    texts += [" ".join(f"w{i * k % 1500}" for i in range(200)) for k in range(1, 40)]
    texts.append(" ".join(f"w{i * i % 1700}" for i in range(2 * lm.TOKENS + 5)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(train(*a)) or kept[0])
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 7 != 2).collect()}
    model, cut = kept[0], [(t or "").encode().lower().split() for t in texts]
    c = Counter(w for i, ws in enumerate(cut) if i % 7 != 2 for w in ws)
    assert sorted(got) == list(range(len(texts))) and model.rows.any() and model.weights.any()
    shared = np.ones(lm.SIZE)  # what the words that share an entry weigh: their tokens, one for each of them, and one
    for w, n in c.items():
        if w not in model.number:
            shared[lm.shared_entry(w) - lm.SIZE] += n + 1
    for i, words in enumerate(cut):
        sequence = np.array([*(model.number.get(w, lm.shared_entry(w)) for w in words), model.number[lm.END]])
        features, cls, want = model.features(sequence, np.array([0])), sequence // lm.PER, 0.0
        for scores, chosen in ((model.rows[list(features)].astype(float).sum(0) + model.class_bias, cls), (model.weights[model.places(features, cls)].astype(float).sum(0) + model.word_bias[cls], sequence % lm.PER)):
            scores = scores - scores.max(1, keepdims=True)
            want += (scores[np.arange(len(chosen)), chosen] - np.log(np.exp(scores).sum(1))).sum() / math.log(10)
        want += sum(math.log10((c[w] + 1) / shared[lm.shared_entry(w) - lm.SIZE]) for w in words if w not in model.number)
        assert got[i].n_tokens == len(sequence) and got[i].score == pytest.approx(want, abs=1e-4 * len(sequence))
