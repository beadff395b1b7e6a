"""License scans, conversation repair and hard negatives against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import licenses, negatives, queries, repair

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- licenses


def matches_of(text, templates, threshold, step):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    step, out = max(step, *(len(t.words) for t in templates)), []
    for at in range(0, len(words), step):
        block = words[at : at + 2 * step]
        for t in templates:
            own = set(t.words)
            part = len(own & set(block)) / len(own)
            places = [at + p for p in range(step) if block[p : p + len(t.words)] == t.words] if t.phrase else []
            if places or not t.phrase and part >= threshold - 1e-9:
                out.append((t.name, t.label, at, places, part))
    return len(words), sorted(out)


def some_text(rng, n):
    parts = [t.text for t in licenses.TEMPLATES] + ["the of and", "MIT", "License, Version", "gnu", "software is", "é cc", "by-", "nc\n4.0"]
    words = " ".join(rng.choice(parts) if rng.random() < 0.25 else rng.choice(["lorem", "the", "and", "Ipsum", "é"]) for _ in range(n)).split(" ")
    return " ".join(w for w in words if rng.random() > 0.07)


def test_license_scan(spark):
    rng = random.Random(1)
    texts = [None, "", " .,; ", "cc by", "CC\nBY cc-by", "GNU general\npublic (License) version 3", "ÄCC by", "mit licenses", some_text(rng, 20_000)] + [some_text(rng, rng.randint(1, 400)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "cc by"), (None, "apache license"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("matches", "n_words", "label", "a.b", "t_word", "both", "places", "row")})
    found = licenses.scan(docs, keep=("doc_id", "label", "a.b"))
    assert found.columns == ["doc_id", "label", "a.b", "n_words", "matches"]
    got = Counter((r.doc_id, r.n_words, str([tuple(m) for m in r.matches])) for r in found.collect())
    want = Counter((i, n, str(m)) for i, t in rows for n, m in [matches_of(t, licenses.TEMPLATES, licenses.THRESHOLD, licenses.STEP)])
    assert got == want
    assert sum(m.count("text") + m.count("notice") for _, _, m in want) > 20
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, templates=()).where("size(matches) > 0").count() == 0


def test_license_scan_takes_any_templates(spark):
    rng = random.Random(2)
    alphabet = [f"w{i}" for i in range(30)]
    own = tuple(licenses.Template(f"t{i}", f"l{i % 4}", " ".join(rng.choices(alphabet, k=rng.randint(1, 50))), i % 3 == 0) for i in range(12)) + (licenses.Template("none", "none", "- -"),)
    rows = [(i, " ".join(rng.choices(alphabet, [1 / (k + 1) for k in range(30)], k=rng.randint(0, 200)))) for i in range(60)]
    got = {r.doc_id: str([tuple(m) for m in r.matches]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), own, threshold=0.6, step=8).collect()}
    assert got == {i: str(matches_of(t, own[:-1], 0.6, 8)[1]) for i, t in rows}


def test_license_query_on_one_text(spark, tmp_path):
    text = "Released under the MIT\nLicense. " + "x " * 40 + "Licensed under CC BY-NC 4.0, mit-license"
    spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, none = sorted(queries.op11_license_scan(spark, str(tmp_path)).collect())
    assert tuple(one) == (7, 54, 3, 3, 52, "cc-by,mit", "cc-by,cc-by-nc,mit", 1.0)
    assert tuple(none) == (8, 0, 0, None, None, "", "", 0.0)


# ---- conversations


def cheapest_plainly(initials, faults):
    """Dijkstra over (cost, letters)."""
    heap, done = [(0, "", 0, repair.START)], set()
    while heap:
        cost, letters, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(initials) and q in (repair.START, repair.A):
            # Of equal costs the least letters come first, as no path of the same cost goes on from another.
            return cost, letters
        give = (repair.U, repair.U, repair.A, repair.U)[q]
        heapq.heappush(heap, (cost + 3, letters + "I", i, give))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, q))
            if faults[i] < repair.BLANK:
                more = 3 * (faults[i] == repair.CUT)
                heapq.heappush(heap, (cost + more + 3, letters + "R", i + 1, give))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initials[i]))
                if to:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, to))


def test_cheapest_edits():
    for n in range(5):
        for initials in itertools.product("sua ", repeat=n):
            for faults in itertools.product(range(3), repeat=n):
                assert repair.cheapest("".join(initials), list(faults)) == cheapest_plainly(initials, faults)
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 60)
        initials = "".join(rng.choice("uuaa" if rng.random() < 0.9 else "s x") for _ in range(n))
        faults = [rng.choices(range(4), (8, 2, 1, 1))[0] for _ in range(n)]
        assert repair.cheapest(initials, faults) == cheapest_plainly(initials, faults)


def test_cheapest_edits_of_long_conversations():
    rng = random.Random(5)
    for n, worst in ((20_000, False), (3_000, True)):
        initials = "".join("ua"[i % 2] if rng.random() < 0.85 and not worst else rng.choice("sua") for i in range(n))
        faults = [rng.choices(range(4), (8, 2, 1, 1))[0] for _ in range(n)]
        cost, letters = repair.cheapest(initials, faults)
        assert cost >= repair.bounds(initials, faults)[0][0] and len(letters) - letters.count("I") == n


def repaired(rows, ids):
    by = defaultdict(list)
    space = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        case = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = "user" if case == 4 else space(role), "" if case == 1 else re.sub("[.!?]", "", space(text)) if case == 2 else space(text)
        by[c] += [(t, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    for c in ids:
        own = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            said = text.rstrip(" \t\n\v\f\r")
            faults.append(repair.BLANK if not said else repair.COPY if (role, text) in seen else repair.FINE if said[-1] in ".!?" else repair.CUT)
            seen.add((role, text))
        initials = [role[:1] or " " for _, role, _ in own]
        cost, audit = cheapest_plainly(initials, faults)
        lines, left, last = [], list(own), ""
        for e in audit:
            row = left.pop(0) if e != "I" else None
            if e != "D":
                role = row[1] if e == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{row[2] if row else ''}")
        turns = {t for t, _, _ in own if t is not None}
        yield c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(repair.BLANK), faults.count(repair.COPY), faults.count(repair.CUT), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for c in [*range(60), None, -5]:
        for t in range(rng.randint(1, 40 if c else 300)):
            role = rng.choice(["system", "user", "assistant", "tool", "", None]) if rng.random() < 0.1 else "user" if t % 2 == 0 else "assistant"
            text = rng.choice([None, "", " \t", "Yes.", "é, so", "What?\n", "x" * 50_000 + "!"]) if rng.random() < 0.3 else f"Line {t}."
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, text))
    rows += rows[:20] + [(1000 + i, 0, "user", "gone") for i in range(60)] + [(2000, -(2**63), "user", "a"), (2000, 2**63 - 1, "user", "a.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("case", "again", "audit", "cost", "a.b", "__conv")})
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter(tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect())
    want = Counter((a, min(gaps, 2**63 - 1), *rest) for a, gaps, *rest in repaired(rows, {r[0] for r in rows}))
    assert got == want
    assert any(r[7] == "" for r in want) and len({r[6] for r in want}) > 10
    assert repair.repair(given.limit(0), given.limit(0)).count() == 0


# ---- hard negatives


def mined(rows, positives=5, count=3):
    best = {}
    for v, label, x in rows:
        if None not in (v, label, x) and all(c is not None and math.isfinite(c) for c in x):
            new = (str((label + 1) % 10 if v % 7 == 0 else label), [math.floor(256 * float(np.float32(c))) for c in x])
            best[v] = min(best.get(v, new), new)
    for a, (label, x) in best.items():
        if a % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), v, own == label) for v, (own, y) in best.items() if v != a)
            for p, positive, _ in [s for s in scored if s[2]][:positives]:
                near = [(v, -s) for s, v, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p]
                yield from ((a, positive, k, v, -p, s) for k, (v, s) in enumerate(near[:count], 1))


@pytest.mark.parametrize("blocks", [(negatives.ROWS, negatives.ANCHORS), (40, 3)])
def test_hard_negatives(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rng = np.random.default_rng(7)
    rows = []
    for i in range(-200, 500):
        x = rng.choice([-0.1, 0.2, 0.5, 1.0], 6) if i % 3 else rng.normal(size=6)
        rows.append((i, int(rng.integers(0, 4)), [float(c) for c in x]))
    rows += [(50, None, [1.0]), (600, 1, None), (650, 1, [None, 1.0]), (700, 2, [float("nan")]), (750, 2, [float("inf")]), (None, 1, [1.0]), (800, 1, []), (850, 9, [1.0, 2.0]), (900, 3, [2.0] * 6), (1, 3, [0.1] * 6), rows[0], rows[5], (1000, 1, [0.0] * 6), (1001, 1, [0.0] * 6), (1003, 2, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("anchor", "score", "key", "q", "r", "v", "a.b")})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect())
    want = Counter(mined(rows))
    assert got == want and len(want) > 50 and any(r[4] == 0 for r in want)
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(8)
    for most in (10, 2**27, 2**30, 2**40):
        a, b = rng.integers(-most, most, (5, 7)), rng.integers(-most, most, (4, 7))
        want = [[max(-negatives.LIMIT, min(negatives.LIMIT, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert negatives.products(a, b).tolist() == want


def test_keys_sort_as_they_should(spark):
    rng = random.Random(9)
    rows = [(rng.choice([-(2**63), -1, 0, 1, 2**63 - 1]), rng.choice([-(2**62), -3, 0, 3, 2**62]), rng.choice([0, 1]), rng.choice([-(2**63), -1, 0, 2**63 - 1])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, s long, kind int, k long").withColumn("key", F.when(F.col("kind") == 0, negatives._pack(F.col("a"), F.col("s"), 0, F.col("k"))).otherwise(negatives._pack(F.col("a"), F.col("s"), 1, F.col("k"))))
    found = [(negatives.unpack(r.key), (r.a, r.s, r.kind, r.k)) for r in df.orderBy("key").collect()]
    assert all(x == y for x, y in found)
    assert [y for _, y in found] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
