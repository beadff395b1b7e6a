"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import bpe, embedding, exact, langid, licenses, lm, mixing, negatives, repair, secrets, sharding, simhash, toxicity
from brightloom.llm.common import crc_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0
    model = toxicity.ToxicityModel.fit(docs.where(~held_out), labels.where(~held_out))
    return model.score(docs, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    counts = [secrets.count_kind("findings", k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secrets.spans("findings", kinds).cast("binary"), 256).alias("base_sha256"), secrets.spans("findings").alias("spans"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encoded = bpe.Codec.fit(docs).encode(docs, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_groups(table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) == 1
    model = langid.LanguageModel.fit(docs.where(~held_out))
    return model.predict(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    found = found.withColumn("places", licenses.places("matches", licenses.BASE))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"), licenses.labels("matches", licenses.BASE).alias("base_labels"), licenses.labels("matches").alias("labels"), licenses.best("matches").alias("score"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(conversations), conversations)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(no, kind, pattern, g, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
  (2, 'hex', '[0-9a-f]{16,}', 0, 16),
  (3, 'pem', '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----', 0, 1)),
hits AS (
  SELECT doc_id, 0 AS no, regexp_extract_all(t, (SELECT pattern FROM rules WHERE no = 0), 0) AS h, regexp_extract_all(t, (SELECT pattern FROM rules WHERE no = 0), 2) AS v, string_split_regex(t, (SELECT pattern FROM rules WHERE no = 0)) AS gaps FROM d
  UNION ALL
  SELECT doc_id, r.no, regexp_extract_all(t, r.pattern) AS h, regexp_extract_all(t, r.pattern) AS v, string_split_regex(t, r.pattern) AS gaps FROM d, rules r WHERE r.no > 0),
each AS (SELECT doc_id, no, unnest(range(1, len(h) + 1)) AS i, h, v, gaps FROM hits WHERE len(h) > 0),
flat AS (SELECT doc_id, no, i, length(h[i]) AS n, length(v[i]) AS vn, length(gaps[i]) AS gap FROM each),
placed AS (SELECT doc_id, no, n, vn, sum(n + gap) OVER (PARTITION BY doc_id, no ORDER BY i) AS e FROM flat),
kept AS (SELECT doc_id, p.no, r.kind, (e - n)::BIGINT AS s, e::BIGINT AS e FROM placed p JOIN rules r ON r.no = p.no WHERE vn >= r.least),
summed AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN summed USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
cl AS (SELECT *, (size >> greatest(length(bin(size)) - 5, 0)) << greatest(length(bin(size)) - 5, 0) AS class, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d),
src AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(CASE WHEN cap / w > level THEN level END) OVER () AS top FROM l),
t AS (SELECT k, source_size, coalesce(least(cap, w * top), cap) AS target, CASE WHEN source_size > 0 THEN coalesce(least(cap, w * top), cap) / source_size ELSE 0 END AS rate, ('0x' || substr(md5('mix-1:' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY class, h, size, doc_id) AS rank FROM cl)
SELECT doc_id, size, source_size, target, (least(floor(u + rate * rank) - floor(u + rate * (rank - 1)), 2) * size)::BIGINT AS taken FROM r JOIN t USING (k)
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def license_sql() -> str:
    """Every block against every template, without filters."""
    quoted = lambda x: "'" + x + "'"
    rows = ", ".join(f"('{t.name}', '{t.label}', {t in licenses.BASE}, {t.phrase}, [{', '.join(map(quoted, t.words))}])" for t in licenses.TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(name, label, base, phrase, words) AS (VALUES {rows}),
need AS (SELECT *, list_distinct(words) AS own, CASE WHEN phrase THEN len(list_distinct(words)) ELSE ceil(round({licenses.THRESHOLD}::DOUBLE * len(list_distinct(words)), 9)) END AS least FROM t),
b AS (SELECT no, s, w[s + 1 : s + {2 * licenses.STEP}] AS block FROM (SELECT no, w, unnest(range(0, greatest(len(w), 1), {licenses.STEP})) AS s FROM d)),
near AS (SELECT no, s, block, need.*, len(list_intersect(own, block)) AS n FROM b, need),
hits AS (SELECT *, CASE WHEN phrase THEN list_filter(range(0, {licenses.STEP}), lambda p: block[p + 1 : p + len(words)] = words) END AS places FROM near WHERE n >= least),
found AS (SELECT no, name, label, base, n / len(own) AS containment, list_transform(places, lambda p: p + s) AS places FROM hits WHERE NOT phrase OR len(places) > 0),
sums AS (SELECT no, sum(len(places)) FILTER (base) AS n_base, min(list_min(places)) FILTER (base) AS first_word, max(list_max(places)) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM found GROUP BY no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN sums USING (no)
"""


#: Costs and edits from the last row to the first, for each of the four states: nothing, s, u and a.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])) AS bytes FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
cased AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS damage FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS again FROM cased WHERE damage <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM hurt),
flawed AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN said = '' THEN 2 WHEN seen THEN 3 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
lists AS (SELECT conv_id, count(*) AS n, list(struct_pack(c := c, fault := fault, role := role, text := text) ORDER BY i) AS r, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || c NOT IN ('su', 'ua', 'au')) AS illegal FROM flawed GROUP BY conv_id),
walk AS (
  SELECT conv_id, r, n AS i, [(0, ''), (6, 'II'), (3, 'I'), (0, '')] AS best FROM lists
  UNION ALL
  SELECT conv_id, r, i - 1, list_transform(stay, lambda x, q: least(x, (stay[[3, 3, 4, 3][q]][1] + 3, 'I' || stay[[3, 3, 4, 3][q]][2]), (stay[[4, 4, 3, 4][q]][1] + 6, 'II' || stay[[4, 4, 3, 4][q]][2]))) FROM (
    SELECT conv_id, r, i, list_transform([1, 2, 3, 4], lambda q: least(
      (best[q][1] + 4, 'D' || best[q][2]),
      CASE WHEN r[i].fault < 2 AND k[q] > 0 THEN (best[k[q]][1] + 3 * (r[i].fault = 1)::INT, 'K' || best[k[q]][2]) ELSE (1000000000, '') END,
      CASE WHEN r[i].fault < 2 THEN (best[[3, 3, 4, 3][q]][1] + 3 + 3 * (r[i].fault = 1)::INT, 'R' || best[[3, 3, 4, 3][q]][2]) ELSE (1000000000, '') END)) AS stay
    FROM (SELECT *, CASE r[i].c WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS k FROM walk WHERE i > 0))),
audits AS (SELECT conv_id, best[1][1] AS cost, best[1][2] AS audit FROM walk WHERE i = 0),
edits AS (SELECT lists.conv_id, r, unnest(range(1, length(audit) + 1)) AS e, audit FROM audits JOIN lists ON audits.conv_id IS NOT DISTINCT FROM lists.conv_id),
steps AS (SELECT conv_id, e, audit[e] AS edit, r[(sum((audit[e] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY e))::BIGINT] AS said FROM edits),
kept AS (SELECT *, sum((edit IN ('I', 'R') OR said.c <> 's')::INT) OVER (PARTITION BY conv_id ORDER BY e) AS spoken FROM steps WHERE edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN said.role WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE said.text END, chr(10) ORDER BY e) AS repaired FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN lists ON c.conv_id IS NOT DISTINCT FROM lists.conv_id LEFT JOIN audits ON c.conv_id IS NOT DISTINCT FROM audits.conv_id LEFT JOIN lines ON c.conv_id IS NOT DISTINCT FROM lines.conv_id
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": OP2_SQL, "op4_source_mixing": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op11_license_scan": license_sql(), "op12_conversation_repair": OP12_SQL, "op13_hard_negatives": OP13_SQL}
