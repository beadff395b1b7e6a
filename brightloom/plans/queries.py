"""Queries over the given tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import clean, labels
from brightloom.operators import bags, cells, filters, glm, joins, models, neighbours, overlays, plotdata, preprocess, raster, scale, select, summary
from brightloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- groups


@query("""
SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count, round(median(l_quantity), 6) AS l_quantity_median, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
  count(l_discount) AS l_discount_count, round(median(l_discount), 6) AS l_discount_median, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.group_summary(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"]))


@query("""
SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min,
  round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(max(o_totalprice), 4) AS max
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL""")
def group_describe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.describe(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"), 4)


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.group_counts(table(spark, sf, "documents"), ["source", "lang"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY ALL")
def crosstab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT l_suppkey, round(100.0 * count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*), 6) AS "A", round(100.0 * count(*) FILTER (l_returnflag = 'N')::DOUBLE / count(*), 6) AS "N", round(100.0 * count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*), 6) AS "R"
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL""")
def crosstab_percent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.crosstab(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], True))


@query("""
WITH g AS (SELECT p_brand, 'p_size' AS feature, avg(p_size) AS mean, median(p_size) AS median, stddev_samp(p_size) AS std FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'p_retailprice', avg(p_retailprice), median(p_retailprice), stddev_samp(p_retailprice) FROM part GROUP BY ALL)
SELECT p_brand, feature, round_even(mean, 3) AS mean, round_even(median, 3) AS median, round_even(std, 3) AS std FROM g""")
def long_profile(spark: SparkSession, sf: str) -> DataFrame:
    return summary.long_profile(table(spark, sf, "part"), ["p_brand"], ["p_size", "p_retailprice"])


@query("""
WITH g AS (SELECT p_type, avg(p_size) AS a, avg(p_retailprice) AS b FROM part GROUP BY ALL)
SELECT p_type, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) AS p_size_z, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 6) AS p_retailprice_z FROM g""")
def z_across_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.z_across_groups(table(spark, sf, "part"), "p_type", ["p_size", "p_retailprice"]))


@query("""
WITH m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS na, stddev_pop(c_nationkey) AS ns FROM customer)
SELECT c_mktsegment, round(median((c_acctbal - a) / s), 6) AS c_acctbal_z, round(median((c_nationkey - na) / ns), 6) AS c_nationkey_z FROM customer, m GROUP BY ALL""")
def group_median_z(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scale.group_median_z(table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]))


@query("""
WITH v AS (SELECT event_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN NULL ELSE value END AS value FROM events), m AS (SELECT median(value) AS m FROM v), i AS (SELECT event_id, coalesce(value, m) AS value FROM v, m)
SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM i""")
def impute_and_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    first = df.agg(F.min("event_type")).first()[0]
    holes = df.select("event_id", F.when(F.col("event_type") != first, F.col("value")).alias("value"))
    return rounded(scale.prepare_matrix(holes, ["value"])[0])


@query("""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderstatus, least(floor((o_totalprice - lo) / ((hi - lo) / 25)), 24)::BIGINT AS bin, count(*) AS n FROM orders, r GROUP BY ALL""")
def histogram_shared_edges(spark: SparkSession, sf: str) -> DataFrame:
    return summary.histogram(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice")


@query("""
WITH r AS (SELECT source, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY ALL)
SELECT d.source, CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo)::DOUBLE / 30)), 29)::BIGINT END AS bin, count(*) AS n FROM documents d JOIN r USING (source) GROUP BY ALL""")
def histogram_own_edges(spark: SparkSession, sf: str) -> DataFrame:
    return summary.histogram(table(spark, sf, "documents").where("source is not null"), "source", "n_chars", 30, shared=False)


@query("""
WITH q AS (SELECT l_shipmode, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3 FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS x FROM lineitem) GROUP BY ALL)
SELECT l_returnflag, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, round(min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS whisker_low,
  round(max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS whisker_high, count(*) FILTER (NOT l_extendedprice BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS fliers
FROM lineitem JOIN q ON l_returnflag = l_shipmode GROUP BY l_returnflag, q1, med, q3""")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.box_stats(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("SELECT min(c_acctbal) AS all_min, max(c_acctbal) AS all_max, min(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS group_min, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS group_max FROM customer")
def value_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return summary.ranges(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING")


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL) AS errors FROM orders")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.status_counts(table(spark, sf, "orders"), "o_orderstatus", ("F", "O"))


@query("SELECT source, bool_and(lang = 'en') AS uniform FROM documents GROUP BY ALL")
def uniform_groups(spark: SparkSession, sf: str) -> DataFrame:
    return summary.uniform_groups(table(spark, sf, "documents"), "source", F.col("lang") == "en")


# ---- selections and filters

_RANGE = "(SELECT min(p_size) AS lo1, max(p_size) AS hi1, min(p_retailprice) AS lo2, max(p_retailprice) AS hi2 FROM part)"


@query(f"""
WITH b AS (SELECT min(p_brand) AS b FROM part), g AS (SELECT part.* FROM part, b WHERE p_brand = b), c AS (SELECT quantile_cont(p_size, 0.7) AS c1, quantile_cont(p_retailprice, 0.3) AS c2 FROM g), r AS {_RANGE}
SELECT p_partkey, p_size, p_retailprice, round(((p_size - lo1)::DOUBLE / (hi1 - lo1) + (1 - (p_retailprice - lo2) / (hi2 - lo2))) / 2, 6) AS combined_score FROM g, c, r WHERE p_size >= c1 AND p_retailprice <= c2 ORDER BY combined_score DESC, p_partkey LIMIT 20""")
def extremes_in_both(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part")
    brand = df.agg(F.min("p_brand")).first()[0]
    out = select.extremes(df, ("p_brand", brand), ("p_size", "high"), ("p_retailprice", "low"), 0.3, 20, "p_partkey", [F.desc("p_size"), "p_partkey"])
    return rounded(out.select("p_partkey", "p_size", "p_retailprice", "combined_score"))


@query("SELECT * FROM (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_partkey LIMIT 100) ORDER BY p_retailprice, p_partkey LIMIT 16")
def extremes_in_turn(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return select.sequential_top(df, ("p_size", "high", 100), ("p_retailprice", "low", 16), "p_partkey", [F.desc("p_size"), "p_retailprice", "p_partkey"])


@query("SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source, doc_id LIMIT 50")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return select.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn = 1")
def group_head(spark: SparkSession, sf: str) -> DataFrame:
    return select.group_head(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")


@query("""
WITH d AS (SELECT doc_id, source, lang, n_chars < 500 AS flagged, md5('42:' || doc_id) AS h FROM documents),
t AS (SELECT * FROM (SELECT doc_id, 0 AS tier, h FROM d WHERE flagged ORDER BY h, doc_id LIMIT 12) UNION ALL SELECT doc_id, 1, h FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS rn FROM d) WHERE rn = 1 UNION ALL SELECT * FROM (SELECT doc_id, 2, h FROM d ORDER BY h, doc_id LIMIT 36)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier) AS again FROM t)
SELECT doc_id, tier FROM f WHERE again = 1 ORDER BY tier, h, doc_id LIMIT 36""")
def tiered_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return select.tiered_sample(df, F.col("n_chars") < 500, ["source", "lang"], "doc_id", 36).select("doc_id", "tier")


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) >= 600) GROUP BY ALL")
def common_groups(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return summary.group_counts(filters.common_groups(df, ["l_suppkey"], 600), ["l_suppkey", "l_partkey"], df.count())


@query(r"""SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'widget') OR contains(regexp_replace(lower(p_name), '[\s_]+', '_', 'g'), 'small_ring'))""")
def exclude_substrings(spark: SparkSession, sf: str) -> DataFrame:
    df = filters.without_names(table(spark, sf, "part"), "p_name", ["Widget", ""])
    return filters.without_names(df, "p_name", ["small ring"], fold=True).select("p_partkey", "p_name")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p, string_split(regexp_replace(url, '^https?://', ''), '/') AS a FROM pages), s AS (SELECT page_id, CASE WHEN len(a) > 1 THEN a[1] ELSE 'unknown' END AS source_folder, CASE WHEN len(a) > 2 THEN a[2] ELSE 'unlabelled' END AS marker_label FROM p),
c AS (SELECT *, lower(source_folder) AS t, contains(lower(source_folder), 'a549') OR contains(lower(source_folder), 'nsclc') OR contains(lower(source_folder), 'lung cancer') AS ctl FROM s),
k AS (SELECT *, CASE WHEN ctl THEN 'other/control' WHEN contains(t, 'biphas') OR contains(t, 'msto') THEN 'biphasic' WHEN contains(t, 'epithel') THEN 'epithelioid' WHEN contains(t, 'sarcom') THEN 'sarcomatoid' ELSE 'unknown' END AS subtype, concat_ws('+', CASE WHEN regexp_matches(upper(marker_label), '(^|[^A-Z])PCK([^A-Z0-9]|$)') THEN 'PCK' END, CASE WHEN regexp_matches(upper(marker_label), '(^|[^A-Z])WT1([^A-Z0-9]|$)') THEN 'WT1' END, CASE WHEN regexp_matches(upper(marker_label), '(^|[^A-Z])CAL([^A-Z0-9]|$)') THEN 'CAL' END) AS g FROM c)
SELECT page_id, source_folder, CASE WHEN contains(t, 'msto') THEN 'MSTO-211H' WHEN contains(t, 'a549') THEN 'A549' ELSE source_folder END AS cell_line, marker_label, CASE WHEN g <> '' THEN g ELSE marker_label END AS marker_group, subtype, CASE WHEN ctl THEN 'nsclc_control' WHEN subtype <> 'unknown' THEN 'mesothelioma' ELSE 'unknown' END AS disease_group FROM k""")
def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return df.select("page_id", *[c.alias(n) for n, c in labels.path_labels("path").items()])


# ---- joins and sets


@query("""
SELECT d.doc_id, coalesce(nullif(trim(CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN '' END), ''), d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_override(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "").alias("source"))
    return joins.override(table(spark, sf, "documents").select("doc_id", "source"), new, "doc_id", ["source"])


_DONE = "SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    done = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("status", F.when(F.col("doc_id") % 7 == 0, "error").otherwise("ok"))
    return docs, done


@query(f"SELECT doc_id, sha256(text) AS sha FROM documents WHERE NOT EXISTS (SELECT 1 FROM ({_DONE}) x WHERE x.sha = sha256(text) AND status = 'ok')")
def incremental_todo(spark: SparkSession, sf: str) -> DataFrame:
    docs, done = _manifest(spark, sf)
    return joins.remaining(docs, done, ["sha"])


@query(f"SELECT doc_id, sha, status FROM ({_DONE}) WHERE status = 'error' UNION ALL SELECT doc_id, sha256(text), NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_DONE}) WHERE status = 'error')")
def carried_over(spark: SparkSession, sf: str) -> DataFrame:
    docs, done = _manifest(spark, sf)
    return joins.carried_over(done.where("status = 'error'"), docs, "doc_id").select("doc_id", "sha", "status")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name, region.r_regionkey AS r_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey % 2 = 0")
def lookup_left(spark: SparkSession, sf: str) -> DataFrame:
    right = table(spark, sf, "region").where("r_regionkey % 2 = 0").withColumn("n_regionkey", F.col("r_regionkey"))
    return joins.lookup(table(spark, sf, "nation"), right, "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "r_name", "r_regionkey")


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no customer' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status P' WHEN o_totalprice < 10000 THEN 'small' END AS error FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def integrity_chain(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("found"))
    rows = table(spark, sf, "orders").join(good, "o_custkey", "left")
    checks = [(F.col("found").isNull(), "no customer"), (~F.col("o_orderstatus").isin("F", "O"), "status P"), (F.col("o_totalprice") < 10000, "small")]
    return rows.select("o_orderkey", filters.first_failure(checks).alias("error"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_missing(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return select.union_missing(a, table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    # A digest stands for the text, so that texts aren't shuffled.
    df = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return select.keep_first(df, ["sha"], ["doc_id"]).select("doc_id", "source")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def except_names(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    return select.except_names(df.where("o_orderstatus = 'F'"), df.where("o_orderstatus = 'P'"), "o_custkey")


# ---- bags


@query("""
SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS xg_1, round(avg(l_discount), 6) AS xg_2,
  round(sum(m1), 6) AS c_1, round(CASE WHEN sum(m1) >= 1 THEN sum(m1 * l_quantity) / sum(m1) END, 6) AS xk1_1, round(CASE WHEN sum(m1) >= 1 THEN sum(m1 * l_discount) / sum(m1) END, 6) AS xk1_2,
  round(sum(m2), 6) AS c_2, round(CASE WHEN sum(m2) >= 1 THEN sum(m2 * l_quantity) / sum(m2) END, 6) AS xk2_1, round(CASE WHEN sum(m2) >= 1 THEN sum(m2 * l_discount) / sum(m2) END, 6) AS xk2_2
FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS m1, CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS m2 FROM lineitem) GROUP BY ALL""")
def bag_features(spark: SparkSession, sf: str) -> DataFrame:
    new = F.col("l_returnflag") == "N"
    df = table(spark, sf, "lineitem").withColumns({"m1": F.when(new, 1.0).otherwise(0.25), "m2": F.when(new, 0.0).otherwise(0.75)})
    return rounded(bags.bag_features(df, "l_suppkey", ["l_quantity", "l_discount"], ["m1", "m2"]))


_BAGS = "SELECT c_custkey, c_mktsegment, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS c_1, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS c_2, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS c_3, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"


def _bags(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return bags.composition(rows, "c_custkey", "o_orderstatus", "c_mktsegment", ["F", "O", "P"])


@query(_BAGS)
def bag_composition(spark: SparkSession, sf: str) -> DataFrame:
    return _bags(spark, sf)


@query(f"SELECT c_mktsegment, round(avg(c_1 * 100 / n), 6) AS c_1_pct, round(avg(c_2 * 100 / n), 6) AS c_2_pct, round(avg(c_3 * 100 / n), 6) AS c_3_pct FROM ({_BAGS}) GROUP BY ALL")
def mean_composition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bags.mean_parts(_bags(spark, sf), "c_mktsegment", ["c_1", "c_2", "c_3"]))


@query(f"""
WITH b AS (SELECT x.*, c_acctbal FROM ({_BAGS}) x JOIN customer USING (c_custkey)), r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM b),
p AS (SELECT *, (hi - lo) / 10 AS w, greatest(ceil((c_acctbal - lo) / ((hi - lo) / 10)), 1)::BIGINT AS bin FROM b, r),
m AS (SELECT bin, (lo + (bin - 1) * w - CASE WHEN bin = 1 THEN (hi - lo) * 0.001::DOUBLE ELSE 0 END + lo + bin * w) / 2 AS mid, c_1 * 100 / n AS c_1, c_2 * 100 / n AS c_2, c_3 * 100 / n AS c_3, n FROM p),
s AS (SELECT bin, mid, sum(c_1) AS c_1, sum(c_2) AS c_2, sum(c_3) AS c_3, sum(n)::BIGINT AS n FROM m GROUP BY ALL)
SELECT bin, round(mid, 6) AS mid, round(c_1 / (c_1 + c_2 + c_3) * 100, 6) AS c_1_pct, round(c_2 / (c_1 + c_2 + c_3) * 100, 6) AS c_2_pct, round(c_3 / (c_1 + c_2 + c_3) * 100, 6) AS c_3_pct, n FROM s""")
def stacked_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bags(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rounded(bags.stacked(rows, "c_acctbal", ["c_1", "c_2", "c_3"]))


# ---- models

_PER_USER = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS y, (user_id % 2)::DOUBLE AS x FROM events GROUP BY ALL"


def _per_user(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    first = df.agg(F.min("event_type")).first()[0]
    out = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == first).alias("y"))
    return out.withColumns({"x": (F.col("user_id") % 2).cast("double"), "log_n": F.ln("n")})


def _effects(df: DataFrame) -> DataFrame:
    return rounded(df.select("term", "coef", "se", "nobs"), 5)


@query("""
WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_suppkey AS g FROM lineitem), s AS (SELECT count(*) AS n, count(DISTINCT g) AS k, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d),
b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS b0, n * sxx - sx * sx AS det FROM s),
c AS (SELECT g, sum(y - b0 - b1 * x) AS u0, sum((y - b0 - b1 * x) * x) AS u1 FROM d, b GROUP BY g), m AS (SELECT sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM c),
v AS (SELECT b.*, (sxx * (sxx * m00 - sx * m01) - sx * (sxx * m01 - sx * m11)) / (det * det) AS v0, (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (det * det) AS v1, k / (k - 1.0::DOUBLE) * (n - 1.0::DOUBLE) / (n - 2.0::DOUBLE) AS f FROM b, m)
SELECT 'Intercept' AS term, round(b0, 5) AS coef, round(sqrt(v0 * f), 5) AS se, n AS nobs FROM v UNION ALL SELECT 'x', round(b1, 5), round(sqrt(v1 * f), 5), n FROM v""")
def glm_gaussian_cluster(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), "l_suppkey")
    return _effects(glm.fit(df, [glm.Model("y", ["x"])], "l_suppkey"))


@query(f"""
WITH u AS ({_PER_USER}), g AS (SELECT x, sum(y)::DOUBLE / sum(n) AS r FROM u GROUP BY x), s AS (SELECT u.x, any_value(r) AS r, sum(power(y - r * n, 2)) / power(sum(r * n), 2) AS v FROM u JOIN g ON g.x = u.x GROUP BY u.x), p AS (SELECT max(r) FILTER (x = 0) AS r0, max(v) FILTER (x = 0) AS v0, max(r) FILTER (x = 1) AS r1, max(v) FILTER (x = 1) AS v1 FROM s)
SELECT 'Intercept' AS term, round(ln(r0), 5) AS coef, round(sqrt(v0), 5) AS se, (SELECT count(*) FROM u) AS nobs FROM p UNION ALL SELECT 'x', round(ln(r1 / r0), 5), round(sqrt(v0 + v1), 5), (SELECT count(*) FROM u) FROM p""")
def glm_poisson_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _effects(glm.fit(_per_user(spark, sf), [glm.Model("y", ["x"], "poisson", "log_n")]))


@query("""
WITH d AS (SELECT toxic AS y, quality::DOUBLE AS x FROM labels), g AS (SELECT x, count(*) AS n, avg(y) AS p FROM d GROUP BY x), s AS (SELECT d.x, any_value(p) AS p, sum(power(y - p, 2)) / power(any_value(n * p * (1 - p)), 2) AS v FROM d JOIN g ON g.x = d.x GROUP BY d.x),
q AS (SELECT max(p) FILTER (x = 0) AS p0, max(v) FILTER (x = 0) AS v0, max(p) FILTER (x = 1) AS p1, max(v) FILTER (x = 1) AS v1 FROM s)
SELECT 'Intercept' AS term, round(ln(p0 / (1 - p0)), 5) AS coef, round(sqrt(v0), 5) AS se, (SELECT count(*) FROM d) AS nobs FROM q UNION ALL SELECT 'x', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5), round(sqrt(v0 + v1), 5), (SELECT count(*) FROM d) FROM q""".replace("toxic AS y, quality::DOUBLE AS x FROM labels", "(o_orderstatus = 'F')::INT AS y, (o_orderkey % 2)::DOUBLE AS x FROM orders"))
def glm_binomial(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 2).cast("double").alias("x"))
    return _effects(glm.fit(df, [glm.Model("y", ["x"], "binomial")]))


@query(f"""
WITH u AS ({_PER_USER}), g AS (SELECT x, avg(n) AS m FROM u GROUP BY x), s AS (SELECT u.x, any_value(m) AS m, sum(power((n - m) / (1 + m), 2)) / power(sum(m / (1 + m)), 2) AS v FROM u JOIN g ON g.x = u.x GROUP BY u.x), p AS (SELECT max(m) FILTER (x = 0) AS m0, max(v) FILTER (x = 0) AS v0, max(m) FILTER (x = 1) AS m1, max(v) FILTER (x = 1) AS v1 FROM s)
SELECT 'Intercept' AS term, round(ln(m0), 5) AS coef, round(sqrt(v0), 5) AS se, (SELECT count(*) FROM u) AS nobs FROM p UNION ALL SELECT 'x', round(ln(m1 / m0), 5), round(sqrt(v0 + v1), 5), (SELECT count(*) FROM u) FROM p""")
def glm_negative_binomial(spark: SparkSession, sf: str) -> DataFrame:
    return _effects(glm.fit(_per_user(spark, sf), [glm.Model("n", ["x"], "nb")]))


def newton_sql(rows: str, family: str, cluster: bool, steps: int = 14) -> str:
    """CTEs that fit y ~ 1 + x (+ the offset o) for each (target, term) of rows(target, term, g, y, x, o), by Newton's steps
    written out: fit(target, term, coef, se, p, ci_lo, ci_hi, nobs), for the slopes. g: the cluster of a row."""
    eta = "(b.b0 + b.b1 * r.x + r.o)"
    mu = {"gaussian": eta, "binomial": f"(1 / (1 + exp(-{eta})))", "nb": f"exp({eta})"}[family]
    w = {"gaussian": "1.0::DOUBLE", "binomial": "(m * (1 - m))", "nb": "(m / (1 + m))"}[family]
    s = "((y - m) / (1 + m))" if family == "nb" else "(y - m)"
    first = {"gaussian": "0.0::DOUBLE", "binomial": "ln(sum(y) / (count(*) - sum(y)))", "nb": "ln(sum(y) / sum(exp(o)))"}[family]
    out = [f"r AS (SELECT target, term, g, y::DOUBLE AS y, x::DOUBLE AS x, o::DOUBLE AS o FROM ({rows}) WHERE y IS NOT NULL AND x IS NOT NULL)", f"b0 AS (SELECT target, term, {first} AS b0, 0.0::DOUBLE AS b1 FROM r GROUP BY ALL)"]
    for k in range(steps):
        out.append(f"m{k} AS (SELECT r.*, {mu} AS m FROM r JOIN b{k} b USING (target, term))")
        out.append(f"h{k} AS (SELECT target, term, sum({w}) AS a, sum({w} * x) AS b, sum({w} * x * x) AS c, sum({s}) AS s0, sum({s} * x) AS s1 FROM m{k} GROUP BY ALL)")
        out.append(f"b{k + 1} AS (SELECT target, term, b.b0 + (h.c * s0 - h.b * s1) / (h.a * h.c - h.b * h.b) AS b0, b.b1 + (h.a * s1 - h.b * s0) / (h.a * h.c - h.b * h.b) AS b1 FROM b{k} b JOIN h{k} h USING (target, term))")
    k = steps - 1
    group, factor = ("g", "n_g / (n_g - 1) * (n - 1) / (n - 2)") if cluster else ("row_number() OVER ()", "1")
    out.append(f"gs AS (SELECT target, term, k, sum(s0) AS s0, sum(s1) AS s1, count(*) AS n FROM (SELECT target, term, {group} AS k, {s} AS s0, {s} * x AS s1 FROM m{k}) GROUP BY ALL)")
    out.append("meat AS (SELECT target, term, sum(s0 * s0) AS p, sum(s0 * s1) AS q, sum(s1 * s1) AS t, count(*)::DOUBLE AS n_g, sum(n)::DOUBLE AS n FROM gs GROUP BY ALL)")
    out.append(f"se AS (SELECT target, term, n, b1 AS coef, sqrt((b * b * p - 2 * a * b * q + a * a * t) * {factor}) / (a * c - b * b) AS se FROM meat JOIN h{k} USING (target, term) JOIN b{steps} USING (target, term))")
    # The normal tail by Simpson's rule, as SQL has no error function.
    out.append("z AS (SELECT *, least(abs(coef / se) / sqrt(2), 12) AS u FROM se)")
    simpson = "list_sum(list_transform(range(0, 1201), lambda i: CASE WHEN i IN (0, 1200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(u * i / 1200, 2)))) * u / 3600"
    out.append(f"fit AS (SELECT target, term, coef, se, greatest(1 - 2 / sqrt(pi()) * {simpson}, 0) AS p, coef - 1.959963984540054 * se AS ci_lo, coef + 1.959963984540054 * se AS ci_hi, n::BIGINT AS nobs FROM z)")
    return ", ".join(out)


def tested_sql(by: str = "") -> str:
    """The end of such a query: q over all slopes, or those of each `by`."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT target, term, round(coef, 5) AS coef, round(se, 5) AS se, round(p, 5) AS p, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi, nobs,
      round(least(min(p * m / k) OVER ({part} ORDER BY k DESC), 1), 5) AS q FROM (SELECT *, count(*) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY p, target, term) AS k FROM fit)"""


def _tested(df: DataFrame) -> DataFrame:
    return rounded(df.select("target", "term", "coef", "se", "p", "ci_lo", "ci_hi", "nobs", "q"), 5)


_SCALED = ", ".join(f"(l_{c} - avg(l_{c}) OVER ()) / stddev_pop(l_{c}) OVER () AS l_{c}" for c in ("quantity", "discount", "tax"))
_PAIRS = " UNION ALL ".join(f"SELECT 'flag_{f}' AS target, 'l_{c}' AS term, l_suppkey AS g, (l_returnflag = '{f}')::INT AS y, l_{c} AS x, 0 AS o FROM s" for f in "ANR" for c in ("quantity", "discount", "tax"))


@query("""
WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM r GROUP BY g), a AS (SELECT * FROM m WHERE g = (SELECT min(g) FROM m)),
d AS (SELECT x - mx AS dx, y - my AS dy FROM r JOIN m USING (g)), b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS xx FROM d)
SELECT 'l_quantity' AS term, round(b, 6) AS coef, round((SELECT sqrt(sum(dx * dx * (dy - b.b * dx) * (dy - b.b * dx))) FROM d) / xx, 6) AS se FROM b
UNION ALL SELECT 'l_returnflag[' || m.g || ']', round(m.my - a.my - b * (m.mx - a.mx), 6), NULL FROM m, a, b WHERE m.g > a.g""")
def glm_text_covariate(spark: SparkSession, sf: str) -> DataFrame:
    """A covariate of text enters a model as indicators of its levels."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    effects = glm.fit(rows, [glm.Model("price", ["l_quantity", "l_returnflag"])]).where("term <> 'Intercept'")
    return rounded(effects.select("term", "coef", F.when(F.col("term") == "l_quantity", F.col("se")).alias("se")))


@query(f"WITH s AS (SELECT l_suppkey, l_returnflag, {_SCALED} FROM lineitem), {newton_sql(_PAIRS, 'binomial', True)} {tested_sql()}")
def feature_association(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_suppkey", *[(F.col("l_returnflag") == f).cast("int").alias(f"flag_{f}") for f in "ANR"], "l_quantity", "l_discount", "l_tax")
    # A flat column and a target that never occurs can't carry a model and drop out.
    df = df.withColumns({"l_flat": F.lit(1.0), "flag_X": F.lit(0)})
    return _tested(glm.feature_association(scale.zscore(df, ["l_quantity", "l_discount", "l_tax"]), ["flag_A", "flag_N", "flag_R", "flag_X"], ["l_quantity", "l_discount", "l_tax", "l_flat"], "l_suppkey", dict.fromkeys(("flag_A", "flag_N", "flag_R", "flag_X"), "binomial")))


_COUNTS = " UNION ALL ".join(f"SELECT 'c_{k}' AS target, 'building' AS term, c_custkey AS g, c_{k} AS y, (c_mktsegment = 'BUILDING')::INT AS x, ln(n) AS o FROM bags" for k in (1, 2, 3))


@query(f"WITH bags AS ({_BAGS}), {newton_sql(_COUNTS, 'nb', False, 25)} {tested_sql()}")
def community_abundance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bags(spark, sf).withColumn("building", clean.flag(F.col("c_mktsegment") == "BUILDING"))
    return _tested(glm.community_abundance(rows, ["c_1", "c_2", "c_3"], ["building"]).where("term = 'building'"))


@query(f"""
WITH d AS (SELECT l_suppkey, avg(l_quantity) AS xg_1 FROM lineitem GROUP BY ALL), t AS (SELECT s_suppkey, s_acctbal / 1000 AS balance, (s_acctbal > 3000)::INT AS rich FROM supplier),
{newton_sql("SELECT 'balance' AS target, 'xg_1' AS term, l_suppkey AS g, balance AS y, xg_1 AS x, 0 AS o FROM d JOIN t ON l_suppkey = s_suppkey", 'gaussian', False, 2)} {tested_sql('target')}""")
def bag_association(spark: SparkSession, sf: str) -> DataFrame:
    design = bags.bag_features(table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity"], [])
    outcomes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 1000).alias("balance"))
    return _tested(glm.bag_association(design, outcomes, "l_suppkey", ["balance"]))


@query(f"""
WITH {newton_sql("SELECT 'urgent' AS target, 'm_1' AS term, o_custkey AS g, (o_orderpriority = '1-URGENT')::INT AS y, (o_orderstatus = 'F')::INT AS x, 0 AS o FROM orders", 'binomial', True)} {tested_sql()}""")
def membership_association(spark: SparkSession, sf: str) -> DataFrame:
    # m_2 is the reference, as every order is in one of both.
    df = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_orderstatus") != "F").cast("double").alias("m_2"), (F.col("o_orderstatus") == "F").cast("double").alias("m_1"))
    return _tested(glm.membership_association(df, "urgent", "o_custkey"))


_P = "SELECT user_id, event_type, count(*) AS n, (('0x' || substr(md5(user_id || ':' || event_type), 1, 8))::BIGINT / 4294967296.0::DOUBLE) ^ 3 AS p FROM events GROUP BY ALL"


def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "user_id", "event_type")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("p", F.pow(u, 3))


_Q = f"""SELECT user_id, event_type, p, least(min(p * m / rank) OVER (PARTITION BY event_type ORDER BY rank DESC), 1.0::DOUBLE) AS q FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, user_id) AS rank, count(*) OVER (PARTITION BY event_type) AS m FROM ({_P}))"""


@query(f"SELECT user_id, event_type, round(p, 8) AS p, round(q, 8) AS q, q <= 0.05 AS significant FROM ({_Q})")
def false_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(glm.false_discovery(_p_values(spark, sf), by=["event_type"], key=["user_id"]).select("user_id", "event_type", "p", "q", "significant"), 8)


@query("""
WITH e AS (SELECT l_linestatus AS term, l_returnflag AS target, avg(l_discount) AS coef, stddev_samp(l_tax) / 2 AS q FROM lineitem GROUP BY ALL)
SELECT term, round(coalesce(max(coef) FILTER (target = 'A'), 0), 8) AS "A_effect", coalesce(max(CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE '' END) FILTER (target = 'A'), '') AS "A_stars",
  round(coalesce(max(coef) FILTER (target = 'N'), 0), 8) AS "N_effect", coalesce(max(CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE '' END) FILTER (target = 'N'), '') AS "N_stars" FROM e GROUP BY term""")
def effects_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("term"), F.col("l_returnflag").alias("target")).agg(F.avg("l_discount").alias("coef"), (F.stddev_samp("l_tax") / 2).alias("q"))
    return rounded(plotdata.effects_table(e, ["A", "N"]), 8)


@query("""SELECT feature, max(v) FILTER (r_regionkey = 0) AS "0", max(v) FILTER (r_regionkey = 1) AS "1", max(v) FILTER (r_regionkey = 2) AS "2" FROM (SELECT n_regionkey AS r_regionkey, 'n' AS feature, count(*) AS v FROM nation GROUP BY ALL UNION ALL SELECT n_regionkey, 'top', max(n_nationkey)::BIGINT FROM nation GROUP BY ALL) GROUP BY feature""")
def transposed(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("n_nationkey").cast("long").alias("top"))
    return plotdata.transposed(df, "n_regionkey", ["n", "top"], [0, 1, 2])


@query()
def kmeans_groups(spark: SparkSession, sf: str) -> DataFrame:
    return models.kmeans(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 4).select("vec_id", "cluster")


@query()
def neighbour_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Places in the plane by a graph of nearest neighbours."""
    return rounded(neighbours.plane(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id"))


@query()
def plane_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return models.plane(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "pc1", "pc2")


# ---- rasters: each embedding is taken as a picture of 8 by 8

_PX = """r AS (SELECT vec_id AS image, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), u AS (SELECT image, list_min(e) AS lo, list_max(e) AS hi, unnest(e) AS raw, generate_subscripts(e, 1) - 1 AS i FROM r),
px AS (SELECT image, (i // 8)::INT AS y, (i % 8)::INT AS x, coalesce((raw - lo) / nullif(hi - lo, 0), 0) AS v, coalesce((raw - lo) / nullif(hi - lo, 0), 0) > 0.5 AS m FROM u), ins AS (SELECT * FROM px WHERE m)"""
_EIGHT = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))"


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    return raster.masked(raster.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding", 8))


@query(f"WITH {_PX} SELECT image, round(avg(v), 6) AS cell_mean, round(stddev_pop(v), 6) AS cell_std, round(quantile_cont(v, 0.05), 6) AS cell_p05, round(quantile_cont(v, 0.5), 6) AS cell_p50, round(quantile_cont(v, 0.95), 6) AS cell_p95 FROM ins GROUP BY image")
def raster_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.intensity(_pixels(spark, sf)))


@query(f"""
WITH {_PX}, a AS (SELECT image, count(*) AS area, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS xy, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box FROM ins GROUP BY image), b AS (SELECT *, (yy + xx) / 2 + sqrt(((yy - xx) / 2) ^ 2 + xy ^ 2) AS big, greatest((yy + xx) / 2 - sqrt(((yy - xx) / 2) ^ 2 + xy ^ 2), 0) AS small FROM a)
SELECT image, area, round(sqrt(4 * area / pi()), 5) AS equivalent_diameter, round(4 * sqrt(big), 5) AS major_axis, round(4 * sqrt(small), 5) AS minor_axis, round(CASE WHEN big > 0 THEN sqrt(greatest(1 - small / big, 0)) ELSE 0 END, 5) AS eccentricity, round(area / box::DOUBLE, 5) AS extent FROM b""")
def raster_shape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.shape(_pixels(spark, sf)), 5)


@query(f"""
WITH {_PX}, l AS (SELECT *, least(floor(v * 32), 31)::INT AS g FROM ins), o(dy, dx) AS (VALUES (0, 1), (1, 1), (1, 0), (1, -1), (0, 2), (2, 2), (2, 0), (2, -2), (0, 4), (4, 4), (4, 0), (4, -4)),
p AS (SELECT a.image, dy, dx, a.g AS a, b.g AS b FROM l a, o, l b WHERE b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx), q AS (SELECT image, dy, dx, a, b FROM p UNION ALL SELECT image, dy, dx, b, a FROM p),
n AS (SELECT image, dy, dx, a, b, count(*) / sum(count(*)) OVER (PARTITION BY image, dy, dx) AS p FROM q GROUP BY image, dy, dx, a, b),
s AS (SELECT image, sum(p * (a - b) ^ 2) AS contrast, sum(p / (1 + (a - b) ^ 2)) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * a) AS m, sum(p * a * a) AS aa, sum(p * a * b) AS ab FROM n GROUP BY image, dy, dx)
SELECT image, round(avg(contrast), 5) AS glcm_contrast, round(avg(homogeneity), 5) AS glcm_homogeneity, round(avg(energy), 5) AS glcm_energy, round(avg(CASE WHEN aa - m * m < 1e-12 THEN 1 ELSE (ab - m * m) / (aa - m * m) END), 5) AS glcm_correlation FROM s GROUP BY image""")
def raster_glcm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.glcm(_pixels(spark, sf)), 5)


@query(f"""
WITH {_PX}, e AS (SELECT image, 0 AS edge, x AS pos FROM ins WHERE y = 0 UNION ALL SELECT image, 1, x FROM ins WHERE y = 7 UNION ALL SELECT image, 2, y FROM ins WHERE x = 0 UNION ALL SELECT image, 3, y FROM ins WHERE x = 7),
rr AS (SELECT image, edge, pos - row_number() OVER (PARTITION BY image, edge ORDER BY pos) AS run FROM e), n AS (SELECT image, count(*) AS n FROM rr GROUP BY image, edge, run)
SELECT vec_id AS image, coalesce(max(n), 0) AS longest_run FROM embeddings LEFT JOIN n ON image = vec_id GROUP BY vec_id""")
def raster_border_runs(spark: SparkSession, sf: str) -> DataFrame:
    return raster.longest_border_run(_pixels(spark, sf))


@query(f"""
WITH {_PX}, b AS (SELECT i.* FROM ins i WHERE (SELECT count(*) FROM ins j WHERE j.image = i.image AND abs(j.y - i.y) + abs(j.x - i.x) = 1) < 4),
c AS (SELECT image, y + dy AS y, x + dx AS x, sum(CASE WHEN dy = 0 AND dx = 0 THEN 1 WHEN dy = 0 OR dx = 0 THEN 2 ELSE 10 END) AS code FROM b, (SELECT * FROM {_EIGHT} UNION ALL SELECT 0, 0) o(dy, dx) GROUP BY ALL)
SELECT image, round(sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM c GROUP BY image""")
def raster_perimeter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.perimeter(_pixels(spark, sf)))


@query(f"""
WITH RECURSIVE {_PX}, t(image, y, x, label) AS (SELECT image, y, x, y * 65536 + x FROM ins UNION SELECT i.image, i.y, i.x, t.label FROM t JOIN ins i ON i.image = t.image AND abs(i.y - t.y) <= 1 AND abs(i.x - t.x) <= 1),
c AS (SELECT image, y, x, min(label) AS component FROM t GROUP BY image, y, x), s AS (SELECT image, component, count(*) AS n FROM c GROUP BY image, component)
SELECT image, count(*) AS component_count, max(n) AS largest_area, round(max(n) / sum(n), 6) AS selected_fraction FROM s GROUP BY image""")
def raster_components(spark: SparkSession, sf: str) -> DataFrame:
    kept = raster.largest(_pixels(spark, sf))
    return rounded(kept.where("in").groupBy("image").agg(F.max("component_count").alias("component_count"), F.count(F.lit(1)).alias("largest_area"), F.max("selected_fraction").alias("selected_fraction")))


@query(f"""
WITH {_PX}, d AS (SELECT DISTINCT o.* FROM px o JOIN ins i ON i.image = o.image AND (i.y - o.y) ^ 2 + (i.x - o.x) ^ 2 <= 1 WHERE NOT o.m), ring AS (SELECT image, avg(v) AS rm, stddev_pop(v) AS rs FROM d GROUP BY image), c AS (SELECT image, avg(v) AS cm, stddev_pop(v) AS cs FROM ins GROUP BY image)
SELECT image, round(rm, 6) AS ring_mean, round(cm - rm, 6) AS cell_minus_ring_mean, round(CASE WHEN rs > 0 THEN cs / rs END, 6) AS cell_to_ring_std_ratio FROM c LEFT JOIN ring USING (image)""")
def raster_ring(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.ring_intensity(_pixels(spark, sf), 1))


@query(f"""
WITH {_PX}, n AS (SELECT i.image, i.y, i.x FROM ins i WHERE NOT EXISTS (SELECT 1 FROM px o WHERE o.image = i.image AND NOT o.m AND (i.y - o.y) ^ 2 + (i.x - o.x) ^ 2 <= 1)), k(dy, dx) AS {_EIGHT},
g AS (SELECT n.image, n.y, n.x, sum(dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END) * v) / 4 AS gy, sum(dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) * v) / 4 AS gx FROM n, k, px p WHERE p.image = n.image AND p.y = greatest(0, least(7, n.y + dy)) AND p.x = greatest(0, least(7, n.x + dx)) GROUP BY ALL)
SELECT image, round(avg(sqrt((gy ^ 2 + gx ^ 2) / 2)), 6) AS grad_mean, round(stddev_pop(sqrt((gy ^ 2 + gx ^ 2) / 2)), 6) AS grad_std FROM g GROUP BY image""")
def raster_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.gradient(_pixels(spark, sf)))


@query(f"""
WITH {_PX}, n AS (SELECT image, count(*) / sum(count(*)) OVER (PARTITION BY image) AS p FROM ins GROUP BY image, round_even(v * 255, 0)) SELECT image, round(sum(-p * log2(p)), 6) AS entropy FROM n GROUP BY image""")
def raster_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.entropy(_pixels(spark, sf)))


@query(f"""
WITH {_PX}, ends AS (SELECT image, y, min(x) AS a, max(x) AS b FROM ins GROUP BY ALL),
pts AS (SELECT DISTINCT image, u, w FROM (SELECT image, 2 * y + o.dy AS u, 2 * e.x + o.dx AS w FROM (SELECT image, y, unnest([a, b]) AS x FROM ends) e, (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) o(dy, dx))),
sides AS (SELECT p.image, p.u AS u1, p.w AS w1, q.u AS u2, q.w AS w2 FROM pts p JOIN pts q ON p.image = q.image AND (p.u, p.w) <> (q.u, q.w) JOIN pts r ON r.image = p.image GROUP BY ALL HAVING min((q.u - p.u) * (r.w - p.w) - (q.w - p.w) * (r.u - p.u)) >= 0),
hull AS (SELECT px.image, px.y, px.x FROM px JOIN sides s ON s.image = px.image GROUP BY ALL HAVING min((u2 - u1) * (2 * px.x - w1) - (w2 - w1) * (2 * px.y - u1)) >= 0)
SELECT image, n AS convex_area, round(m / n::DOUBLE, 6) AS solidity FROM (SELECT image, count(*) AS n FROM hull GROUP BY ALL) JOIN (SELECT image, count(*) AS m FROM ins GROUP BY ALL) USING (image)""")
def raster_solidity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cells.solidity(_pixels(spark, sf)))


@query()
def raster_measures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cells.measured(_pixels(spark, sf), least_run=7))


@query()
def raster_texture(spark: SparkSession, sf: str) -> DataFrame:
    px = _pixels(spark, sf)
    return rounded(raster.edge_density(px).join(raster.pattern_texture(px), "image"))


@query()
def raster_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return raster.cleaned(_pixels(spark, sf), radius=1).groupBy("image").agg(F.count_if("in").alias("area"))


# ---- pictures made ready: each embedding is taken as a picture with 256 grey levels


def _greys(spark: SparkSession, sf: str, width: int) -> DataFrame:
    px = raster.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding", width)
    return px.withColumn("v", F.floor(F.col("v") * 255 + 0.5).cast("int"))


def _greys_sql(width: int) -> str:
    return f"{_PX}, g AS (SELECT image, (8 * y + x) // {width} AS y, (8 * y + x) % {width} AS x, floor(v * 255 + 0.5)::INT AS v FROM px)"


@query(f"""
WITH {_greys_sql(2)}, profile AS (SELECT image, y, avg((v < 55)::INT) AS dark, avg(v) AS mean FROM g WHERE y < 9 GROUP BY image, y),
f AS (SELECT *, min(CASE WHEN dark >= 0.7::DOUBLE AND y >= 7 THEN y END) OVER (PARTITION BY image) AS since, abs(mean - lag(mean) OVER (PARTITION BY image ORDER BY y)) AS step, avg(dark) OVER (PARTITION BY image ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM profile),
s AS (SELECT *, min(CASE WHEN dark < 0.7::DOUBLE AND y > since THEN y END) OVER (PARTITION BY image) AS stop, row_number() OVER (PARTITION BY image ORDER BY round(step, 9) DESC NULLS LAST, y) AS place FROM f)
SELECT image, greatest(coalesce(max(CASE WHEN dark >= 0.7::DOUBLE AND (stop IS NULL OR y < stop) THEN y + 1 END), 0), max(CASE WHEN place = 1 AND y BETWEEN 6 AND 7 AND above >= 0.55::DOUBLE THEN y ELSE 0 END))::INT AS bar FROM s GROUP BY image""")
def top_bars(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.top_bars(_greys(spark, sf, 2))


_KERNEL = "SELECT i, exp(-(i * i) / (2 * {d} * {d})) / sum(exp(-(i * i) / (2 * {d} * {d}))) OVER () AS k FROM (SELECT unnest(range(-{r}, {r} + 1)) AS i)"
_MIRROR = "CASE WHEN (({p} + o.i) % 14 + 14) % 14 < 8 THEN (({p} + o.i) % 14 + 14) % 14 ELSE 14 - (({p} + o.i) % 14 + 14) % 14 END"


def _blur_sql(name: str, of: str, radius: int, deviation: float) -> str:
    """Kernels along x, then y, of pictures of 8 by 8."""
    return f"""k_{name} AS ({_KERNEL.format(r=radius, d=f"{deviation}::DOUBLE")}),
x_{name} AS (SELECT a.image, a.y, a.x, sum(o.k * b.v) AS v FROM {of} a, k_{name} o, {of} b WHERE b.image = a.image AND b.y = a.y AND b.x = {_MIRROR.format(p="a.x")} GROUP BY a.image, a.y, a.x),
{name} AS (SELECT a.image, a.y, a.x, floor(round(sum(o.k * b.v), 6) + 0.5)::INT AS v FROM x_{name} a, k_{name} o, x_{name} b WHERE b.image = a.image AND b.x = a.x AND b.y = {_MIRROR.format(p="a.y")} GROUP BY a.image, a.y, a.x)"""


def _square_sql(name: str, of: str, radius: int, f: str) -> str:
    return f"{name} AS (SELECT a.image, a.y, a.x, {f}(b.v) AS v FROM {of} a JOIN {of} b ON b.image = a.image AND abs(b.y - a.y) <= {radius} AND abs(b.x - a.x) <= {radius} GROUP BY a.image, a.y, a.x)"


@query(f"""
WITH RECURSIVE {_greys_sql(8)}, {_blur_sql("soft", "g", 3, 1.4)}, {_blur_sql("ground", "soft", 63, 21.0)},
d AS (SELECT image, y, x, abs(soft.v - ground.v) AS v FROM soft JOIN ground USING (image, y, x)),
h AS (SELECT image, v, sum(n) OVER up AS w1, sum(n * v) OVER up AS s1, sum(n) OVER al AS w, sum(n * v) OVER al AS s FROM (SELECT image, v, count(*) AS n FROM d GROUP BY image, v) WINDOW up AS (PARTITION BY image ORDER BY v), al AS (PARTITION BY image)),
b AS (SELECT image, v, CASE WHEN w1 < w THEN ((w1 * s - w * s1)::DOUBLE * (w1 * s - w * s1)::DOUBLE) / (w1 * (w - w1))::DOUBLE END AS between_ FROM h),
cut AS (SELECT image, coalesce(max(v) FILTER (place = 1 AND between_ > 0), 0) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY between_ DESC NULLS LAST, v) AS place FROM b) GROUP BY image),
m0 AS (SELECT d.image, y, x, (d.v > cut)::INT AS v FROM d JOIN cut USING (image)), {_square_sql("m1", "m0", 4, "max")}, {_square_sql("m2", "m1", 4, "min")}, {_square_sql("m3", "m2", 2, "min")}, {_square_sql("m4", "m3", 2, "max")},
inside AS (SELECT * FROM m4 WHERE v = 1),
t(image, y, x, label) AS (SELECT image, y, x, y * 8 + x FROM inside UNION SELECT i.image, i.y, i.x, t.label FROM t JOIN inside i ON i.image = t.image AND abs(i.y - t.y) <= 1 AND abs(i.x - t.x) <= 1),
c AS (SELECT image, y, x, min(label) AS component FROM t GROUP BY image, y, x),
box AS (SELECT image, component, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, count(*) AS area FROM c GROUP BY image, component),
fit AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(area / (1 + 6 * (((x + bw / 2 - 4) / 8) ** 2 + ((y + bh / 2 - 4) / 8) ** 2)), 9) DESC, component) AS place FROM box WHERE area BETWEEN 0.256::DOUBLE AND 44.8::DOUBLE AND bw / bh BETWEEN 0.15::DOUBLE AND 6)
SELECT vec_id AS image, x::INT AS x1, y::INT AS y1, (x + bw)::INT AS x2, (y + bh)::INT AS y2 FROM embeddings LEFT JOIN fit ON image = vec_id AND place = 1""")
def cell_boxes(spark: SparkSession, sf: str) -> DataFrame:
    found = preprocess.cell_boxes(_greys(spark, sf, 8))
    return found.select("image", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""
WITH RECURSIVE {_PX}, t(image, y, x, label) AS (SELECT image, y, x, y * 8 + x FROM ins UNION SELECT i.image, i.y, i.x, t.label FROM t JOIN ins i ON i.image = t.image AND abs(i.y - t.y) <= 1 AND abs(i.x - t.x) <= 1),
c AS (SELECT image, y, x, min(label) AS component FROM t GROUP BY image, y, x),
p AS (SELECT image, component, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM c GROUP BY image, component),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(area * (0.35::DOUBLE + 0.65::DOUBLE * (1 - least(1, sqrt((cy - 3.5) ** 2 + (cx - 3.5) ** 2) / (sqrt(128) / 2)))), 9) DESC, component) AS best, row_number() OVER (PARTITION BY image ORDER BY area DESC, component) AS largest, sum(area) OVER (PARTITION BY image) AS total, count(*) OVER (PARTITION BY image) AS n FROM p),
k AS (SELECT image, area, total, n > 1 AND (area / total >= 0.85::DOUBLE OR largest = 1 AND area / total >= 0.72::DOUBLE AND total - area <= 16) AS dominant FROM o WHERE best = 1)
SELECT vec_id AS image, coalesce(CASE WHEN dominant THEN area ELSE total END, 0)::BIGINT AS area, coalesce(dominant, false) AS dominant FROM embeddings LEFT JOIN k ON image = vec_id""")
def raster_dominant(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dominant(_pixels(spark, sf), 4).groupBy("image").agg(F.count_if("in").alias("area"), F.bool_or("dominant").alias("dominant"))


@query(f"""
WITH {_greys_sql(8)}, o AS (SELECT g.image, g.y, g.x, g.v, px.m, CASE WHEN px.m THEN round_even(g.v * 0.6::DOUBLE, 0)::INT ELSE g.v END AS rb, CASE WHEN px.m THEN round_even(g.v * 0.6::DOUBLE + 102::DOUBLE, 0)::INT ELSE g.v END AS gr FROM g JOIN px USING (image, y, x))
SELECT image, sum(rb)::BIGINT AS r, sum(gr)::BIGINT AS g, sum(rb)::BIGINT AS b, count(*) FILTER (NOT m AND (rb <> v OR gr <> v)) AS changed_outside FROM o GROUP BY image""")
def mask_overlays(spark: SparkSession, sf: str) -> DataFrame:
    px = _greys(spark, sf, 8).select("image", "y", "x", "v", *[F.col("v").alias(c) for c in overlays.CHANNELS])
    mask = _pixels(spark, sf).select("image", "y", "x", "in")
    shown = overlays.blended(px, mask).join(px.select("image", "y", "x", "v"), ["image", "y", "x"]).join(mask, ["image", "y", "x"])
    changed = ~F.col("in") & ((F.col("r") != F.col("v")) | (F.col("g") != F.col("v")))
    return shown.groupBy("image").agg(*[F.sum(c).alias(c) for c in overlays.CHANNELS], F.count_if(changed).alias("changed_outside"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
