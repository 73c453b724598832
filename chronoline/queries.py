"""Registered queries of the timeline operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline.functions import expressions as X
from chronoline.operators import evaluation as E
from chronoline.operators import sequence as S
from chronoline.operators import splits as P
from chronoline.operators import stats as A
from chronoline.operators import timeline as T
from chronoline.operators import vocab as V
from chronoline.registry import ORACLE_SQL, QUERIES, register
from chronoline.schema import admissions, predictions, table, timelines, token_scores

#: Common table expressions of the SQL side: the adapters of schema.py.
TL = "tl AS (SELECT user_id AS pid, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS event_idx, event_type AS code, value AS value_num, json_extract_string(props, '$.k') AS value_str, ts AS start, event_id FROM events)"
ADM = "adm AS (SELECT o_custkey AS pid, o_orderkey AS hadm_id, o_orderdate AS start, max(l_shipdate) AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"
DEATH = "death AS (SELECT c_custkey AS pid, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey * 37 % 2500)::INT AS death FROM customer WHERE c_custkey % 3 = 0)"
TS = f"{TL}, ts AS (SELECT pid, event_idx AS token_idx, code AS label, -(0.5 + (event_id * 7919 % 1000) / 250.0::DOUBLE) AS label_log_prob, value_num AS weight FROM tl)"
PR = "pr AS (SELECT doc_id AS pid, quality AS y, 'a' AS model, (doc_id * 7919 + 13) % 1000 / 1000.0::DOUBLE AS p FROM labels UNION ALL SELECT doc_id, quality, 'b', (doc_id * 10007 + 71) % 100 / 100.0::DOUBLE FROM labels)"
VOC = f"""{TL}, cuts AS (SELECT code, quantile_cont(value_num, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q FROM tl WHERE value_num IS NOT NULL GROUP BY code),
    buckets AS (SELECT code, b::INT AS bucket, CASE WHEN b = 0 THEN '-inf'::DOUBLE ELSE q[b + 1] END AS range_start, CASE WHEN b = 9 THEN 'inf'::DOUBLE ELSE q[b + 2] END AS range_end FROM cuts, range(10) r(b))"""
BOOT = """boot AS (SELECT b, x3 % n AS idx, count(*) AS w FROM (
      SELECT i // n AS b, n, (((x1 * x1) % 2147483647 * 69621) + i // n) % 2147483647 AS x3 FROM (
        SELECT i, n, ((i // n * 1000003 + i % n * 7919 + 12345) % 2147483647) * 48271 % 2147483647 AS x1 FROM (SELECT count(*) AS n FROM labels), range(1000 * (SELECT count(*) FROM labels)) r(i))) GROUP BY ALL)"""
HASH = "(((({k}) % 1000003) * 48271 + 0 * 7919 + 11) * 69621 % 2147483647)"


def _finite(c: str) -> F.Column:
    return F.when(F.col(c) == float("inf"), 1e308).when(F.col(c) == float("-inf"), -1e308).otherwise(F.round(c, 6))


@register("SELECT DISTINCT event_type AS code FROM events")
def vocab_unique_codes(spark, d):
    return V.unique_codes(timelines(spark, d))


@register(f"WITH {TL} SELECT DISTINCT code, value_str AS category FROM tl WHERE value_str IS NOT NULL AND value_str <> ''")
def vocab_categorical(spark, d):
    return V.categories(timelines(spark, d))


@register(f"WITH {VOC} SELECT code, 'None' AS unit, bucket, CASE WHEN isinf(range_start) THEN -1e308 ELSE round(range_start, 6) END AS range_start, CASE WHEN isinf(range_end) THEN 1e308 ELSE round(range_end, 6) END AS range_end FROM buckets")
def vocab_numeric_deciles(spark, d):
    return V.numeric_buckets(timelines(spark, d)).select("code", "unit", "bucket", _finite("range_start").alias("range_start"), _finite("range_end").alias("range_end"))


COUNTS = f"{VOC}, tok AS (SELECT pid, event_idx, tl.code, min(bucket) AS bucket FROM tl JOIN buckets b ON b.code = tl.code AND value_num BETWEEN range_start AND range_end GROUP BY ALL)"


@register(f"WITH {COUNTS} SELECT code, bucket, count(*)::BIGINT AS n, count(DISTINCT pid)::BIGINT AS n_patients FROM tok GROUP BY ALL")
def token_counts(spark, d):
    e = timelines(spark, d)
    vocab = V.build(e)
    tokens = V.tokenize(e, vocab).where("token is not null").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("n_patients"))
    return tokens.join(vocab.select("token", "code", "bucket"), "token").select("code", "bucket", "n", "n_patients")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, sf_dir)


@register(f"WITH {COUNTS} SELECT code, bucket, count(*)::BIGINT AS n FROM tok GROUP BY ALL ORDER BY n DESC, code, bucket LIMIT 20")
def vocab_top_k(spark, d):
    counted = token_counts(spark, d).select("code", "bucket", "n", F.format_string("%s/%04d", "code", "bucket").alias("token"))
    return V.top_k(counted, 20).drop("token")


@register("SELECT event_type AS code, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_patients FROM events GROUP BY ALL")
def patients_per_code(spark, d):
    return timelines(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("n_patients"))


@register("SELECT p_type AS code FROM part WHERE lower(split_part(p_type, '/', 1)) NOT IN ('economy', 'promo') GROUP BY 1")
def vocab_excluded(spark, d):
    return V.exclude(table(spark, d, "part").select(F.col("p_type").alias("code")).distinct(), ["Economy", "PROMO"])


@register("WITH c AS (SELECT p_type AS token, count(*)::BIGINT AS n FROM part GROUP BY 1), k AS (SELECT * FROM c WHERE n >= 5 ORDER BY n DESC, token LIMIT 3) SELECT token, n, token IN (SELECT token FROM k) AS kept FROM c")
def vocab_filtered(spark, d):
    vocab = table(spark, d, "part").groupBy(F.col("p_type").alias("token")).agg(F.count("*").alias("n")).withColumn("code", F.col("token"))
    kept, dropped = V.filter_vocab(vocab, [], 5, 3)
    return kept.select("token", "n", F.lit(True).alias("kept")).union(dropped.select("token", "n", F.lit(False)))


@register("""WITH w AS (SELECT p_type AS code, p_size::DOUBLE AS value, count(*) AS c FROM part GROUP BY ALL),
    q AS (SELECT p_type AS code, quantile_cont(p_size::DOUBLE, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q FROM part GROUP BY 1),
    r AS (SELECT code, b::INT AS bucket, CASE WHEN b = 0 THEN '-inf'::DOUBLE WHEN b = 10 THEN q[11] ELSE q[b] END AS lo, CASE WHEN b = 10 THEN 'inf'::DOUBLE ELSE q[b + 1] END AS hi FROM q, range(11) t(b))
    SELECT r.code, bucket, sum(c)::BIGINT AS n FROM r JOIN w ON w.code = r.code AND value BETWEEN lo AND hi GROUP BY ALL""")
def vocab_weighted_deciles(spark, d):
    entries = table(spark, d, "part").groupBy(F.col("p_type").alias("code"), F.col("p_size").cast("double").alias("value")).agg(F.count("*").alias("count"))
    return V.weighted_deciles(entries).select("code", "bucket", "n")


@register("WITH t AS (SELECT DISTINCT p_type AS token FROM part) SELECT token, (row_number() OVER (ORDER BY token) - 1 + 7)::INT AS token_id FROM t")
def vocab_token_ids(spark, d):
    entries = table(spark, d, "part").select(F.col("p_type").alias("token")).distinct().withColumn("entry_idx", F.row_number().over(Window.orderBy("token")) - 1)
    return V.token_ids(entries)


@register("SELECT p_partkey, p_type || ' || None || ' || p_retailprice::VARCHAR || ' - inf' AS token FROM part")
def range_token_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.range_token(F.col("p_type"), F.lit(None).cast("string"), F.col("p_retailprice"), F.lit(float("inf"))).alias("token"))


@register("SELECT user_id AS pid, count(*)::BIGINT AS length, count(DISTINCT event_type)::BIGINT AS n_unique FROM events GROUP BY 1")
def seq_length(spark, d):
    e = timelines(spark, d).withColumn("token", F.col("code"))
    return S.lengths(e.select("pid").distinct(), e).join(e.groupBy("pid").agg(F.count_distinct("token").alias("n_unique")), "pid")


@register("WITH l AS (SELECT user_id AS pid, count(*) AS n FROM events GROUP BY 1) SELECT pid, c::INT AS chunk_idx, (c * 32)::BIGINT AS start, least((c + 1) * 32, n)::BIGINT AS \"end\" FROM l, range(1000) r(c) WHERE c * 32 < n")
def seq_chunks(spark, d):
    return S.chunks(timelines(spark, d).groupBy("pid").agg(F.count("*").alias("length")), 32)


SPLIT = "CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END"


@register(f"SELECT c_custkey, {SPLIT} AS split FROM (SELECT c_custkey, ((c_custkey % 1000003) * 2654435761 % 2147483647 + 97) % 100 AS h FROM customer)")
def split_hash(spark, d):
    return P.hash_split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@register("SELECT c_custkey, CASE WHEN i < 0.8::DOUBLE * n THEN 'train' WHEN i < 0.9::DOUBLE * n THEN 'tuning' ELSE 'held_out' END AS split, i AS idx FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)")
def split_positional(spark, d):
    return P.positional_split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@register("SELECT 0::BIGINT AS n_overlaps")
def split_disjoint(spark, d):
    return P.overlaps(split_hash(spark, d), "c_custkey").agg(F.count("*").alias("n_overlaps"))


@register(f"SELECT c_custkey FROM customer ORDER BY {HASH.format(k='c_custkey')}, c_custkey LIMIT 100")
def seeded_sample(spark, d):
    return P.sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@register(f"SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {HASH.format(k='c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 50")
def capped_sample(spark, d):
    return P.capped_sample(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 50)


@register("SELECT doc_id, regexp_replace(md5(doc_id::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM documents")
def string_uuid(spark, d):
    return table(spark, d, "documents").select("doc_id", X.md5_uuid(F.col("doc_id")).alias("uuid"))


GAPS = f"{TL}, gp AS (SELECT pid, event_idx, code, (epoch_us(start) - lag(epoch_us(start)) OVER (PARTITION BY pid ORDER BY event_idx)) / 1e6 AS seconds FROM tl)"


@register(f"WITH {GAPS} SELECT pid, event_idx, code, round(seconds, 6) AS seconds FROM gp WHERE seconds IS NOT NULL")
def inter_event_times(spark, d):
    return T.gaps(timelines(spark, d)).withColumn("seconds", F.round("seconds", 6))


METRICS = f"{GAPS}, m AS (SELECT pid, stddev_samp(seconds) AS std, avg(seconds) AS mean, quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25) AS iqr FROM gp WHERE seconds IS NOT NULL GROUP BY pid)"


@register(f"WITH {METRICS} SELECT pid, 'std' AS metric, round(std, 3) AS value FROM m UNION ALL SELECT pid, 'mean', round(mean, 3) FROM m UNION ALL SELECT pid, 'iqr', round(iqr, 3) FROM m")
def gap_metrics(spark, d):
    return T.gap_metrics(T.gaps(timelines(spark, d))).withColumn("value", F.round("value", 3))


GRAMS = f"{TL}, l AS (SELECT pid, code AS c0, lead(code, 1) OVER w AS c1, lead(code, 2) OVER w AS c2, lead(code, 3) OVER w AS c3 FROM tl WINDOW w AS (PARTITION BY pid ORDER BY event_idx)), g AS (SELECT pid, 1 AS n, c0 AS ngram FROM l UNION ALL SELECT pid, 2, c0 || '␟' || c1 FROM l WHERE c1 IS NOT NULL UNION ALL SELECT pid, 3, c0 || '␟' || c1 || '␟' || c2 FROM l WHERE c2 IS NOT NULL UNION ALL SELECT pid, 4, c0 || '␟' || c1 || '␟' || c2 || '␟' || c3 FROM l WHERE c3 IS NOT NULL), c AS (SELECT pid, n, ngram, count(*)::BIGINT AS cnt FROM g GROUP BY ALL)"


@register(f"WITH {GRAMS} SELECT * FROM c")
def ngram_counts(spark, d):
    return T.ngram_counts(timelines(spark, d))


@register(f"WITH {GRAMS}, r AS (SELECT pid, n, avg(CASE WHEN cnt > 1 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM c GROUP BY ALL), p AS (SELECT pid, max(r) FILTER (n = 1) AS rr_1, max(r) FILTER (n = 2) AS rr_2, max(r) FILTER (n = 3) AS rr_3, max(r) FILTER (n = 4) AS rr_4 FROM r GROUP BY pid) SELECT *, pow(rr_1 * rr_2 * rr_3 * rr_4, 0.25) AS rr, rr_1 AS ttr FROM p WHERE rr_1 IS NOT NULL AND rr_2 IS NOT NULL AND rr_3 IS NOT NULL AND rr_4 IS NOT NULL")
def repetition_rate(spark, d):
    return T.repetition_rates(T.ngram_counts(timelines(spark, d)))


@register(f"WITH RECURSIVE {TL}, f AS (SELECT * FROM tl), run AS (SELECT a.pid, a.event_idx AS i, b.event_idx AS j, 1 AS len FROM f a JOIN f b ON a.pid = b.pid AND a.event_idx < b.event_idx AND a.code = b.code UNION ALL SELECT r.pid, r.i, r.j, r.len + 1 FROM run r JOIN f a ON a.pid = r.pid AND a.event_idx = r.i + r.len JOIN f b ON b.pid = r.pid AND b.event_idx = r.j + r.len AND a.code = b.code), best AS (SELECT pid, max(len) AS length FROM run GROUP BY pid) SELECT p.pid, coalesce(length, 0)::BIGINT AS length, coalesce((SELECT min(i) FROM run r WHERE r.pid = p.pid AND r.len = best.length), 0)::BIGINT AS start_idx FROM (SELECT DISTINCT pid FROM tl) p LEFT JOIN best ON best.pid = p.pid")
def longest_repeat(spark, d):
    return T.longest_repeat(timelines(spark, d))


LAB = "lab AS (SELECT pid, start AS label_time FROM tl WHERE code = 'signup')"


@register(f"WITH {TL}, {LAB} SELECT l.pid, label_time, count(*)::BIGINT AS n_events, count(DISTINCT code)::BIGINT AS n_unique_events FROM (SELECT DISTINCT pid, label_time FROM lab) l JOIN tl ON tl.pid = l.pid AND start <= label_time GROUP BY ALL")
def timeline_lengths_asof(spark, d):
    e = timelines(spark, d)
    labels = e.where("code = 'signup'").select("pid", F.col("start").alias("label_time"))
    return T.lengths_as_of(e, labels)


@register(f"WITH {TL}, lab AS (SELECT pid, start AS label_time, event_id FROM tl WHERE code = 'purchase'), ft AS (SELECT pid, start AS time, value_num AS value FROM tl WHERE code = 'view') SELECT lab.pid, label_time, event_id, time AS feature_time, value FROM lab ASOF LEFT JOIN ft ON lab.pid = ft.pid AND label_time >= time")
def asof_feature_label(spark, d):
    e = timelines(spark, d)
    return T.asof_join(e.where("code = 'view'").select("pid", F.col("start").alias("time"), F.col("value_num").alias("value")), e.where("code = 'purchase'").select("pid", F.col("start").alias("label_time"), "event_id"))


@register(f"WITH {METRICS}, r AS (SELECT pid, mean, rank() OVER (ORDER BY mean)::DOUBLE AS r FROM m), q AS (SELECT quantile_cont(r, [0.25, 0.5, 0.75]) AS q FROM r) SELECT pid, CASE WHEN r <= q[1] THEN 0 WHEN r <= q[2] THEN 1 WHEN r <= q[3] THEN 2 ELSE 3 END AS quartile FROM r, q")
def metric_quartiles(spark, d):
    m = T.gap_metrics(T.gaps(timelines(spark, d))).where("metric = 'mean'")
    return T.quartiles(m, "value").select("pid", "quartile")


@register("WITH s AS (SELECT event_type AS code, user_id AS pid, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ((user_id % 1000003) * 2654435761 % 2147483647 + 97) % 100 AS h FROM events)) SELECT coalesce(split, 'all') AS split, code, count(*)::BIGINT AS n_events, count(DISTINCT pid)::BIGINT AS n_patients FROM s GROUP BY GROUPING SETS ((split, code), (code))")
def code_count_by_split(spark, d):
    return A.code_counts(P.hash_split(timelines(spark, d), "pid"))


@register("WITH c AS (SELECT split_part(p_name, ' ', 1) AS prefix, p_name, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT prefix, sum(n)::BIGINT AS total, count(*)::BIGINT AS entries FROM c GROUP BY 1) SELECT prefix, total, entries, total / sum(total) OVER () AS share_total, entries / sum(entries) OVER () AS share_entries FROM g")
def vocab_share(spark, d):
    c = table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix"), "p_name").agg(F.count("*").alias("n"))
    return A.shares(c, "prefix")


@register("WITH q AS (SELECT quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS q FROM documents) SELECT unnest([0.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 100.0])::DOUBLE AS percentile, round(unnest(q)::DOUBLE, 6) AS value FROM q")
def length_percentiles(spark, d):
    return A.percentiles(table(spark, d, "documents"), "n_chars", [0, 25, 50, 75, 90, 95, 99, 100]).withColumn("value", F.round("value", 6))


@register("WITH c AS (SELECT n_chars, count(*)::BIGINT AS n FROM documents GROUP BY 1) SELECT n_chars, n, sum(n) OVER (ORDER BY n_chars) / sum(n) OVER ()::DOUBLE AS cdf FROM c")
def length_cdf(spark, d):
    return A.frequency_cdf(table(spark, d, "documents"), "n_chars")


@register("WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents), b AS (SELECT least(floor((n_chars - lo) * 100 / (hi - lo)::DOUBLE), 99)::INT AS bin, count(*)::BIGINT AS n FROM documents, e GROUP BY 1) SELECT bin, n, sum(n) OVER (ORDER BY bin) / sum(n) OVER ()::DOUBLE AS cdf FROM b")
def length_histogram_cdf(spark, d):
    return A.histogram_cdf(table(spark, d, "documents"), "n_chars", 100)


@register("SELECT c::INT AS cut, avg(CASE WHEN n_chars >= c THEN 1.0::DOUBLE ELSE 0 END) AS share FROM documents, (SELECT unnest([512, 768, 1024, 2048, 4096, 8192, 16384]) AS c) GROUP BY c")
def tail_fractions(spark, d):
    return A.tail_shares(table(spark, d, "documents"), "n_chars", [512, 768, 1024, 2048, 4096, 8192, 16384])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("SELECT n_name AS nation, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}')::BIGINT AS \"{s}\"" for s in SEGMENTS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def demographics_crosstab(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "c_mktsegment")
    return A.crosstab(c, "nation", "c_mktsegment", SEGMENTS)


@register("WITH a AS (SELECT o_custkey AS pid, (epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400 * 15 AS days FROM orders GROUP BY 1) SELECT pid, CASE WHEN days <= 7300 THEN 'age_20' WHEN days <= 14600 THEN 'age_40' WHEN days > 14600 AND days < 21900 THEN 'age_60' WHEN days > 21900 AND days < 29200 THEN 'age_80' WHEN days > 29200 THEN 'age_plus' END AS age FROM a")
def demographics_age(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pid")).agg(((F.unix_micros(F.max("o_orderdate").cast("timestamp")) - F.unix_micros(F.min("o_orderdate").cast("timestamp"))) / T.DAY * 15).alias("days"))
    return o.select("pid", A.age_bucket(F.col("days")).alias("age"))


@register("WITH x AS (SELECT l.doc_id AS pid, lang AS task, quality = 1 AS positive FROM labels l JOIN documents d USING (doc_id)) SELECT task, count(DISTINCT pid)::BIGINT AS n_patients, count(DISTINCT CASE WHEN positive THEN pid END)::BIGINT AS n_positive_patients, count(*)::BIGINT AS n_labels, sum(positive::INT)::BIGINT AS n_positive_labels, (count(*) - sum(positive::INT))::BIGINT AS n_negative_labels, sum(positive::INT) / count(*)::DOUBLE AS prevalence FROM x GROUP BY task")
def label_stats(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("pid"), F.col("lang").alias("task"), T.positive(F.col("quality"), "multiclass").alias("positive"))
    return A.label_stats(x, ["task"])


def _deaths(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 = 0")
    return c.select(F.col("c_custkey").alias("pid"), F.timestamp_micros(F.lit(788918400000000) + (F.col("c_custkey") * 37 % 2500) * T.DAY).alias("death"))


LABEL = f"WITH {ADM}, {DEATH}, x AS (SELECT DISTINCT a.pid, start, stop, start + INTERVAL 48 HOUR AS t, coalesce(death, TIMESTAMP '9999-12-31') AS death FROM adm a LEFT JOIN death ON death.pid = a.pid) SELECT pid, t AS prediction_time, {{}} AS label FROM x WHERE t < stop AND t < death"


@register(LABEL.format("death < stop"))
def label_mortality(spark, d):
    return T.in_hospital_mortality(admissions(spark, d), _deaths(spark, d))


@register(LABEL.format("stop - start > INTERVAL 7 DAY"))
def label_long_stay(spark, d):
    return T.long_stay(admissions(spark, d), _deaths(spark, d))


def _visits(spark, d) -> DataFrame:
    """Orders as visits and their lines as events, in one timeline per customer."""
    a = admissions(spark, d)
    visits = a.select("pid", F.col("start").alias("start"), F.col("end"), F.lit(True).alias("is_visit"), F.concat(F.lit("Visit/"), F.col("hadm_id")).alias("token"), F.col("hadm_id").alias("k1"), F.lit(-1).alias("k2"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
    lines = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("pid", F.col("l_shipdate").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit(False).alias("is_visit"), F.concat(F.lit("Part/"), F.col("l_partkey")).alias("token"), F.col("l_orderkey").alias("k1"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("k2"))
    both = visits.withColumn("end", F.col("end").cast("timestamp")).unionByName(lines)
    return both.withColumn("event_idx", F.row_number().over(Window.partitionBy("pid").orderBy("start", F.col("is_visit").desc(), "k1", "k2", "token")))


VISITS = f"""{ADM}, u AS (SELECT pid, start, stop, true AS v, 'Visit/' || hadm_id AS token, hadm_id AS k1, -1 AS k2 FROM adm UNION ALL SELECT o_custkey, l_shipdate, NULL, false, 'Part/' || l_partkey, l_orderkey, l_linenumber * 10000000 + l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    i AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY start, v DESC, k1, k2, token) AS event_idx, v AND start <> stop AS real FROM u),
    s AS (SELECT *, sum(real::INT) OVER (PARTITION BY pid ORDER BY event_idx) AS vs FROM i),
    vis AS (SELECT pid, vs, event_idx, start, stop, lag(stop) OVER (PARTITION BY pid ORDER BY event_idx) AS pend, lead(event_idx) OVER (PARTITION BY pid ORDER BY event_idx) AS nxt FROM s WHERE real),
    cl AS (SELECT vis.pid, vis.vs, vis.nxt, (SELECT min(s.event_idx) FROM s WHERE s.pid = vis.pid AND s.vs = vis.vs AND NOT s.real AND s.start > vis.stop) AS inside FROM vis),
    mx AS (SELECT pid, max(event_idx) AS m FROM s GROUP BY pid),
    tk AS (SELECT pid, coalesce(inside, nxt) AS event_idx, 0 AS k, '[VISIT END]' AS token FROM cl WHERE coalesce(inside, nxt) IS NOT NULL
      UNION ALL SELECT cl.pid, m, 4, '[VISIT END]' FROM cl JOIN mx ON mx.pid = cl.pid WHERE inside IS NULL AND nxt IS NULL
      UNION ALL SELECT pid, event_idx, 1, CASE WHEN g > 1080 THEN '[LONG TERM]' WHEN g = 0 THEN '[DAY 1080]' ELSE '[DAY ' || g || ']' END FROM (SELECT *, floor((epoch_us(start) - epoch_us(pend)) / 86400000000)::BIGINT AS g FROM vis) WHERE g >= 0
      UNION ALL SELECT pid, event_idx, 2, '[VISIT START]' FROM vis
      UNION ALL SELECT pid, event_idx, 3, token FROM s WHERE real OR NOT v)"""


@register(f"WITH {VISITS} SELECT pid, (row_number() OVER (PARTITION BY pid ORDER BY event_idx, k) - 1)::INT AS pos, token FROM tk")
def visit_att_tokens(spark, d):
    return V.visit_tokens(_visits(spark, d)).select("pid", "pos", "token")


def _ids(spark, d) -> DataFrame:
    """Timelines as ids: the five codes in order from 7."""
    ids = F.create_map(*(F.lit(x) for i, c in enumerate(["click", "error", "purchase", "signup", "view"]) for x in (c, 7 + i)))
    return timelines(spark, d).withColumn("token_id", ids[F.col("code")])


IDS = f"{TL}, ids AS (SELECT pid, event_idx, 7 + list_position(['click', 'error', 'purchase', 'signup', 'view'], code) - 1 AS token_id FROM tl), sq AS (SELECT pid, list(token_id ORDER BY event_idx) AS x FROM ids GROUP BY pid)"


@register(f"WITH {IDS} SELECT pid, array_to_string(list_concat(list_transform(range(greatest(64 - len(x), 0)), lambda i: 4), x[greatest(len(x) - 63, 1):]), ' ') AS ids FROM sq")
def left_pad_last_chunk(spark, d):
    return S.sequences(_ids(spark, d)).select("pid", F.array_join(S.last_chunk(F.col("ids"), 64), " ").alias("ids"))


@register(f"WITH {IDS}, f AS (SELECT pid, list_concat([5, 0], x, [1]) AS x FROM sq) SELECT pid, array_to_string(list_concat(x[1:48], list_transform(range(greatest(48 - len(x), 0)), lambda i: 4)), ' ') AS ids, least(len(x), 48)::INT AS n_real FROM f")
def padded_inputs(spark, d):
    ids = S.right_pad(S.with_specials(F.col("ids")), 48)
    return S.sequences(_ids(spark, d)).select("pid", ids.alias("x")).select("pid", F.array_join("x", " ").alias("ids"), F.aggregate(S.attention_mask(F.col("x")), F.lit(0), lambda s, x: s + x).alias("n_real"))


DRAW = "((((pid * 4099 + event_idx * 31 + {}) % 1000003) * 48271 + 0 * 7919 + 11) * 69621 % 2147483647) % 10000"


@register(f"WITH {IDS}, r AS (SELECT *, token_id > 6 AND {DRAW.format(1)} < 1500 AS c, {DRAW.format(2)} AS d2, 7 + {DRAW.format(3)} * 0 + (((((pid * 4099 + event_idx * 31 + 3) % 1000003) * 48271 + 11) * 69621 % 2147483647) % 5) AS o FROM ids) SELECT pid, event_idx AS pos, (CASE WHEN c AND d2 < 8000 THEN 6 WHEN c AND d2 < 9000 THEN o ELSE token_id END)::INT AS input_id, (CASE WHEN c THEN token_id ELSE -100 END)::INT AS label FROM r")
def mask_mlm(spark, d):
    return S.mask_tokens(_ids(spark, d).withColumnRenamed("event_idx", "pos"), 12)


@register(f"WITH {IDS}, r AS (SELECT pid, x, {HASH.format(k='pid')} % greatest(len(x) - 16 + 1, 1) AS s FROM sq) SELECT pid, array_to_string(x[s + 1:s + 16], ' ') AS ids FROM r")
def random_truncate(spark, d):
    return S.sequences(_ids(spark, d)).select("pid", F.array_join(S.random_cut(F.col("ids"), F.col("pid"), 16), " ").alias("ids"))


@register("WITH l AS (SELECT doc_id AS pid, n_chars AS n FROM documents WHERE n_chars >= 2), w AS (SELECT pid, n, a, least(a + 512, n) AS e FROM l, range(0, 1000000, 256) r(a) WHERE a < n), p AS (SELECT *, lag(e) OVER (PARTITION BY pid ORDER BY a) AS prev FROM w) SELECT pid, greatest(least(a, e - 512), 0)::BIGINT AS begin, e::BIGINT AS \"end\", (e - coalesce(prev, 1))::BIGINT AS n_targets FROM p WHERE prev IS NULL OR prev < n")
def stride_windows(spark, d):
    return S.stride_windows(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("n_chars").alias("length")), 512, 256)


@register("SELECT doc_id AS pid, n_chars AS length, r AS rank, r // 64 AS bucket FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents)")
def sortish_buckets(spark, d):
    return S.sortish_buckets(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("n_chars").alias("length")), 64)


@register("""WITH RECURSIVE o AS (SELECT lang AS split, least(n_chars, 4096) AS size, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents),
    f AS (SELECT split, rank, 0::BIGINT AS b, 1::BIGINT AS n, size AS m FROM o WHERE rank = 0
      UNION ALL SELECT o.split, o.rank, CASE WHEN (f.n + 1) * greatest(m, size) > 16384 THEN b + 1 ELSE b END, CASE WHEN (f.n + 1) * greatest(m, size) > 16384 THEN 1 ELSE n + 1 END, CASE WHEN (f.n + 1) * greatest(m, size) > 16384 THEN size ELSE greatest(m, size) END
      FROM f JOIN o ON o.split = f.split AND o.rank = f.rank + 1)
    SELECT split, rank, b AS batch_idx FROM f""")
def greedy_batches(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("split"), "doc_id", F.col("n_chars").alias("length"))
    ranked = docs.withColumn("rank", (F.row_number().over(Window.partitionBy("split").orderBy(F.col("length").desc(), "doc_id")) - 1).cast("long"))
    return S.batches(ranked, 16384, 4096)


PPL = f"WITH {TS} SELECT count(*)::BIGINT AS n_tokens, exp(-avg(label_log_prob)) AS ppl, avg(label_log_prob) AS mean_log_prob, median(label_log_prob) AS median_log_prob, stddev_pop(label_log_prob) AS std_log_prob, avg(exp(label_log_prob)) AS mean_prob, median(exp(label_log_prob)) AS median_prob, stddev_pop(exp(label_log_prob)) AS std_prob FROM ts"


@register(PPL)
def ppl_summary(spark, d):
    return A.perplexity(token_scores(spark, d))


POS = f"{TS}, x AS (SELECT token_idx, exp(-label_log_prob) AS ppl FROM ts), c AS (SELECT token_idx, count(*) AS n, list(ppl ORDER BY ppl) AS l, median(ppl) AS median FROM x GROUP BY 1 HAVING count(*) >= 30), ps AS (SELECT token_idx, n::BIGINT AS n, median, l[greatest(0, floor(0.5 * n - 1.96 * sqrt(n) / 2))::BIGINT + 1] AS lower, l[least(n - 1, ceil(0.5 * n + 1.96 * sqrt(n) / 2))::BIGINT + 1] AS upper FROM c)"


def _position_medians(spark, d):
    return A.position_medians(token_scores(spark, d).withColumn("ppl", F.exp(-F.col("label_log_prob"))))


@register(f"WITH {POS} SELECT * FROM ps")
def ppl_by_position(spark, d):
    return _position_medians(spark, d)


@register(f"WITH RECURSIVE {POS}, o AS (SELECT token_idx, median, row_number() OVER (ORDER BY token_idx) AS r FROM ps), e AS (SELECT token_idx, r, median, median AS ema FROM o WHERE r = 1 UNION ALL SELECT o.token_idx, o.r, o.median, 2.0 / 21 * o.median + (1 - 2.0 / 21) * e.ema FROM e JOIN o ON o.r = e.r + 1) SELECT token_idx, median, ema FROM e")
def ppl_ema(spark, d):
    return A.ema(_position_medians(spark, d), "median")


@register(f"WITH {TS} SELECT token_idx, count(DISTINCT label) / count(*)::DOUBLE AS diversity, count(*)::BIGINT AS n FROM ts GROUP BY 1")
def token_diversity(spark, d):
    return A.token_diversity(token_scores(spark, d))


@register(f"WITH {TS} SELECT pid, exp(-avg(label_log_prob) FILTER (token_idx BETWEEN 0 AND 32)) AS ppl FROM ts GROUP BY pid HAVING count(*) >= 32")
def span_ppl(spark, d):
    return A.span_perplexity(token_scores(spark, d), 32, 0, 32)


@register("SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS loss, least(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 100) AS ppl FROM lineitem GROUP BY 1")
def weighted_loss(spark, d):
    return A.weighted_loss(table(spark, d, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"])


@register(f"WITH {TL}, r AS (SELECT pid, event_idx, sum(round(value_num * 100)::BIGINT) OVER (PARTITION BY pid ORDER BY event_idx)::BIGINT AS total FROM tl), c AS (SELECT *, coalesce(lag(total // 100000) OVER (PARTITION BY pid ORDER BY event_idx), 0) AS b FROM r) SELECT pid, event_idx, total, (total // 100000 * 100000)::BIGINT AS crossed FROM c WHERE total // 100000 > b")
def checkpoint_crossings(spark, d):
    e = timelines(spark, d).withColumn("v", F.round(F.col("value_num") * 100).cast("long"))
    return A.crossings(e, "pid", "event_idx", "v", 100000).withColumn("crossed", F.col("crossed").cast("long"))


def _draws(spark, d, n: int = 1000) -> DataFrame:
    """(model, b, y, p): the draws of the reference's 1,000 replicates; a person's rows, one a model, join a draw as one row."""
    people = P.dense_index(predictions(spark, d).groupBy("pid").agg(F.collect_list(F.struct("model", "y", "p")).alias("rows")), "pid").select("idx", "rows")
    draws = E.bootstrap_draws(spark, people.count(), n)
    return draws.join(people, "idx").select("b", F.inline("rows"))


def _replicates(spark, d, n: int = 1000) -> DataFrame:
    """(model, b, y, p, w) of the replicates: draws are summed for each score before they are shuffled."""
    return _draws(spark, d, n).groupBy("model", "b", "y", "p").agg(F.count("*").alias("w"))


REP = f"{PR}, people AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS idx FROM (SELECT DISTINCT pid FROM pr)), {BOOT}, rep AS (SELECT pr.*, b, w FROM pr JOIN people USING (pid) JOIN boot USING (idx))"
AUC = f"{REP}, ag AS (SELECT model, b, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM rep GROUP BY ALL), ah AS (SELECT *, sum(neg) OVER (PARTITION BY model, b ORDER BY p) - neg AS below FROM ag), au AS (SELECT model, b, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg))::DOUBLE AS auroc FROM ah GROUP BY ALL)"


@register(f"WITH {AUC} SELECT model, b, round(auroc, 9) AS auroc FROM au")
def auroc_weighted(spark, d):
    return E.auroc(_replicates(spark, d), ["model", "b"]).withColumn("auroc", F.round("auroc", 9))


@register(f"WITH {REP}, br AS (SELECT model, b, sum(w * (y - p) * (y - p)) / sum(w) AS brier FROM rep GROUP BY ALL), q AS (SELECT model, avg(brier) AS mean, quantile_cont(brier, [0.025, 0.5, 0.975]) AS q FROM br GROUP BY 1) SELECT model, round(mean, 9) AS mean, round(q[1], 9) AS lower, round(q[2], 9) AS median, round(q[3], 9) AS upper, q[1] > 0 OR q[3] < 0 AS significant, q[1] > 0 AND q[3] > 0 AS wins FROM q")
def bootstrap_ci_brier(spark, d):
    # a sum over draws needs no scores to be told apart: one aggregation, a row a replicate and model is shuffled
    out = E.interval(E.brier(_draws(spark, d).withColumn("w", F.lit(1)), ["model", "b"]), ["model"], "brier")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "lower", "median", "upper")})


@register(f"WITH {AUC}, dl AS (SELECT x.b, x.model, x.auroc - z.auroc AS delta FROM au x JOIN au z ON z.b = x.b AND z.model = 'b' WHERE x.model <> 'b'), q AS (SELECT model, avg(delta) AS mean, quantile_cont(delta, [0.025, 0.5, 0.975]) AS q FROM dl GROUP BY 1) SELECT model, round(mean, 9) AS mean, round(q[1], 9) AS lower, round(q[2], 9) AS median, round(q[3], 9) AS upper, q[1] > 0 OR q[3] < 0 AS significant, q[1] > 0 AND q[3] > 0 AS wins FROM q")
def auroc_delta_ci(spark, d):
    out = E.interval(E.delta(E.auroc(_replicates(spark, d), ["model", "b"]), ["b"], "model", "b", "auroc"), ["model"], "delta")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "lower", "median", "upper")})


@register(f"WITH {AUC}, dl AS (SELECT x.model, sign(x.auroc - z.auroc) AS s FROM au x JOIN au z ON z.b = x.b AND z.model = 'b' WHERE x.model <> 'b') SELECT model, avg(s) AS win_rate FROM dl GROUP BY 1")
def win_rate(spark, d):
    return E.win_rate(E.delta(E.auroc(_replicates(spark, d), ["model", "b"]), ["b"], "model", "b", "auroc"), ["model"])


@register(f"WITH {REP}, g AS (SELECT model, b, p, sum(w) AS w FROM rep GROUP BY ALL), c AS (SELECT *, (sum(w) OVER (PARTITION BY model, b ORDER BY p) - 0.5 * w) / sum(w) OVER (PARTITION BY model, b)::DOUBLE AS m FROM g), n AS (SELECT *, lead(m) OVER o AS m2, lead(p) OVER o AS p2, row_number() OVER o = 1 AS f FROM c WINDOW o AS (PARTITION BY model, b ORDER BY p)) SELECT model, b, q, round(CASE WHEN q < m OR m2 IS NULL THEN p ELSE p + (q - m) / (m2 - m) * (p2 - p) END, 9) AS cut FROM n, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q) WHERE (m <= q AND (q < m2 OR m2 IS NULL)) OR (f AND q < m)")
def weighted_quartile_cuts(spark, d):
    return E.weighted_quantiles(_replicates(spark, d), ["model", "b"], "p", "w", [0.25, 0.5, 0.75]).withColumn("cut", F.round("cut", 9))


def _prices(spark, d) -> DataFrame:
    """Mean price per part type (task) and brand family."""
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_type").alias("task"), F.col("p_brand").alias("family")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))


PRICES = "v AS (SELECT p_type AS task, p_brand AS family, round(avg(p_retailprice), 6) AS value FROM part GROUP BY ALL)"


@register(f"WITH {PRICES} SELECT *, rank() OVER (PARTITION BY task ORDER BY value DESC)::INT AS rank FROM v")
def family_rank(spark, d):
    return A.rank_within(_prices(spark, d), "task", "value")


@register(f"WITH {PRICES}, m AS (SELECT family, avg(value) AS a FROM v GROUP BY 1), b AS (SELECT arg_max(family, a) AS f FROM m), x AS (SELECT v.task, v.family, v.value - z.value AS delta FROM v JOIN v z ON z.task = v.task AND z.family = (SELECT f FROM b) WHERE v.family <> z.family) SELECT family, round(avg(delta), 6) AS mean_delta, sum((delta > 0)::INT)::BIGINT AS wins FROM x GROUP BY 1")
def best_baseline_delta(spark, d):
    v = _prices(spark, d)
    best = v.groupBy("family").agg(F.avg("value").alias("a")).agg(F.max_by("family", "a").alias("best"))
    base = v.join(F.broadcast(best), F.col("family") == F.col("best")).select("task", F.col("value").alias("base"), "best")
    x = v.join(base, "task").where("family <> best").withColumn("delta", F.col("value") - F.col("base"))
    return x.groupBy("family").agg(F.round(F.avg("delta"), 6).alias("mean_delta"), F.sum((F.col("delta") > 0).cast("long")).alias("wins"))


@register(f"WITH {PRICES}, f AS (SELECT task, family, value FROM v), a AS (SELECT DISTINCT task FROM f), b AS (SELECT DISTINCT family FROM f) SELECT a.task, b.family, f.value FROM a CROSS JOIN b LEFT JOIN f ON f.task = a.task AND f.family = b.family")
def densified_results(spark, d):
    return A.densify(_prices(spark, d), "task", "family", "value", "value")


@register("WITH i AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS a FROM customer GROUP BY ALL) SELECT c_mktsegment, round(avg(a), 6) AS c_acctbal FROM i GROUP BY 1")
def macro_average(spark, d):
    return A.macro_mean(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], ["c_mktsegment"], "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 6))


@register("SELECT o_custkey, max(o_totalprice) AS best_value, arg_max(o_orderkey, o_totalprice) AS best_order FROM orders GROUP BY 1")
def max_checkpoint(spark, d):
    # of equal prices the least key, the first in the table, which arg_max takes; rows without a key or price are none of them
    rank = F.when(F.col("o_orderkey").isNotNull() & F.col("o_totalprice").isNotNull(), F.struct("o_totalprice", F.bitwise_not("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best_value"), F.max_by("o_orderkey", rank).alias("best_order"))


@register("WITH l AS (SELECT CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split, length, n_unique FROM (SELECT ((user_id % 1000003) * 2654435761 % 2147483647 + 97) % 100 AS h, count(*) AS length, count(DISTINCT event_type) AS n_unique FROM events GROUP BY user_id)) SELECT split, count(*)::BIGINT AS n_patients, " + ", ".join(f"min({c})::BIGINT AS min_{c}, round(avg({c}), 2) AS mean_{c}, median({c}) AS median_{c}, max({c})::BIGINT AS max_{c}" for c in ("length", "n_unique")) + " FROM l GROUP BY split")
def dataset_stats(spark, d):
    return A.high_level(P.hash_split(seq_length(spark, d), "pid"), "split")


@register(f"WITH {ADM} SELECT pid, count(*)::BIGINT AS n_events, count(DISTINCT hadm_id)::BIGINT AS n_visits, (epoch_us(max(start)) - epoch_us(min(start))) / 86400000000::DOUBLE AS span_days FROM adm GROUP BY pid")
def visit_spans(spark, d):
    return T.spans(admissions(spark, d).withColumnRenamed("hadm_id", "visit_id"))


@register()
def welch_test(spark, d):
    return E.welch(table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").withColumn("all", F.lit(1)), ["all"], "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal")


@register("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE []::VARCHAR[] END) AS g FROM w) SELECT doc_id, count(*)::BIGINT AS n_bigrams, count(DISTINCT g)::BIGINT AS n_distinct FROM g GROUP BY 1")
def text_bigrams(spark, d):
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")
    grams = F.transform(X.ngrams(F.col("w"), 2), lambda g: F.array_join(g, " "))
    out = table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", grams.alias("g"))
    return out.select("doc_id", F.size("g").cast("long").alias("n_bigrams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct")).where("n_bigrams > 0")


@register("WITH p AS (SELECT user_id AS pid FROM events GROUP BY 1 HAVING count(*) >= 20) SELECT event_id FROM events WHERE user_id IN (SELECT pid FROM p)")
def min_length_patients(spark, d):
    e = timelines(spark, d)
    long = e.groupBy("pid").agg(F.count("*").alias("n")).where("n >= 20")
    return e.join(long, "pid", "left_semi").select("event_id")


@register("SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'Q1' WHEN s_acctbal <= 5000 THEN 'Q2' WHEN s_acctbal <= 9000 THEN 'Q3' ELSE 'Q0' END AS q, CASE WHEN s_acctbal BETWEEN -1000 AND 1000 THEN 'R1' WHEN s_acctbal BETWEEN 1000 AND 5000 THEN 'R2' ELSE 'R0' END AS r FROM supplier")
def lab_remaps(spark, d):
    v = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", X.remap_quantile(v, [0, 5000, 9000]).alias("q"), X.remap_range(v, [(-1000, 1000), (1000, 5000)]).alias("r"))


import chronoline.more_queries  # noqa: E402,F401  registers the rest
