"""More registered queries: vocabulary builds, encodings, model inputs, labels and tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline import catalog as C
from chronoline.functions import expressions as X
from chronoline.operators import evaluation as E
from chronoline.operators import results as R
from chronoline.operators import sequence as S
from chronoline.operators import splits as P
from chronoline.operators import stats as A
from chronoline.operators import timeline as T
from chronoline.operators import vocab as V
from chronoline.registry import register
from chronoline.schema import admissions, table, timelines, token_scores

CODES = ["click", "error", "purchase", "signup", "view"]
TEXTS = {"click": "a click", "purchase": "goods  were bought", "view": "seen"}
TL = "tl AS (SELECT user_id AS pid, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS event_idx, event_type AS code, value AS value_num, ts AS start, event_id FROM events)"
HASH = "(((({k}) % 1000003) * 48271 + {s} * 7919 + 11) * 69621 % 2147483647)"
IDS = f"{TL}, sq AS (SELECT pid, list(7 + list_position({CODES}, code) - 1 ORDER BY event_idx) AS x FROM tl GROUP BY pid)"


def _ids(spark, d) -> DataFrame:
    ids = F.create_map(*(F.lit(x) for i, c in enumerate(CODES) for x in (c, 7 + i)))
    return timelines(spark, d).withColumn("token_id", ids[F.col("code")])


def _prices(spark, d) -> DataFrame:
    """Parts as results: the type is the task, the brand the model, with an interval."""
    v = F.col("p_retailprice").cast("double")
    return table(spark, d, "part").select(F.col("p_type").alias("task"), F.col("p_brand").alias("model"), F.col("p_size").alias("size"), v.alias("value"), (v - F.col("p_size")).alias("lower"), (v + F.col("p_size")).alias("upper"))


PRICES = "v AS (SELECT p_type AS task, p_brand AS model, p_size AS size, p_retailprice::DOUBLE AS value, p_retailprice::DOUBLE - p_size AS lower, p_retailprice::DOUBLE + p_size AS upper FROM part)"


# --- vocabulary
@register("SELECT event_type AS code, count(*)::BIGINT AS n, 'count_occurrences' AS kind, 'train' AS split FROM events GROUP BY 1 UNION ALL SELECT 'never', NULL, NULL, NULL")
def vocab_counts_attached(spark, d):
    events = timelines(spark, d)
    entries = V.unique_codes(events).union(spark.createDataFrame([("never",)], "code string")).withColumn("token", F.col("code"))
    counted = C.attach_counts(entries, events.groupBy(F.col("code").alias("token")).agg(F.count("*").alias("n")), "events", "train")
    one = V.first_stat(F.col("stats"), "count_occurrences")
    return counted.select("code", one["count"].alias("n"), one["type"].alias("kind"), one["split"].alias("split"))


@register("SELECT n_name AS code, r_name AS description FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey")
def vocab_described(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").where("r_name <> 'ASIA'")
    texts = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("code"), F.col("r_name").alias("description"))
    return V.describe(n.select(F.col("n_name").alias("code")), texts)


@register("SELECT p_type AS code, p_brand AS unit FROM part WHERE p_size < 10 GROUP BY ALL UNION ALL SELECT p_type, p_brand FROM part WHERE p_size >= 10 AND (p_type, p_brand) NOT IN (SELECT (p_type, p_brand) FROM part WHERE p_size < 10) GROUP BY ALL")
def vocab_extended(spark, d):
    part = table(spark, d, "part").select(F.col("p_type").alias("code"), F.col("p_brand").alias("unit"), "p_size")
    return V.extend(part.where("p_size < 10").drop("p_size").distinct(), part.where("p_size >= 10").drop("p_size").distinct(), ["code", "unit"])


@register("SELECT code, code || ' || ' || category AS token FROM (SELECT DISTINCT event_type AS code, json_extract_string(props, '$.k') AS category FROM events) WHERE category <> ''")
def vocab_category_entries(spark, d):
    return V.categorical_entries(timelines(spark, d)).select("code", "token")


@register("SELECT i::INT AS entry_idx, CASE WHEN i = 0 THEN '[VISIT START]' WHEN i = 1 THEN '[VISIT END]' WHEN i < 8 THEN '[DAY ' || (i - 1) || ']' WHEN i < 12 THEN '[WEEK ' || (i - 7) || ']' WHEN i < 24 THEN '[MONTH ' || (i - 11) || ']' ELSE '[LONG TERM]' END AS token FROM range(25) r(i)")
def visit_time_dictionary(spark, d):
    return C.visit_time_entries(spark).select("entry_idx", "token")


@register("WITH e AS (SELECT p_type AS code, CASE WHEN p_size < 3 THEN NULL ELSE p_size END AS lo, CASE WHEN p_size > 40 THEN p_size - 1 ELSE 45 END AS hi FROM part) SELECT 'no range' AS problem, count(*)::BIGINT AS n FROM e WHERE lo IS NULL OR lo > hi HAVING count(*) > 0 UNION ALL SELECT 'excluded vocabulary', count(*) FROM part WHERE lower(split_part(p_type, '/', 1)) = 'economy' HAVING count(*) > 0")
def vocab_problems(spark, d):
    size = F.col("p_size").cast("double")
    entries = table(spark, d, "part").select(F.col("p_type").alias("code"), F.lit("numerical_range").alias("type"), F.when(size >= 3, size).alias("range_start"), F.when(size > 40, size - 1).otherwise(45.0).alias("range_end"))
    return C.problems(entries, ["Economy"])


@register("SELECT 'ATT' AS prefix, count(*)::BIGINT AS n, count(*) / (SELECT 2 * count(*) FROM events)::DOUBLE AS share FROM events UNION ALL SELECT event_type, count(*), count(*) / (SELECT 2 * count(*) FROM events)::DOUBLE FROM events GROUP BY 1")
def vocabulary_shares(spark, d):
    codes = timelines(spark, d).select(F.concat("code", F.lit("/x")).alias("token"))
    return A.vocabulary_shares(codes.union(codes.select(F.lit("[DAY 3]"))))


@register("WITH g AS (SELECT p_brand, sum(p_size)::BIGINT AS total, count(*)::BIGINT AS entries FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1) SELECT p_brand, total, entries, total / sum(total) OVER ()::DOUBLE AS share_total, entries / sum(entries) OVER ()::DOUBLE AS share_entries FROM g")
def shares_without(spark, d):
    return A.shares_without(table(spark, d, "part"), "p_brand", ["Brand#1", "Brand#2"], "p_size")


# --- events to tokens and ids
@register(f"WITH {TL} SELECT pid, (row_number() OVER (PARTITION BY pid ORDER BY event_idx) - 1)::INT AS pos, event_idx, code AS token FROM tl WHERE code <> 'error'")
def event_tokens(spark, d):
    return V.token_events(timelines(spark, d).withColumn("token", F.when(F.col("code") != "error", F.col("code"))))


@register("SELECT count(*) FILTER (event_type <> 'error')::BIGINT AS with_token, count(*) FILTER (event_type = 'error')::BIGINT AS without FROM events")
def tokenizable_events(spark, d):
    has, lacks = V.tokenizable(timelines(spark, d).withColumn("token", F.when(F.col("code") != "error", F.col("code"))))
    return has.agg(F.count("*").alias("with_token")).crossJoin(lacks.agg(F.count("*").alias("without")))


@register("SELECT count(*) FILTER (event_type IN ('click', 'view') AND value IS NOT NULL)::BIGINT AS numeric, count(*) FILTER (json_extract_string(props, '$.k') <> '')::BIGINT AS textual FROM events")
def typed_events(spark, d):
    e = timelines(spark, d)
    n = F.when(F.col("code").isin("click", "view"), F.col("value_num"))
    return e.agg(F.count_if(V.is_numeric(n)).alias("numeric"), F.count_if(V.is_textual(F.col("value_str"))).alias("textual"))


@register(f"WITH {TL}, t AS (SELECT pid, event_idx, CASE code WHEN 'click' THEN 'a click' WHEN 'purchase' THEN 'goods  were bought' WHEN 'view' THEN 'seen' END AS t, CASE code WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 0 END AS w FROM tl) SELECT pid, coalesce(string_agg(t, ' ' ORDER BY event_idx), '') AS text, sum(w)::INT AS n_words FROM t GROUP BY pid")
def description_texts(spark, d):
    rows = [(i, c, t) for i, (c, t) in enumerate([("click", "overwritten"), *TEXTS.items(), ("view", None)])]
    vocab = spark.createDataFrame(rows, "entry_idx int, code string, description string")
    return V.description_texts(V.describe_events(timelines(spark, d), vocab)).select("pid", "text", F.size("words").alias("n_words"))


@register(f"SELECT token, token_id::INT AS token_id FROM (SELECT unnest({V.SPECIALS}) AS token, unnest(range(7)) AS token_id) UNION ALL SELECT unnest({CODES}), unnest([12, 8, 9, 10, 11])::INT")
def special_and_entry_ids(spark, d):
    entries = spark.createDataFrame(list(enumerate([*CODES, "click"])), "entry_idx int, token string")  # click stands twice: its last id counts
    return V.special_entries(entries)


@register(f"WITH {TL} SELECT event_id, CASE WHEN code = 'error' THEN 2 ELSE 7 + list_position({CODES}, code) - 1 END::INT AS token_id FROM tl")
def encoded_events(spark, d):
    ids = V.token_ids(spark.createDataFrame(list(enumerate(CODES)), "entry_idx int, token string")).where("token <> 'error'")
    return V.ids_of(timelines(spark, d).withColumn("token", F.col("code")), ids, required=False).select("event_id", "token_id")


# --- model inputs
@register(f"WITH {IDS}, b AS (SELECT pid, pid % 10 AS batch, CASE WHEN pid % 7 = 0 THEN []::BIGINT[] ELSE x END AS x FROM sq), w AS (SELECT *, max(least(len(x), 60)) OVER (PARTITION BY batch) AS longest FROM b), p AS (SELECT pid, batch, list_concat(x[1:least(len(x), 60)], list_transform(range(longest - least(len(x), 60)), lambda i: 4)) AS i FROM w) SELECT pid, batch, array_to_string(i, ' ') AS input_ids, array_to_string(i, ' ') AS labels, array_to_string(list_transform(i, lambda z: (z <> 4)::INT), ' ') AS attention_mask, len(i)::INT AS n_types FROM p")
def collated_inputs(spark, d):
    rows = S.sequences(_ids(spark, d)).select("pid", (F.col("pid") % 10).alias("batch"), F.when(F.col("pid") % 7 == 0, F.array().cast("array<int>")).otherwise(F.col("ids")).alias("ids"))
    text = lambda c: F.array_join(c, " ").alias(c)
    return S.collate(rows, ["batch"], context=60).select("pid", "batch", text("input_ids"), text("labels"), text("attention_mask"), F.size("token_type_ids").alias("n_types"))


@register(f"WITH {IDS} SELECT pid, len(list_distinct(list_filter(x, lambda i: i <> 4)))::INT AS n_distinct, 2 * len(x)::INT AS n_flat FROM sq")
def distinct_and_flat(spark, d):
    return S.sequences(_ids(spark, d)).select("pid", S.distinct_tokens(F.concat("ids", F.array(F.lit(S.PAD)))).alias("n_distinct"), F.size(S.flattened(F.array("ids", "ids"))).alias("n_flat"))


@register("SELECT doc_id AS pid, n_chars AS length, r AS rank, r // 64 AS bucket FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, lang, doc_id) - 1 AS r FROM documents)")
def sortish_second_key(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("n_chars").alias("length"), "lang")
    return S.sortish_buckets(docs, 64, second="lang")


@register(f"WITH r AS (SELECT doc_id AS pid, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), b AS (SELECT r // 64 AS bucket, count(*) AS n FROM r GROUP BY 1), p AS (SELECT bucket, row_number() OVER (ORDER BY n < 64, {HASH.format(k='bucket', s=0)}, bucket) - 1 AS place FROM b) SELECT pid, place * 64 + row_number() OVER (PARTITION BY r // 64 ORDER BY {HASH.format(k='pid', s=0)}, pid) - 1 AS rank, place AS bucket FROM r JOIN p ON p.bucket = r // 64")
def shuffled_buckets(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("n_chars").alias("length"))
    return S.shuffled(S.sortish_buckets(docs, 64), 64, within=True, across=True).select("pid", "rank", "bucket")


@register()
def loader_batches(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("n_chars").alias("length"))
    return S.loader(docs, "train", 16_384, 4_096, 64)


@register("SELECT dim::INT AS dim, avg(v) AS mean FROM (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY 1")
def pooled_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.lit(1).alias("k"), "vec_id", F.when(F.col("vec_id") % 5 == 0, S.PAD).otherwise(9).alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    one = e.select(F.lit(1).alias("k"), F.array("i").alias("ids"), F.array("v").alias("vectors"))
    return S.pooled(one, "k", "ids", "vectors").select("dim", F.col("value").alias("mean"))


# --- splits
SPLIT = "CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END"
SPLITS = f"sp AS (SELECT c_custkey, {SPLIT} AS split FROM (SELECT c_custkey, ((c_custkey % 1000003) * 2654435761 % 2147483647 + 97) % 100 AS h FROM customer))"


def _splits(spark, d) -> DataFrame:
    return P.hash_split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@register(f"WITH {SPLITS} SELECT c_custkey, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c_custkey) AS r FROM sp) WHERE r <= 100")
def split_debug_limit(spark, d):
    return P.debug_limit(_splits(spark, d), "c_custkey", 100)


@register(f"WITH {SPLITS} SELECT o_orderkey, split FROM orders JOIN sp ON o_custkey = c_custkey WHERE split <> 'val'")
def rows_of_splits(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return P.rows_of_splits(orders, _splits(spark, d).where("split <> 'val'"), "c_custkey").select("o_orderkey", "split")


@register("SELECT c_custkey, idx FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) WHERE idx >= 10 AND idx < 200")
def split_index_slice(spark, d):
    return P.index_slice(table(spark, d, "customer").select("c_custkey"), "c_custkey", 10, 200)


@register(f"WITH {SPLITS} SELECT c_custkey, 2::BIGINT AS n_splits FROM sp WHERE c_custkey % 50 = 0 AND split <> 'test'")
def split_overlaps(spark, d):
    splits = _splits(spark, d)
    return P.overlaps(splits.union(splits.where("c_custkey % 50 = 0").select("c_custkey", F.lit("test"))), "c_custkey")


# --- statistics
@register(f"WITH {TL}, f AS (SELECT pid, arg_min(code, event_idx) FILTER (code IN ('click', 'view')) AS s, arg_min(code, event_idx) FILTER (code = 'signup') AS e, (epoch_us(max(start)) - epoch_us(min(start))) / 86400000000::DOUBLE * 400 AS days FROM tl GROUP BY pid) SELECT pid, CASE WHEN days <= 7300 THEN 'age_20' WHEN days <= 14600 THEN 'age_40' WHEN days > 14600 AND days < 21900 THEN 'age_60' WHEN days > 21900 AND days < 29200 THEN 'age_80' WHEN days > 29200 THEN 'age_plus' END AS age, CASE s WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'unknown' END AS sex, CASE WHEN e IS NOT NULL THEN 'S' END AS ethnicity FROM f")
def demographics(spark, d):
    e = timelines(spark, d)
    first = e.groupBy("pid").agg(F.min("start").alias("f"))
    stretched = e.join(first, "pid").withColumn("start", F.timestamp_micros(F.unix_micros(F.col("f").cast("timestamp")) + (F.unix_micros("start") - F.unix_micros(F.col("f").cast("timestamp"))) * 400))
    return A.demographics(stretched, {"sex": {"click": "C", "view": "V"}, "ethnicity": {"signup": "S"}})


@register("WITH l AS (SELECT l.doc_id AS pid, quality = 1 AS p, lang, CASE WHEN l.doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM labels l JOIN documents d ON d.doc_id = l.doc_id), x AS (SELECT * FROM l UNION ALL SELECT pid, p, lang, 'all' FROM l) SELECT lang, split, count(DISTINCT pid)::BIGINT AS n_patients, count(DISTINCT CASE WHEN p THEN pid END)::BIGINT AS n_positive_patients, count(*)::BIGINT AS n_labels, count(*) FILTER (p)::BIGINT AS n_positive_labels, count(*) FILTER (NOT p)::BIGINT AS n_negative_labels, count(*) FILTER (p) / count(*)::DOUBLE AS prevalence FROM x GROUP BY ALL")
def label_stats_by_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labels = table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("pid"), (F.col("quality") == 1).alias("positive"), "lang", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return A.label_stats_with_all(labels, ["lang"])


@register(f"WITH {TL} SELECT n AS n_tokens, count(*)::BIGINT AS patients FROM (SELECT pid, count(*)::BIGINT AS n FROM tl GROUP BY pid) GROUP BY 1")
def length_distribution(spark, d):
    return A.length_distribution(timelines(spark, d))


@register(f"WITH {TL} SELECT event_idx AS token_idx, round(avg(CASE code WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 END), 9) AS entropy FROM tl GROUP BY 1")
def entropy_by_position(spark, d):
    known = spark.createDataFrame([("click", 0.5), ("view", 1.5)], "label string, entropy double")
    return A.position_entropy(token_scores(spark, d), known).withColumn("entropy", F.round("entropy", 9))


@register(f"WITH {TL}, r AS (SELECT pid, list(code || ' || ' || event_idx ORDER BY event_idx) AS t FROM tl GROUP BY pid) SELECT pid, array_to_string(list_transform(t[1:10], lambda x: split_part(x, ' || ', 1)), ' ') AS first FROM r")
def rollout_first_tokens(spark, d):
    rows = timelines(spark, d).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "code"))), lambda x: F.concat(x["code"], F.lit(" || "), x["event_idx"])).alias("tokens"))
    return A.first_tokens(rows).select("pid", F.array_join("first", " ").alias("first"))


@register(f"WITH {TL} SELECT event_id, exp(event_id % 7 / 10.0::DOUBLE) AS label_ppl, exp(event_id % 3 / 10.0::DOUBLE) AS argmax_ppl, code || ' || x' AS label, CASE WHEN event_id % 2 = 0 THEN 'click || x' END AS argmax, code AS label_code FROM tl")
def ppl_token_rows(spark, d):
    names = spark.createDataFrame([(7 + i, f"{c} || x") for i, c in enumerate(CODES)], "token_id int, token string")
    scored = _ids(spark, d).select("event_id", F.col("token_id").alias("label_id"), F.when(F.col("event_id") % 2 == 0, 7).alias("argmax_id"), (-(F.col("event_id") % 7) / 10.0).alias("label_log_prob"), (-(F.col("event_id") % 3) / 10.0).alias("argmax_log_prob"))
    return A.token_rows(scored, names).select("event_id", "label_ppl", "argmax_ppl", "label", "argmax", "label_code")


@register("SELECT vec_id, round(embedding[1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS log_prob, list_position(embedding, list_max(embedding))::INT - 1 AS argmax FROM embeddings")
def label_log_probs(spark, d):
    logits = F.col("embedding").cast("array<double>")
    best = F.array_position("embedding", F.array_max("embedding")).cast("int") - 1
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(X.log_softmax(logits), F.lit(0)), 6).alias("log_prob"), best.alias("argmax"))


@register("SELECT i AS step, round(CASE WHEN i < 100 THEN (0.1 + 0.9 * i / 100) WHEN i < 600 THEN 1 - 0.8 * (i - 100) / 500 ELSE 0.2 END, 9)::DOUBLE AS rate FROM range(0, 1000, 10) r(i)")
def learning_rates(spark, d):
    return spark.range(0, 1000, 10).select(F.col("id").alias("step"), F.round(X.learning_rate(F.col("id"), 100, 500, 0.1, 0.2, 1.0), 9).alias("rate"))


# --- labels from events
ADM = "adm AS (SELECT o_custkey AS pid, o_orderkey AS hadm_id, o_orderdate::TIMESTAMP AS start, max(l_shipdate)::TIMESTAMP AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _hospital_events(spark, d) -> DataFrame:
    """Orders as events of admission and discharge, with an earlier admission code that does not count, and deaths."""
    a = admissions(spark, d).withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    event = lambda c, at, k: F.struct(F.lit(c).alias("code"), at.alias("start"), (F.col("hadm_id") * 4 + k).alias("event_idx"))
    rows = a.select("pid", "hadm_id", F.explode(F.array(event("HOSPITAL_ADMISSION//old", F.col("start") - F.expr("interval 1 day"), 0), event("HOSPITAL_ADMISSION//x", F.col("start"), 1), event("HOSPITAL_DISCHARGE//x", F.col("end"), 2))).alias("e")).select("pid", "hadm_id", "e.*")
    dead = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pid"), F.lit(None).cast("bigint").alias("hadm_id"), F.lit("MEDS_DEATH").alias("code"), F.timestamp_micros(F.unix_micros(F.lit("1995-01-01").cast("timestamp")) + F.col("c_custkey") * 37 % 2500 * T.DAY).alias("start"), F.lit(0).cast("long").alias("event_idx"))
    return rows.unionByName(dead)


@register(f"WITH {ADM} SELECT * FROM adm")
def admissions_of_events(spark, d):
    return T.admissions_of(_hospital_events(spark, d)).withColumnRenamed("end", "stop")


LABELS = f"WITH {ADM}, death AS (SELECT c_custkey AS pid, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey * 37 % 2500)::INT AS death FROM customer WHERE c_custkey % 3 = 0), x AS (SELECT DISTINCT a.pid, start, stop, start + INTERVAL 48 HOUR AS t, coalesce(death, TIMESTAMP '9999-12-31') AS death FROM adm a LEFT JOIN death ON death.pid = a.pid) SELECT pid AS subject_id, t AS prediction_time, {{}} AS boolean_value FROM x WHERE t < stop AND t < death"


@register(LABELS.format("death < stop"))
def labels_of_events_death(spark, d):
    return T.label_events(_hospital_events(spark, d), "death")


@register(LABELS.format("stop - start > INTERVAL 7 DAY"))
def labels_of_events_long_stay(spark, d):
    return T.label_events(_hospital_events(spark, d), "long_los")


# --- results
@register("SELECT p_partkey, base, split_part(base, '-', 1) AS family, CASE WHEN regexp_full_match(split_part(base, '-', 3), '[0-9]+') THEN split_part(base, '-', 3)::INT END AS context, base LIKE '%max' AS is_max FROM (SELECT p_partkey, replace(lower(p_brand), '#', '') || '-base-' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'max' END AS base FROM part)")
def model_name_parts(spark, d):
    name = F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("-base-"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("max"), F.lit("--train-tokens"))
    return R.with_model_parts(table(spark, d, "part").select("p_partkey", name.alias("model"))).drop("model")


@register(f"WITH {PRICES} SELECT task, model, value FROM v WHERE size % 3 - 1 = -1 AND task <> 'PROMO' AND model IN ('Brand#11', 'Brand#12', 'Brand#3') AND model <> 'Brand#12'")
def filtered_results(spark, d):
    rows = _prices(spark, d).withColumns({"k": F.col("size") % 3 - 1, "score": F.when(F.col("task") == "PROMO", "auprc").otherwise("auroc")})
    return R.result_rows(rows, "auroc", ["Brand#11", "Brand#12", "Brand#3"], -1, ["Brand#12"]).select("task", "model", "value")


@register("SELECT l.doc_id AS pid, quality, lang, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IN (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) = 1)")
def predictions_with_metrics(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "lang", "n_chars")
    return R.with_metrics(table(spark, d, "labels").select(F.col("doc_id").alias("pid"), "quality"), docs, ["pid"])


@register("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.5 WHEN 'MACHINERY' THEN 2.5 END::DOUBLE AS weight FROM customer")
def weight_lookup(spark, d):
    weights = spark.createDataFrame([("BUILDING", 1.5), ("MACHINERY", 2.5)], "c_mktsegment string, weight double")
    return R.lookup(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", weights, "weight").select("c_custkey", "weight")


@register("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def required_lookup(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return R.lookup(table(spark, d, "nation").select("n_name", "n_regionkey"), "n_regionkey", regions, "r_name", required=True).select("n_name", "r_name")


@register(f"WITH {PRICES} SELECT task, model, round(avg(value), 6) AS value, round(avg(lower), 6) AS lower, round(avg(upper), 6) AS upper FROM v GROUP BY ALL")
def mean_intervals(spark, d):
    return R.mean_interval(_prices(spark, d), ["task", "model"]).withColumns({c: F.round(c, 6) for c in ("value", "lower", "upper")})


@register(f"WITH {PRICES}, w AS (SELECT model, avg(value) FILTER (size > 25) AS att, avg(value) FILTER (size <= 25) AS plain FROM v GROUP BY 1) SELECT model, round(att, 6) AS att, round(plain, 6) AS plain, round(att - plain, 6) AS difference FROM w")
def paired_differences(spark, d):
    rows = _prices(spark, d).withColumn("kind", F.when(F.col("size") > 25, "att").otherwise("plain"))
    return R.paired_difference(rows, ["model"], "kind", "att", "plain", "value").withColumns({c: F.round(c, 6) for c in ("att", "plain", "difference")})


@register("SELECT 'p_brand' AS name, p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part WHERE p_size > 5 GROUP BY 2")
def parameter_counts(spark, d):
    return R.value_counts(table(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") > 5, F.col("p_size"))), ["p_brand", "p_size"])


@register("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 512 / nullif(l_discount, 0), 6) AS tokens FROM lineitem")
def throughputs(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(R.throughput(F.col("l_quantity"), F.lit(512), F.col("l_discount")), 6).alias("tokens"))


@register("SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := abs(o_orderkey - 1000), b := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def closest_checkpoint(spark, d):
    return R.closest(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 1000)


@register(f"WITH {PRICES} SELECT model, (size % 4)::INT AS quartile, round(avg(value), 6) AS brier, count(*)::BIGINT AS n FROM v GROUP BY ALL")
def brier_by_quartile(spark, d):
    rows = _prices(spark, d).withColumns({"quartile": (F.col("size") % 4).cast("int"), "brier": F.col("value")})
    return R.mean_by_quartile(rows, ["model"]).withColumn("brier", F.round("brier", 6))


@register(f"WITH {PRICES} SELECT CASE WHEN size > 25 THEN 'large' ELSE 'small_folder' END AS task, replace(model, 'Brand#', 'b') AS model, round(avg(value), 6) AS value, round(avg(lower), 6) AS lower, round(avg(upper), 6) AS upper FROM v WHERE model IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11') GROUP BY ALL")
def union_of_tasks(spark, d):
    rows = _prices(spark, d)
    out = R.union_of_tasks({"large_folder": rows.where("size > 25"), "small_folder": rows.where("size <= 25")}, {"large_folder": "large"}, ["Brand#1", "Brand#2", "Brand#3", "Brand#11"], {"Brand#": "b"})
    return out.withColumns({c: F.round(c, 6) for c in ("value", "lower", "upper")})


@register(f"WITH {PRICES} SELECT model || CASE WHEN size > 25 THEN '-att' ELSE '' END AS model, task, round(avg(value), 6) AS value FROM v GROUP BY model, task, size > 25")
def mean_of_sources(spark, d):
    rows = _prices(spark, d)
    return R.mean_of_sources({"-att": rows.where("size > 25"), "": rows.where("size <= 25")}, ["model", "task"], "value").withColumn("value", F.round("value", 6))


@register(f"WITH {PRICES}, t AS (SELECT model, size AS b, task, avg(value) AS value FROM v GROUP BY ALL), m AS (SELECT model, b, avg(value) AS value FROM t GROUP BY ALL), q AS (SELECT model, avg(value) AS mean, quantile_cont(value, [0.025, 0.5, 0.975]) AS q FROM m GROUP BY 1) SELECT model, printf('%.4f (%.4f, %.4f)', mean / 9.7, q[1] / 9.7, q[3] / 9.7) AS shown FROM q")
def macro_interval_shown(spark, d):
    macro = R.macro_replicates(_prices(spark, d).withColumnRenamed("size", "b"), ["model", "b"], "task", "value")
    return E.interval(macro, ["model"], "value").select("model", R.shown(F.col("mean") / 9.7, F.col("lower") / 9.7, F.col("upper") / 9.7).alias("shown"))


@register(f"WITH {PRICES}, t AS (SELECT model, size AS b, task, avg(value) AS value FROM v GROUP BY ALL) SELECT x.model, avg((z.value > x.value)::INT::DOUBLE) AS win_rate FROM t x JOIN t z ON z.b = x.b AND z.task = x.task AND z.model = 'Brand#1' WHERE x.model <> 'Brand#1' GROUP BY 1")
def brier_win_rate(spark, d):
    rows = _prices(spark, d).groupBy("model", F.col("size").alias("b"), "task").agg(F.avg("value").alias("value"))
    beaten = R.beats_baseline(rows, ["task"], "model", "Brand#1", "value")
    counted = rows.where("model <> 'Brand#1'").join(rows.where("model = 'Brand#1'").select("b", "task"), ["b", "task"]).groupBy("task", "model").agg(F.count("*").alias("n"))
    return beaten.join(counted, ["task", "model"]).groupBy("model").agg((F.sum(F.col("win_rate") * F.col("n")) / F.sum("n")).alias("win_rate"))


@register("WITH b AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, (c_acctbal > -500)::INT + (c_acctbal > 1000)::INT + (c_acctbal > 5000)::INT AS bucket FROM customer")
def cutoff_buckets(spark, d):
    return E.bucket_of(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", [-500, 1000, 5000]).select("c_custkey", "bucket")


@register("WITH s AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS m, var_samp(c_acctbal) / count(*) AS e, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1) SELECT round((a.m - b.m) / sqrt(a.e + b.e), 6) AS t, round(pow(a.e + b.e, 2) / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)), 6) AS dof FROM s a, s b WHERE a.g = 'BUILDING' AND b.g = 'MACHINERY'")
def welch_statistic(spark, d):
    rows = table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").withColumn("all", F.lit(1))
    return E.welch(rows, ["all"], "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal").select(F.round("t", 6).alias("t"), F.round("dof", 6).alias("dof"))
