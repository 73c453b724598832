"""Schemas of the timeline model and adapters from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "pid bigint, event_idx int, code string, value_num double, value_str string, unit string, start timestamp, end timestamp, omop_table string, hadm_id bigint, visit_id bigint"
VOCAB = "entry_idx int, code string, type string, unit string, range_start double, range_end double, categories array<string>, description string, token string, token_id int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as timelines: user_id is the patient, event_type the code, `k` of props the text value."""
    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("pid"), idx.alias("event_idx"), F.col("event_type").alias("code"), F.col("value").alias("value_num"), F.get_json_object("props", "$.k").alias("value_str"), F.lit(None).cast("string").alias("unit"), F.col("ts").cast("timestamp").alias("start"), "event_id")


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as admissions: from the order date to the last shipping date."""
    ship = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("stop"))
    o = table(spark, sf_dir, "orders")
    return o.join(ship, o.o_orderkey == ship.l_orderkey).select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("start"), F.col("stop").alias("end"))


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored tokens: the label is the code, its log-probability a fixed function of the event's id."""
    t = timelines(spark, sf_dir)
    return t.select("pid", F.col("event_idx").alias("token_idx"), F.col("code").alias("label"), (-(F.lit(0.5) + (F.col("event_id") * 7919 % 1000) / 250.0)).alias("label_log_prob"), F.col("value_num").alias("weight"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with two models' scores, fixed functions of the document's id; the patient is the document."""
    l = table(spark, sf_dir, "labels")
    rows = l.select(F.col("doc_id").alias("pid"), F.col("quality").alias("y"), F.explode(F.array(F.struct(F.lit("a").alias("model"), ((F.col("doc_id") * 7919 + 13) % 1000 / 1000.0).alias("p")), F.struct(F.lit("b").alias("model"), ((F.col("doc_id") * 10007 + 71) % 100 / 100.0).alias("p")))).alias("m"))
    return rows.select("pid", "y", "m.model", "m.p")
