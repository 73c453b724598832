"""Evaluation statistics: bootstrap, weighted AUROC and Brier, intervals, win rates, tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

M = 2147483647


def bootstrap_draws(spark: SparkSession, n: int, replicates: int, parts: int | None = None) -> DataFrame:
    """(b, idx): the n draws of each replicate; the same in any engine."""
    rows = spark.range(0, replicates * n, 1, *([parts] if parts else []))
    b, i = F.floor(F.col("id") / n), F.col("id") % n
    x1 = (b * 1000003 + i * 7919 + 12345) % M * 48271 % M
    x3 = (x1 * x1 % M * 69621 + b) % M
    return rows.select(b.alias("b"), (x3 % n).alias("idx"))


def bootstrap_weights(spark: SparkSession, n: int, replicates: int, parts: int | None = None) -> DataFrame:
    """(b, idx, w): how often each of n patients is drawn in each replicate; the draw is the same in any engine."""
    return bootstrap_draws(spark, n, replicates, parts).groupBy("b", "idx").agg(F.count("*").alias("w"))


def auroc(df: DataFrame, by: list[str], y: str = "y", p: str = "p", w: str = "w") -> DataFrame:
    """(by..., auroc): weighted, ties half; rows of equal scores are summed before they are ordered."""
    g = df.groupBy(*by, p).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0)).alias("_pos"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0)).alias("_neg"))
    below = F.sum("_neg").over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_neg")
    g = g.withColumn("_hit", F.col("_pos") * (below + 0.5 * F.col("_neg")))
    return g.groupBy(*by).agg((F.sum("_hit") / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auroc"))


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p", w: str = "w") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(w) * F.pow(F.col(y) - F.col(p), 2)) / F.sum(w)).alias("brier"))


def interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., mean, lower, median, upper, significant, wins) of replicates."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    return out.select(*by, "mean", lo.alias("lower"), F.get("q", F.lit(1)).alias("median"), hi.alias("upper"), ((lo > 0) | (hi < 0)).alias("significant"), ((lo > 0) & (hi > 0)).alias("wins"))


def delta(df: DataFrame, by: list[str], model: str, base: str, value: str) -> DataFrame:
    """Each model's value less the baseline's, for the same keys."""
    b = df.where(F.col(model) == base).select(*by, F.col(value).alias("_base"))
    return df.where(F.col(model) != base).join(b, by).select(*by, model, (F.col(value) - F.col("_base")).alias("delta"))


def win_rate(deltas: DataFrame, by: list[str]) -> DataFrame:
    return deltas.groupBy(*by).agg(F.avg(F.signum("delta")).alias("win_rate"))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, w: str, at: list[float]) -> DataFrame:
    """(by..., q, cut): quantiles of weighted values, interpolated between the midpoints of cumulative weight."""
    g = df.groupBy(*by, value).agg(F.sum(w).alias("_w"))
    part = Window.partitionBy(*by)
    cum = F.sum("_w").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("_m", (cum - 0.5 * F.col("_w")) / F.sum("_w").over(part))
    g = g.withColumns({"_m2": F.lead("_m").over(part.orderBy(value)), "_v2": F.lead(value).over(part.orderBy(value)), "_first": F.row_number().over(part.orderBy(value)) == 1})
    qs = g.withColumn("q", F.explode(F.array(*(F.lit(float(x)) for x in at))))
    q = F.col("q")
    hit = ((F.col("_m") <= q) & ((q < F.col("_m2")) | F.col("_m2").isNull())) | (F.col("_first") & (q < F.col("_m")))
    step = (q - F.col("_m")) / (F.col("_m2") - F.col("_m")) * (F.col("_v2") - F.col(value))
    return qs.where(hit).select(*by, "q", (F.col(value) + F.when((q >= F.col("_m")) & F.col("_m2").isNotNull(), step).otherwise(0.0)).alias("cut"))


def bucket_of(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """df with `bucket`: the number of cuts below the value."""
    below = F.lit(0)
    for c in cuts:
        below = below + (F.col(value) > c).cast("int")
    return df.withColumn("bucket", below)


def welch(df: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """(by..., t, dof, p): Welch's test that a's mean is below b's; p is one-sided, 1 where t is not negative."""
    stats = lambda g: [f(F.when(F.col(group) == g, F.col(value))) for f in (F.avg, F.var_samp, F.count)]
    (m1, v1, n1), (m2, v2, n2) = stats(a), stats(b)
    s = df.groupBy(*by).agg(m1.alias("m1"), v1.alias("v1"), n1.alias("n1"), m2.alias("m2"), v2.alias("v2"), n2.alias("n2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    s = s.select(*by, ((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("t"), (F.pow(e1 + e2, 2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))).alias("dof"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([student_tail(x, d) if x < 0 else 1.0 for x, d in zip(t, dof)])

    return s.withColumn("p", tail("t", "dof"))


def student_tail(t: float, dof: float) -> float:
    """P(T <= t) for t < 0: the incomplete beta function by its continued fraction (Lentz)."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return beta / 2
