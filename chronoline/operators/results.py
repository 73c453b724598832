"""Tables of evaluation results: names of models, joins with metrics, families, intervals, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_parts(model: Column) -> dict[str, Column]:
    """What a model's name says: base (before `--`), family (before the first dash), context (third part, if digits), size is the greatest."""
    base = F.split_part(model, F.lit("--"), F.lit(1))
    context = F.split_part(base, F.lit("-"), F.lit(3))
    return {"base": base, "family": F.split_part(base, F.lit("-"), F.lit(1)), "context": F.when(context.rlike("^[0-9]+$"), context.try_cast("int")), "is_max": base.endswith("max")}


def with_model_parts(df: DataFrame, model: str = "model") -> DataFrame:
    return df.withColumns(model_parts(F.col(model)))


def result_rows(df: DataFrame, score: str, models: list[str] | None = None, k: int = -1, without: list[str] | None = None) -> DataFrame:
    """Rows of one score and one number of shots, of the named models, without others."""
    out = df.where((F.col("k") == k) & (F.col("score") == score))
    out = out.where(F.col("model").isin(models)) if models else out
    return out.where(~F.col("model").isin(without)) if without else out


def with_metrics(predictions: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with the metrics of their keys; keys that metrics have more than once fail, as rows would multiply."""
    once = metrics.groupBy(*keys).agg(F.count("*").alias("_times"), *(F.first(c).alias(c) for c in metrics.columns if c not in keys))
    checked = F.when(F.col("_times") > 1, F.raise_error(F.lit("metrics have a key more than once")).cast("long")).otherwise(F.col("_times"))
    return predictions.join(once.withColumn("_times", checked), keys).where("_times = 1").drop("_times")


def lookup(df: DataFrame, key: str, values: DataFrame, value: str, required: bool = False) -> DataFrame:
    """df with `value` of its key; a missing key gives null or, if required, fails. values: one row a key."""
    out = df.join(values.select(key, F.col(value), F.lit(True).alias("_found")), key, "left")
    if required:
        kind = out.schema[value].dataType
        out = out.withColumn(value, F.when(F.col("_found"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no value of "), F.col(key).cast("string"))).cast(kind)))
    return out.drop("_found")


def mean_interval(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, lower, upper): means of value and of both ends of its interval."""
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("value", "lower", "upper")))


def paired_difference(df: DataFrame, by: list[str], kind: str, a: str, b: str, value: str) -> DataFrame:
    """(by..., a, b, difference): the mean value of kinds a and b side by side, and a less b."""
    wide = df.groupBy(*by).pivot(kind, [a, b]).agg(F.avg(value))
    return wide.withColumn("difference", F.col(f"`{a}`") - F.col(f"`{b}`"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n): how often each value of each column stands; nulls are left out."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e")).select("e.*")
    return long.where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))


def throughput(batch_size: Column, n_tokens: Column, seconds: Column) -> Column:
    """Tokens a second; null where no time was measured."""
    return batch_size * n_tokens / F.nullif(seconds, F.lit(0))


def closest(df: DataFrame, by: str, at: str, target: float) -> DataFrame:
    """For each group the row whose `at` is nearest to the target, the lower one on ties."""
    row = F.struct(*df.columns)
    return df.groupBy(by).agg(F.min_by(row, F.struct(F.abs(F.col(at) - target), at)).alias("_row")).select("_row.*")


def mean_by_quartile(df: DataFrame, by: list[str], value: str = "brier") -> DataFrame:
    return df.groupBy(*by, "quartile").agg(F.avg(value).alias(value), F.count("*").alias("n"))


def union_of_tasks(tables: dict[str, DataFrame], names: dict[str, str], models: list[str] | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """(task, model, value, lower, upper) of the result tables of several folders; an unmapped folder keeps its name. A table that cannot be read fails."""
    parts = []
    for folder, df in tables.items():
        rows = df.where(F.col("model").isin(models)) if models else df
        parts.append(mean_interval(rows, ["model"]).withColumn("task", F.lit(names.get(folder, folder))))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    for old, new in (renamed or {}).items():
        out = out.withColumn("model", F.replace("model", F.lit(old), F.lit(new)))
    return out.select("task", "model", "value", "lower", "upper")


def mean_of_sources(sources: dict[str, DataFrame], by: list[str], value: str) -> DataFrame:
    """(by..., value): group means of each source, the first of `by` with the source's suffix, in one table."""
    parts = [df.groupBy(*by).agg(F.avg(value).alias(value)).withColumn(by[0], F.concat(by[0], F.lit(suffix))) for suffix, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def macro_replicates(df: DataFrame, by: list[str], task: str, value: str) -> DataFrame:
    """(by..., value): the mean over tasks within each replicate; `by` names the replicate too."""
    return df.groupBy(*by, task).agg(F.avg(value).alias(value)).groupBy(*by).agg(F.avg(value).alias(value))


def shown(value: Column, lower: Column, upper: Column) -> Column:
    """`0.1234 (0.1000, 0.2000)`."""
    return F.format_string("%.4f (%.4f, %.4f)", value.cast("double"), lower.cast("double"), upper.cast("double"))


def beats_baseline(df: DataFrame, by: list[str], model: str, base: str, value: str) -> DataFrame:
    """(by..., model, win_rate): the share of rows in which the baseline's loss is above the model's."""
    b = df.where(F.col(model) == base).select("b", *by, F.col(value).alias("_base"))
    pairs = df.where(F.col(model) != base).join(b, ["b", *by])
    return pairs.groupBy(*by, model).agg(F.avg((F.col("_base") > F.col(value)).cast("double")).alias("win_rate"))
