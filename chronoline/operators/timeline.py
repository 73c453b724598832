"""Timeline properties: gaps, n-grams, repeats, lengths, as-of joins, labels of admissions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.splits import at_positions, running_counts

DAY = 86_400_000_000


def as_of(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events up to and including each label's time: (pid, label_time, event columns)."""
    return labels.select("pid", "label_time").distinct().join(events, "pid").where("start <= label_time")


def asof_join(features: DataFrame, labels: DataFrame, exact: bool = False) -> DataFrame:
    """labels (pid, label_time, ...) with the last feature (pid, time, value) at or before, in one pass over the union.

    exact: fail where the times differ.
    """
    f = features.select("pid", F.col("time").alias("t"), F.lit(0).alias("side"), F.struct(F.col("time").alias("feature_time"), "value").alias("f"), F.lit(None).cast("string").alias("row"))
    others = [c for c in labels.columns if c not in ("pid", "label_time")]
    l = labels.select("pid", F.col("label_time").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(f.schema["f"].dataType).alias("f"), F.to_json(F.struct(*others)).alias("row") if others else F.lit("").alias("row"), *others)
    w = Window.partitionBy("pid").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = f.unionByName(l, allowMissingColumns=True).withColumn("g", F.last("f", ignorenulls=True).over(w)).where("side = 1")
    out = out.select("pid", F.col("t").alias("label_time"), *others, "g.feature_time", "g.value")
    return out.withColumn("value", F.when(F.col("feature_time") == F.col("label_time"), F.col("value")).otherwise(F.raise_error(F.lit("no feature at a label's time")).cast(out.schema["value"].dataType))) if exact else out


def gaps(events: DataFrame, by: list[str] = ["pid"]) -> DataFrame:
    """Seconds since the previous event, for each event but the first."""
    at = F.unix_micros(F.col("start").cast("timestamp"))
    seconds = (at - F.lag(at).over(Window.partitionBy(*by).orderBy("event_idx"))) / 1e6
    return events.select(*by, "event_idx", "code", seconds.alias("seconds")).where("seconds is not null")


def gap_metrics(gapped: DataFrame, by: list[str] = ["pid"]) -> DataFrame:
    """(by..., metric, value): sample deviation, mean and interquartile range of gaps; the deviation of one gap is null."""
    q = F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.75)))
    wide = gapped.groupBy(*by).agg(F.stddev_samp("seconds").alias("std"), F.avg("seconds").alias("mean"), q.alias("q")).withColumn("iqr", F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
    return wide.unpivot(by, ["std", "mean", "iqr"], "metric", "value")


def ngram_counts(events: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 4), by: list[str] = ["pid"]) -> DataFrame:
    """(by..., n, ngram, cnt): runs of codes by windows, so long timelines never become one value."""
    w = Window.partitionBy(*by).orderBy("event_idx")
    top = max(sizes)
    rows = events.select(*by, *(F.lead("code", i).over(w).alias(f"c{i}") for i in range(top)))
    gram = lambda n: F.when(F.col(f"c{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws("␟", *(F.col(f"c{i}") for i in range(n))).alias("ngram")))
    out = rows.select(*by, F.explode(F.array_compact(F.array(*(gram(n) for n in sizes)))).alias("g")).select(*by, "g.*")
    return out.groupBy(*by, "n", "ngram").agg(F.count("*").alias("cnt"))


def repetition_rates(counts: DataFrame, by: list[str] = ["pid"], sizes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(by..., rr_1.., rr, ttr): shares of distinct n-grams that repeat, their geometric mean; only groups with all sizes."""
    rate = F.avg(F.when(F.col("cnt") > 1, 1.0).otherwise(0.0))
    per = counts.groupBy(*by, "n").agg(rate.alias("r"))
    wide = per.groupBy(*by).agg(*(F.max(F.when(F.col("n") == n, F.col("r"))).alias(f"rr_{n}") for n in sizes)).dropna()
    product = F.lit(1.0)
    for n in sizes:
        product = product * F.col(f"rr_{n}")
    return wide.withColumn("rr", F.pow(product, 1.0 / len(sizes))).withColumn("ttr", F.col("rr_1"))


def longest_repeat(events: DataFrame) -> DataFrame:
    """(pid, length, start_idx): the longest run of codes that occurs twice in a timeline (overlaps count), the first on ties.

    Prefix doubling over ranks sorts the timeline's suffixes; neighbours share the longest repeat.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(pdf.sort_values("event_idx")["code"])[0].astype(np.int64)
        n, rank, k = len(codes), codes.copy(), 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: max(0, n - k)] = rank[k:]
            order = np.lexsort((after, rank))
            step = np.append(0, ((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])).cumsum()) if n else np.zeros(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = step
            k *= 2
            if n == 0 or step[-1] == n - 1 or k >= 2 * n:
                break
        common, h = np.zeros(n, np.int64), 0
        for i in range(n):
            if rank[i] == 0:
                h = 0
                continue
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and codes[i + h] == codes[j + h]:
                h += 1
            common[rank[i]] = h
            h = max(h - 1, 0)
        best = int(common.max()) if n else 0
        where = [min(order[r], order[r - 1]) for r in np.flatnonzero(common == best)] if best else [0]
        return pd.DataFrame({"pid": [pdf["pid"].iloc[0]], "length": [best], "start_idx": [int(min(where))]})

    return events.select("pid", "event_idx", "code").groupBy("pid").applyInPandas(run, "pid long, length long, start_idx long")


def timeline_lengths(events: DataFrame, by: list[str] = ["pid"]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n_events"), F.count_distinct("code").alias("n_unique_events"))


def lengths_as_of(events: DataFrame, labels: DataFrame) -> DataFrame:
    """(pid, label_time, n_events, n_unique_events) up to and including each label's time, of labels with an event.

    Labels and events of a patient are sorted once; running counts serve all labels, so that no label is joined with
    all events before it. The first event of each code counts as a different one.
    """
    first = F.row_number().over(Window.partitionBy("pid", "code").orderBy("start", "event_idx")) == 1
    e = events.select("pid", F.col("start").alias("t"), F.lit(0).alias("side"), F.lit(1).alias("n"), first.cast("int").alias("new"))
    l = labels.select("pid", F.col("label_time").alias("t"), F.lit(1).alias("side"), F.lit(0).alias("n"), F.lit(0).alias("new")).distinct()
    w = Window.partitionBy("pid").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = e.unionByName(l).withColumns({"n_events": F.sum("n").over(w), "n_unique_events": F.sum("new").over(w)}).where("side = 1 and n_events > 0")
    return out.select("pid", F.col("t").alias("label_time"), "n_events", "n_unique_events")


def quartiles(df: DataFrame, value: str, by: list[str] | None = None, key: str = "pid") -> DataFrame:
    """df with `quartile` 0..3: right-closed bins at the quartiles of the minimum ranks; equal bin edges fail.

    Minimum ranks come from counts of distinct values, so equal values never weigh on one task.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_counts(counts, value, "_n", by).withColumn("_rank", (F.col("_before") + 1).cast("double"))
    cuts = at_positions(ranked, "_rank", "_n", [0.0, 0.25, 0.5, 0.75, 1.0], by)
    cuts = cuts.withColumn("_q", F.when(F.size(F.array_distinct("q")) == 5, F.col("q")).otherwise(F.raise_error(F.lit("bin edges must be unique")).cast("array<double>"))).drop("q")
    known = ranked.join(F.broadcast(cuts), by) if by else ranked.crossJoin(F.broadcast(cuts))
    r = F.col("_rank")
    bucket = F.when(r <= F.get("_q", F.lit(1)), 0).when(r <= F.get("_q", F.lit(2)), 1).when(r <= F.get("_q", F.lit(3)), 2).otherwise(3)
    return df.join(known.select(*by, value, bucket.alias("quartile")), [*by, value])


def spans(events: DataFrame) -> DataFrame:
    """(pid, n_events, n_visits, span_days) from events with visit_id; patients without visits have no row."""
    has = F.col("visit_id").isNotNull()
    out = events.groupBy("pid").agg(F.count("*").alias("n_events"), F.count_distinct("visit_id").alias("n_visits"), ((F.max(F.when(has, F.unix_micros(F.col("start").cast("timestamp")))) - F.min(F.when(has, F.unix_micros(F.col("start").cast("timestamp"))))) / DAY).alias("span_days"))
    return out.where("n_visits > 0")


def admissions_of(events: DataFrame) -> DataFrame:
    """(pid, hadm_id, start, end) from admission and discharge codes; the last event of either kind counts."""
    start, end = F.col("code").startswith("HOSPITAL_ADMISSION"), F.col("code").startswith("HOSPITAL_DISCHARGE")
    order = F.struct("start", "event_idx")
    out = events.where("hadm_id is not null").groupBy("pid", "hadm_id").agg(F.max_by(F.when(start, F.col("start")), F.when(start, order)).alias("start"), F.max_by(F.when(end, F.col("start")), F.when(end, order)).alias("end"))
    return out.where("start is not null and end is not null")


def _prediction(admissions: DataFrame, deaths: DataFrame, hours: int) -> DataFrame:
    far = F.lit("9999-12-31").cast("timestamp")
    rows = admissions.select("pid", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end")).distinct()
    once = deaths.groupBy("pid").agg(F.min(F.col("death").cast("timestamp")).alias("death"), F.count_distinct("death").alias("_times"))
    once = once.withColumn("death", F.when(F.col("_times") > 1, F.raise_error(F.lit("a patient has more than one death")).cast("timestamp")).otherwise(F.col("death"))).drop("_times")
    rows = rows.join(once, "pid", "left").withColumn("death", F.coalesce("death", far))
    at = F.timestamp_micros(F.unix_micros("start") + hours * 3_600_000_000)
    return rows.withColumn("prediction_time", at).where("prediction_time < end and prediction_time < death")


def in_hospital_mortality(admissions: DataFrame, deaths: DataFrame, hours: int = 48) -> DataFrame:
    """(pid, prediction_time, label): death before discharge, asked `hours` after admission to those still in and alive."""
    return _prediction(admissions, deaths, hours).select("pid", "prediction_time", (F.col("death") < F.col("end")).alias("label"))


def long_stay(admissions: DataFrame, deaths: DataFrame, hours: int = 48, days: int = 7) -> DataFrame:
    """(pid, prediction_time, label): a stay of more than `days` days."""
    longer = F.unix_micros("end") - F.unix_micros("start") > days * DAY
    return _prediction(admissions, deaths, hours).select("pid", "prediction_time", longer.alias("label"))


def label_events(events: DataFrame, task: str, hours: int = 48) -> DataFrame:
    """(subject_id, prediction_time, boolean_value) of a task for all timelines: admissions and deaths come from the events."""
    deaths = events.where(F.col("code").startswith("MEDS_DEATH")).select("pid", F.col("start").alias("death")).distinct()
    out = LABELERS[task](admissions_of(events), deaths, hours)
    return out.select(F.col("pid").alias("subject_id"), "prediction_time", F.col("label").alias("boolean_value"))


LABELERS = {"death": in_hospital_mortality, "long_los": long_stay}


def positive(value: Column, kind: str) -> Column:
    """Whether a label counts as positive: boolean, multiclass (> 0) or multilabel (not the bit mask 8192)."""
    return {"boolean": value.cast("boolean"), "multiclass": value > 0, "multilabel": value != 8192}[kind]
