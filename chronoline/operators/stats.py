"""Statistics of datasets, labels, results and model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.splits import exact_quantiles, running_counts


def code_counts(events: DataFrame, split: str = "split") -> DataFrame:
    """(split, code, n_events, n_patients) per split and over all, in one pass of grouping sets."""
    out = events.groupingSets([[split, "code"], ["code"]], split, "code").agg(F.count("*").alias("n_events"), F.count_distinct("pid").alias("n_patients"))
    return out.withColumn(split, F.coalesce(split, F.lit("all")))


def shares(df: DataFrame, by: str, n: str = "n") -> DataFrame:
    """(by, total, entries, share_total, share_entries) with shares of all groups."""
    g = df.groupBy(by).agg(F.sum(n).alias("total"), F.count("*").alias("entries"))
    whole = g.agg(F.sum("total").alias("_t"), F.sum("entries").alias("_e"))
    return g.crossJoin(F.broadcast(whole)).select(by, "total", "entries", (F.col("total") / F.col("_t")).alias("share_total"), (F.col("entries") / F.col("_e")).alias("share_entries"))


def shares_without(df: DataFrame, by: str, excluded: list[str], n: str = "n") -> DataFrame:
    """shares of the groups that are not excluded, of what is left."""
    return shares(df.where(~F.col(by).isin(excluded)), by, n)


def with_time_prefix(token: Column) -> Column:
    """The vocabulary of a token; marks of visits and elapsed time are `ATT`."""
    return F.when(token.rlike(r"^\[(DAY|WEEK|MONTH|LONG|VISIT)"), "ATT").otherwise(F.split_part(token, F.lit("/"), F.lit(1)))


def vocabulary_shares(tokens: DataFrame) -> DataFrame:
    """(prefix, n, share): tokens by vocabulary, with shares of all."""
    g = tokens.groupBy(with_time_prefix(F.col("token")).alias("prefix")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_t")))).select("prefix", "n", (F.col("n") / F.col("_t")).alias("share"))


def demographics(events: DataFrame, codes: dict[str, dict[str, str]]) -> DataFrame:
    """(pid, age, one column for each kind): age group by the span of the timeline, and for each kind the name of the first
    event whose code is one of its codes. codes: kind to code to name; kinds race and sex are `unknown` without one."""
    at = F.unix_micros(F.col("start").cast("timestamp"))
    days = (F.max_by(at, "event_idx") - F.min_by(at, "event_idx")) / 86_400_000_000
    firsts = []
    for kind, names in codes.items():
        name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("code")]
        first = F.min_by(name, F.when(name.isNotNull(), F.col("event_idx")))
        firsts.append((F.coalesce(first, F.lit("unknown")) if kind in ("race", "sex") else first).alias(kind))
    return events.groupBy("pid").agg(age_bucket(days).alias("age"), *firsts)


def label_stats_with_all(labels: DataFrame, by: list[str], split: str = "split") -> DataFrame:
    """label_stats for each split and, as split `all`, over all of them."""
    doubled = labels.withColumn(split, F.explode(F.array(F.col(split), F.lit("all"))))
    return label_stats(doubled, [*by, split])


def position_entropy(scores: DataFrame, entropies: DataFrame) -> DataFrame:
    """(token_idx, entropy): the mean entropy of the labels at each position; labels without one are left out."""
    return scores.join(entropies.select("label", "entropy"), "label", "left").groupBy("token_idx").agg(F.avg("entropy").alias("entropy"))


def length_distribution(tokens: DataFrame) -> DataFrame:
    """(n_tokens, patients) from token rows."""
    return tokens.groupBy("pid").agg(F.count("*").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("patients"))


def first_tokens(rollouts: DataFrame, k: int = 10) -> DataFrame:
    """rollouts with `first`: the first k tokens of each, without what follows the code."""
    return rollouts.withColumn("first", F.transform(F.slice("tokens", 1, k), lambda t: F.split_part(t, F.lit(" || "), F.lit(1))))


def token_rows(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Scored tokens with label_ppl, argmax_ppl, the tokens of both ids, and the code before the first ` || `; names: (token_id, token)."""
    name = lambda c, to: names.select(F.col("token_id").alias(c), F.col("token").alias(to))
    out = scores.withColumns({"label_ppl": F.exp(-F.col("label_log_prob")), "argmax_ppl": F.exp(-F.col("argmax_log_prob"))})
    out = out.join(name("label_id", "label"), "label_id", "left").join(name("argmax_id", "argmax"), "argmax_id", "left")
    return out.withColumn("label_code", F.split_part("label", F.lit(" || "), F.lit(1)))


def percentiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """(percentile, value): linear interpolation."""
    q = exact_quantiles(df, value, [a / 100 for a in at])
    return q.select(F.posexplode("q").alias("i", "value")).select(F.get(F.array(*(F.lit(float(a)) for a in at)), F.col("i")).alias("percentile"), "value")


def frequency_cdf(df: DataFrame, value: str) -> DataFrame:
    """(value, n, cdf): counts of values and their cumulative share; values are ordered range by range."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    running = running_counts(counts, value, "n").withColumn("_r", F.col("_before") + F.col("n"))
    return running.crossJoin(F.broadcast(total)).select(value, "n", (F.col("_r") / F.col("_t")).alias("cdf"))


def histogram_cdf(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, cdf) over equal bins from least to greatest value; the greatest lies in the last bin."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    return frequency_cdf(df.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int")), "bin")


def tail_shares(df: DataFrame, value: str, cuts: list[int]) -> DataFrame:
    """(cut, share): share of rows at or above each cut."""
    wide = df.agg(*(F.avg(F.when(F.col(value) >= c, 1.0).otherwise(0.0)).alias(str(c)) for c in cuts))
    return wide.unpivot([], [str(c) for c in cuts], "cut", "share").withColumn("cut", F.col("cut").cast("int"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def age_bucket(days):
    """Age groups by years of 365 days; exactly 60 or 80 years fall in none."""
    y = 365
    return F.when(days <= 20 * y, "age_20").when(days <= 40 * y, "age_40").when((days > 40 * y) & (days < 60 * y), "age_60").when((days > 60 * y) & (days < 80 * y), "age_80").when(days > 80 * y, "age_plus")


def label_stats(labels: DataFrame, by: list[str]) -> DataFrame:
    """Patients, labels and positives for each group; labels: (by..., pid, positive)."""
    pos = F.col("positive")
    g = labels.groupBy(*by).agg(F.count_distinct("pid").alias("n_patients"), F.count_distinct(F.when(pos, F.col("pid"))).alias("n_positive_patients"), F.count("*").alias("n_labels"), F.sum(pos.cast("long")).alias("n_positive_labels"))
    return g.withColumns({"n_negative_labels": F.col("n_labels") - F.col("n_positive_labels"), "prevalence": F.col("n_positive_labels") / F.col("n_labels")})


def high_level(lengths: DataFrame, by: str) -> DataFrame:
    """Least, mean, median and greatest of `length` and `n_unique` for each group."""
    return lengths.groupBy(by).agg(F.count("*").alias("n_patients"), *(f(c).alias(f"{name}_{c}") for c in ("length", "n_unique") for name, f in (("min", F.min), ("mean", lambda x: F.round(F.avg(x), 2)), ("median", F.median), ("max", F.max))))


def macro_mean(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """The mean over groups of group means."""
    return df.groupBy(*inner).agg(F.avg(value).alias(value)).groupBy(*outer).agg(F.avg(value).alias(value))


def rank_within(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with `rank`: minimum rank, greatest value first."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.col(value).desc())))


def densify(df: DataFrame, a: str, b: str, value: str, order: str) -> DataFrame:
    """Every pair of distinct a and b with the first value by `order`, null where there is none (two short dimensions)."""
    first = df.groupBy(a, b).agg(F.min_by(value, order).alias(value))
    return df.select(a).distinct().crossJoin(F.broadcast(df.select(b).distinct())).join(first, [a, b], "left")


def perplexity(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median and population deviation of log-probabilities and their exponentials; ppl of the mean."""
    x = F.col("label_log_prob")
    aggs = [F.count("*").alias("n_tokens"), F.exp(-F.avg(x)).alias("ppl")] + [f(v).alias(f"{name}_{n}") for n, v in (("log_prob", x), ("prob", F.exp(x))) for name, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))]
    return scores.groupBy(*(by or [])).agg(*aggs)


def position_medians(scores: DataFrame, value: str = "ppl", least: int = 30) -> DataFrame:
    """(token_idx, n, median, lower, upper): medians with rank confidence ends, positions of `least` rows or more."""
    n, w = F.col("n"), Window.partitionBy("token_idx")
    ranked = scores.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(value)) - 1}).where(n >= least)
    lo = F.greatest(F.lit(0), F.floor(0.5 * n - 1.96 * F.sqrt(n) / 2))
    hi = F.least(n - 1, F.ceil(0.5 * n + 1.96 * F.sqrt(n) / 2))
    middle = F.avg(F.when((F.col("r") == F.floor((n - 1) / 2)) | (F.col("r") == F.ceil((n - 1) / 2)), F.col(value)))
    return ranked.groupBy("token_idx", "n").agg(middle.alias("median"), F.max(F.when(F.col("r") == lo, F.col(value))).alias("lower"), F.max(F.when(F.col("r") == hi, F.col(value))).alias("upper"))


def ema(positions: DataFrame, value: str, span: int = 20) -> DataFrame:
    """(token_idx, value, ema): an exponential average seeded by the first value, over the positions in order.

    One row per position is gathered, bounded by the context length.
    """
    alpha = 2.0 / (span + 1)
    rows = positions.agg(F.array_sort(F.collect_list(F.struct("token_idx", F.col(value).alias("v")))).alias("a"))
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * F.element_at(acc, -1))))
    folded = F.aggregate("a", F.array().cast("array<double>"), step)
    return rows.select(F.explode(F.arrays_zip("a", folded.alias("e"))).alias("z")).select("z.a.token_idx", F.col("z.a.v").alias(value), F.col("z.e").alias("ema"))


def token_diversity(scores: DataFrame) -> DataFrame:
    return scores.groupBy("token_idx").agg((F.count_distinct("label") / F.count("*")).alias("diversity"), F.count("*").alias("n"))


def span_perplexity(scores: DataFrame, least: int, first: int, last: int) -> DataFrame:
    """(pid, ppl) over positions first to last, both included, of timelines with `least` rows or more."""
    inside = F.col("token_idx").between(first, last)
    return scores.groupBy("pid").agg(F.count("*").alias("_n"), F.exp(-F.avg(F.when(inside, F.col("label_log_prob")))).alias("ppl")).where(F.col("_n") >= least).drop("_n")


def weighted_loss(df: DataFrame, loss: str, weight: str, by: list[str]) -> DataFrame:
    mean = F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)
    return df.groupBy(*by).agg(mean.alias("loss")).withColumn("ppl", F.least(F.exp("loss"), F.lit(100.0)))


def crossings(df: DataFrame, by: str, order: str, value: str, every: float) -> DataFrame:
    """Steps at which the running total of value passes a multiple of `every`: (by, order, total, crossed)."""
    w = Window.partitionBy(by).orderBy(order)
    running = df.select(by, order, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    level = F.floor(F.col("total") / every)
    rows = running.withColumn("_before", F.coalesce(F.lag(level).over(w), F.lit(0)))
    return rows.where(level > F.col("_before")).select(by, order, "total", (level * every).alias("crossed"))
