"""Splits, samples and dense indices that need no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of(share: Column) -> Column:
    """train below 70, val below 85, else test."""
    return F.when(share < 70, "train").when(share < 85, "val").otherwise("test")


def hash_split(df: DataFrame, key: str, seed: int = 97) -> DataFrame:
    """A split by an arithmetic hash of an integer key, the same in any engine."""
    return df.withColumn("split", split_of(F.pmod((F.col(key) % 1000003) * 2654435761 % 2147483647 + seed, F.lit(100))))


def dense_index(df: DataFrame, key: str, name: str = "idx", width: int = 65_536) -> DataFrame:
    """Rows numbered from 0 by an integer key: ranks within key ranges of `width`, plus the rows of the ranges before.

    Only the ranges' counts meet in one task, one row per range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_rank", rank).join(before, "_range").withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


#: Ranges into which the values of a whole table are cut before they are ordered.
RANGES = 256


def running_counts(counts: DataFrame, value: str, n: str, by: list[str] | None = None) -> DataFrame:
    """counts (by..., value, n; each value once) with `_before`, the rows of smaller values.

    With groups, a group's distinct values are ordered together. Without, values are cut into RANGES ranges at
    approximate percentiles (collected, so that both uses of them agree): a task orders one range, and only the sums of
    the ranges meet in one task.
    """
    if by:
        return counts.withColumn("_before", F.sum(n).over(Window.partitionBy(*by).orderBy(value)) - F.col(n))
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 10_000)).first()[0]
    at = F.size(F.filter(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))), lambda c: c < F.col(value))) if cuts else F.lit(0)
    ranged = counts.withColumn("_range", at)
    sums = ranged.groupBy("_range").agg(F.sum(n).alias("_s"))
    offsets = sums.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_offset"))
    own = F.sum(n).over(Window.partitionBy("_range").orderBy(value)) - F.col(n)
    return ranged.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn("_before", F.col("_offset") + F.col("_own")).drop("_range", "_own", "_offset")


def at_positions(ranked: DataFrame, value: str, n: str, positions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q): the values at shares of the way from the first to the last row, interpolated between neighbours.

    ranked: (by..., value, n, _before). One aggregation picks the neighbours; no buffer holds a group's values.
    """
    total = ranked.groupBy(*(by or [])).agg(F.sum(n).alias("_total"))
    known = ranked.join(F.broadcast(total), by) if by else ranked.crossJoin(F.broadcast(total))
    place = lambda p: F.lit(p) * (F.col("_total") - 1)
    pick = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col(n)), F.col(value).cast("double")))
    picks = [x for i, p in enumerate(positions) for x in (pick(F.floor(place(p))).alias(f"_l{i}"), pick(F.ceil(place(p))).alias(f"_h{i}"))]
    found = known.groupBy(*(by or [])).agg(F.max("_total").alias("_total"), *picks)
    cut = lambda i, p: F.col(f"_l{i}") + (place(p) - F.floor(place(p))) * (F.col(f"_h{i}") - F.col(f"_l{i}"))
    return found.select(*(by or []), F.array(*(cut(i, p) for i, p in enumerate(positions))).alias("q"))


def exact_quantiles(df: DataFrame, value: str, positions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q): exact quantiles by counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count("*").alias("_n"))
    return at_positions(running_counts(counts, value, "_n", by), value, "_n", positions, by)


def positional_split(df: DataFrame, key: str, train: float = 0.8, tuning: float = 0.1) -> DataFrame:
    """The first share of rows by key is train, the next tuning, the rest held_out."""
    n = df.agg(F.count("*").alias("_total"))
    out = dense_index(df, key).join(F.broadcast(n))
    return out.withColumn("split", F.when(F.col("idx") < F.lit(train) * F.col("_total"), "train").when(F.col("idx") < F.lit(train + tuning) * F.col("_total"), "tuning").otherwise("held_out")).drop("_total")


def overlaps(splits: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split; empty if the splits are disjoint."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def debug_limit(splits: DataFrame, key: str, n: int = 1_000) -> DataFrame:
    """The first n keys of each split: a feature for trying things out, not for results."""
    rank = F.row_number().over(Window.partitionBy("split").orderBy(key))
    return splits.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def rows_of_splits(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """rows with the split of their key; keys of no split are dropped."""
    return rows.join(splits.select(key, "split"), key)


def index_slice(df: DataFrame, key: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows start to end - 1 by key, with `idx`; either end may be open."""
    out = dense_index(df, key)
    out = out.where(F.col("idx") >= start) if start is not None else out
    return out.where(F.col("idx") < end) if end is not None else out


def hash_rank(key: Column, seed: int = 0) -> Column:
    """An arithmetic pseudo-random rank of an integer key."""
    return ((key % 1000003) * 48271 + seed * 7919 + 11) * 69621 % 2147483647


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, those of least hash."""
    return df.orderBy(hash_rank(F.col(key), seed), key).limit(n)


def capped_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, those of least hash."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_rank(F.col(key), seed), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
