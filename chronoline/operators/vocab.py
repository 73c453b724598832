"""Vocabulary mining and the conversion of events to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.functions.expressions import category_token, prefix, range_token
from chronoline.operators.splits import exact_quantiles

SPECIALS = ["[BOS]", "[EOS]", "[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]"]


def unique_codes(events: DataFrame) -> DataFrame:
    return events.select("code").where("code is not null").distinct()


def categories(events: DataFrame) -> DataFrame:
    """Distinct (code, category) of text values that are not blank."""
    return events.where("value_str is not null and value_str <> ''").select("code", F.col("value_str").alias("category")).distinct()


def numeric_buckets(events: DataFrame, n: int = 10, exact: bool = True) -> DataFrame:
    """(code, unit, bucket, range_start, range_end): quantile buckets of a code's values, open at both ends.

    exact: linear interpolation over all values; else approximate percentiles, whose memory does not grow.
    """
    values = events.where("value_num is not null").select("code", F.coalesce("unit", F.lit("None")).alias("unit"), "value_num")
    at = F.array(*(F.lit(i / n) for i in range(n + 1)))
    if exact:
        edges = exact_quantiles(values, "value_num", [i / n for i in range(n + 1)], ["code", "unit"]).withColumnRenamed("q", "cuts")
    else:
        edges = values.groupBy("code", "unit").agg(F.percentile_approx("value_num", at, 100_000).alias("cuts"))
    i = F.col("bucket")
    out = edges.select("code", "unit", "cuts", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    return out.select("code", "unit", "bucket", F.when(i == 0, F.lit(float("-inf"))).otherwise(F.get("cuts", i)).alias("range_start"), F.when(i == n - 1, F.lit(float("inf"))).otherwise(F.get("cuts", i + 1)).alias("range_end"))


def build(events: DataFrame, n: int = 10) -> DataFrame:
    """A vocabulary of plain codes and numeric buckets, with tokens."""
    none = lambda t: F.lit(None).cast(t)
    codes = unique_codes(events).select("code", F.lit("code").alias("type"), none("string").alias("unit"), none("int").alias("bucket"), none("double").alias("range_start"), none("double").alias("range_end"), F.col("code").alias("token"))
    ranges = numeric_buckets(events, n).select("code", F.lit("numerical_range").alias("type"), "unit", "bucket", "range_start", "range_end", range_token(F.col("code"), F.col("unit"), F.col("range_start"), F.col("range_end")).alias("token"))
    return codes.unionByName(ranges)


def extend(vocab: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """vocab with the entries of `more` whose keys it lacks."""
    return vocab.unionByName(more.join(vocab.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def exclude(vocab: DataFrame, vocabularies: list[str]) -> DataFrame:
    """Entries whose prefix is not one of the vocabularies, case aside."""
    return vocab.where(~F.lower(prefix(F.col("code"))).isin([v.lower() for v in vocabularies])) if vocabularies else vocab


def first_stat(stats: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(stats, lambda s: s["type"] == kind), F.lit(1))


def top_k(counts: DataFrame, k: int, count: str = "n", tie: str = "token") -> DataFrame:
    """The k entries of greatest count; missing counts come last, ties by name. Planned as a distributed top-k."""
    return counts.orderBy(F.col(count).desc_nulls_last(), tie).limit(k)


def filter_vocab(vocab: DataFrame, excluded: list[str], least: int | None, keep: int | None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): prefix, least count (column n) and top-`keep` filters; dropped is the whole complement."""
    kept = exclude(vocab, excluded)
    kept = kept.where(F.col("n") >= least) if least is not None else kept
    kept = top_k(kept, keep) if keep is not None else kept
    return kept, vocab.join(kept.select("token"), "token", "left_anti")


def weighted_deciles(entries: DataFrame, n: int = 10) -> DataFrame:
    """Count-weighted quantile edges of numeric categories: (code, value, count) to (code, bucket, range_start, range_end, n).

    One bucket more than n, open at both ends, each with the counts of values within its inclusive ends.
    """
    at = F.array(*(F.lit(i / n) for i in range(n + 1)))
    cuts = entries.groupBy("code").agg(F.percentile("value", at, F.col("count")).alias("cuts"))
    i = F.col("bucket")
    ranges = cuts.select("code", "cuts", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("bucket")).select("code", "bucket", F.when(i == 0, F.lit(float("-inf"))).otherwise(F.get("cuts", i - 1)).alias("lo0"), F.get("cuts", i).alias("at0"), F.when(i == n, F.lit(float("inf"))).otherwise(F.get("cuts", i)).alias("hi0"))
    ranges = ranges.select("code", "bucket", F.when(i == n, F.col("at0")).otherwise(F.col("lo0")).alias("range_start"), F.col("hi0").alias("range_end"))
    hit = ranges.join(entries, "code").where("value between range_start and range_end")
    return hit.groupBy("code", "bucket", "range_start", "range_end").agg(F.sum("count").alias("n"))


def tokenize(events: DataFrame, vocab: DataFrame, unit_mode: str = "ignore") -> DataFrame:
    """events with `token`: the first range that holds a numeric value, else the category of a text, else the plain code.

    A code with ranges (categories) gives no plain token to a number (text) that matches none. unit_mode: 'strict'
    needs equal units, 'none_as_string' reads a missing unit as 'None', 'ignore' looks at none. The vocabulary is one
    row of arrays per code, joined by code: events are never multiplied by ranges.
    """
    columns = vocab.columns
    cats = F.col("categories") if "categories" in columns else F.lit(None).cast("array<string>")
    order = F.col("entry_idx") if "entry_idx" in columns else F.coalesce(F.col("bucket"), F.lit(-1))
    by_code = vocab.groupBy(F.col("code").alias("_code")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "numerical_range", F.struct(order.alias("o"), "range_start", "range_end", "unit", "token")))).alias("_ranges"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "categorical", F.struct(order.alias("o"), cats.alias("c"), "token")))).alias("_cats"),
        F.max(F.when(F.col("type") == "code", F.col("token"))).alias("_plain"),
    )
    value, text = F.col("value_num"), F.col("value_str")
    unit = {"strict": lambda r: r["unit"] == F.col("unit"), "none_as_string": lambda r: r["unit"] == F.coalesce("unit", F.lit("None")), "ignore": lambda r: F.lit(True)}[unit_mode]
    in_range = F.get(F.filter("_ranges", lambda r: (value >= r["range_start"]) & (value <= r["range_end"]) & unit(r)), F.lit(0))["token"]
    in_cats = F.get(F.filter("_cats", lambda r: F.array_contains(r["c"], text)), F.lit(0))["token"]
    token = F.when((F.size("_ranges") > 0) & value.isNotNull(), in_range).when((F.size("_cats") > 0) & text.isNotNull() & (text != ""), in_cats).otherwise(F.col("_plain"))
    return events.join(by_code, events.code == F.col("_code"), "left").withColumn("token", token).drop("_code", "_ranges", "_cats", "_plain")


def token_ids(tokens: DataFrame, first: int = len(SPECIALS)) -> DataFrame:
    """(token, token_id): ids in the order of entry_idx after the special tokens; of equal tokens the last id counts."""
    return tokens.groupBy("token").agg((F.max("entry_idx") + first).cast("int").alias("token_id"))


def describe(vocab: DataFrame, texts: DataFrame) -> DataFrame:
    """vocab with the description of its code, from (code, description)."""
    return vocab.drop("description").join(texts, "code", "left")


def describe_events(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """events with `token`, the description of their code; of several entries of a code the last one with a description counts."""
    texts = vocab.where("description is not null").groupBy("code").agg(F.max_by("description", "entry_idx").alias("token"))
    return events.drop("token").join(texts, "code", "left")


def description_texts(described: DataFrame) -> DataFrame:
    """(pid, text, words): the descriptions of a timeline in order, joined by a space, and the words between white space."""
    rows = described.groupBy("pid").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("event_idx", "token")))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["token"]), " ")
    return rows.select("pid", text.alias("text")).withColumn("words", F.filter(F.split("text", r"\s+"), lambda x: x != ""))


def token_events(tokenized: DataFrame) -> DataFrame:
    """(pid, pos, event_idx, token): one token an event at most, in order, events without a token dropped."""
    kept = tokenized.where("token is not null")
    return kept.select("pid", (F.row_number().over(Window.partitionBy("pid").orderBy("event_idx")) - 1).alias("pos"), "event_idx", "token")


def tokenizable(tokenized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that have a token, and those that have none."""
    return tokenized.where("token is not null"), tokenized.where("token is null")


def is_numeric(events_value: Column) -> Column:
    return events_value.isNotNull()


def is_textual(events_text: Column) -> Column:
    return F.coalesce(events_text != "", F.lit(False))


def ids_of(tokens: DataFrame, ids: DataFrame, required: bool = True) -> DataFrame:
    """tokens with token_id; a token without an id fails if required, else it is the unknown one."""
    out = tokens.join(ids.select("token", "token_id"), "token", "left")
    missing = F.raise_error(F.concat(F.lit("no id of token "), F.col("token"))).cast("int") if required else F.lit(SPECIALS.index("[UNK]"))
    return out.withColumn("token_id", F.coalesce("token_id", missing))


def special_entries(tokens: DataFrame) -> DataFrame:
    """(token, token_id): the special tokens and the entries after them; of equal tokens the last id counts."""
    spark = tokens.sparkSession
    specials = spark.createDataFrame(list(enumerate(SPECIALS)), "token_id int, token string").select("token", "token_id")
    return specials.unionByName(token_ids(tokens))


def categorical_entries(events: DataFrame) -> DataFrame:
    c = categories(events)
    return c.select("code", F.lit("categorical").alias("type"), F.array("category").alias("categories"), category_token(F.col("code"), F.array("category")).alias("token"))


def visit_tokens(events: DataFrame, starts: bool = True, ends: bool = True, days: bool = True, close_on_visit_only: bool = False) -> DataFrame:
    """(pid, pos, event_idx, token): events with visit marks and artificial time tokens, by windows only.

    events: pid, event_idx, is_visit, start, end, token. A visit of zero length emits nothing. Every other visit with
    an end gives one [VISIT END], before the first later event of its group that starts after it, else before the next
    visit, else last. Between visits the whole days since the previous end give [DAY n] (up to 1080) or [LONG TERM], or
    days, weeks and months; no days give the longest day token, as position -1 of the list of day tokens.

    close_on_visit_only: the other variant. Every visit counts, those of zero length too; an open visit closes before the
    first event after its end or at the next visit; there is no [VISIT START], nothing closes at the end of the timeline,
    and a visit that starts before the previous end fails.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    w = Window.partitionBy("pid").orderBy("event_idx")
    e = events.withColumns({"s": micros("start"), "t": micros("end")})
    real = F.col("is_visit") & (F.lit(close_on_visit_only) | ~(F.col("t").isNotNull() & (F.col("s") == F.col("t"))))
    e = e.withColumn("real", F.coalesce(real, F.lit(False)))
    e = e.withColumn("vseq", F.sum(F.col("real").cast("int")).over(w))
    e = e.withColumns({"vend": F.last(F.when(F.col("real"), F.struct("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["t"], "pend": F.last(F.when(F.col("real"), F.struct("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["t"]})
    group = Window.partitionBy("pid", "vseq")
    late = F.when(~F.col("real") & (F.col("vend") < F.col("s")), F.col("event_idx"))
    e = e.withColumns({"close_at": F.min(late).over(group), "last_of": F.max("event_idx").over(group), "last_idx": F.max("event_idx").over(Window.partitionBy("pid"))})
    e = e.withColumn("open_end", F.lag("close_at").over(w))
    gap = F.floor((F.col("s") - F.col("pend")) / 86_400_000_000)
    if days:
        att = F.when(gap.between(1, 1080), F.format_string("[DAY %d]", gap)).when(gap == 0, "[DAY 1080]").when(gap > 1080, "[LONG TERM]")
    else:
        att = F.when(gap == 0, "[DAY 6]").when(gap.between(1, 6), F.format_string("[DAY %d]", gap)).when(gap.between(7, 29), F.format_string("[WEEK %d]", F.floor(gap / 7))).when(gap.between(30, 359), F.format_string("[MONTH %d]", F.floor(gap / 30))).when(gap >= 360, "[LONG TERM]")
    if close_on_visit_only:
        starts = False
        att = F.when(gap < 0, F.raise_error(F.lit("a visit starts before the end of the previous one")).cast("string")).otherwise(att)
    yes = lambda on, test, mark: F.when(F.lit(on) & test, mark)
    # a visit whose group had no later event closes before the next visit, or at the end of the timeline
    before_visit = F.col("real") & (F.col("vseq") > 1) & F.col("open_end").isNull() & F.col("pend").isNotNull()
    after_last = F.lit(not close_on_visit_only) & (F.col("event_idx") == F.col("last_idx")) & (F.col("vseq") > 0) & F.col("close_at").isNull() & F.col("vend").isNotNull()
    inside = F.col("event_idx") == F.col("close_at")
    skip = F.col("is_visit") & ~F.col("real")
    own = F.array(yes(ends, before_visit | inside, "[VISIT END]"), F.when(F.col("real"), att), yes(starts, F.col("real"), "[VISIT START]"), F.when(~skip, F.col("token")), yes(ends, after_last, "[VISIT END]"))
    out = e.select("pid", "event_idx", F.posexplode(F.filter(own, lambda x: x.isNotNull())).alias("i", "token"))
    return out.select("pid", (F.row_number().over(Window.partitionBy("pid").orderBy("event_idx", "i")) - 1).alias("pos"), "event_idx", "token")
