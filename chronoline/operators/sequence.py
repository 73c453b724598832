"""Token sequences: padding, cutting, masking, windows and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.splits import hash_rank

BOS, EOS, UNK, SEP, PAD, CLS, MASK = range(7)


def sequences(tokens: DataFrame, order: str = "event_idx", value: str = "token_id") -> DataFrame:
    """(pid, ids): the ids of each timeline in order."""
    return tokens.where(F.col(value).isNotNull()).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("ids"))


def lengths(patients: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pid, length) without special tokens; an empty timeline counts as one PAD."""
    n = tokens.where("token is not null").groupBy("pid").agg(F.count("*").alias("n"))
    return patients.select("pid").join(n, "pid", "left").select("pid", F.coalesce("n", F.lit(1)).cast("long").alias("length"))


def with_specials(ids: Column) -> Column:
    ids = F.when(F.size(ids) == 0, F.array(F.lit(PAD))).otherwise(ids)
    return F.concat(F.array(F.lit(CLS), F.lit(BOS)), ids, F.array(F.lit(EOS)))


def right_pad(ids: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.slice(ids, F.lit(1), size), F.array_repeat(F.lit(PAD), F.greatest(size - F.size(ids), F.lit(0))))


def last_chunk(ids: Column, size: int) -> Column:
    """The last `size` ids, padded on the left."""
    n = F.size(ids)
    tail = F.slice(ids, F.greatest(n - size + 1, F.lit(1)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(PAD), F.greatest(F.lit(size) - n, F.lit(0))), tail)


def token_type_ids(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lit(0))


def distinct_tokens(ids: Column) -> Column:
    """The number of different ids of a sequence, padding aside."""
    return F.size(F.array_distinct(F.array_remove(ids, F.lit(PAD))))


def flattened(nested: Column) -> Column:
    return F.flatten(nested)


def collate(sequences_: DataFrame, by: list[str], ids: str = "ids", context: int | None = None) -> DataFrame:
    """Model inputs of each batch (by): input_ids padded to the batch's longest, token_type_ids, attention_mask, and labels.

    Labels are the ids themselves, as a causal model shifts them. Empty sequences stay in place as padding only, so
    that rows and patients stay aligned. context cuts longer sequences.
    """
    x = F.slice(F.col(ids), 1, context) if context else F.col(ids)
    longest = sequences_.groupBy(*by).agg(F.max(F.size(x)).alias("_longest"))
    out = sequences_.join(longest, by).withColumn("input_ids", right_pad(x, F.col("_longest"))).drop("_longest")
    return out.withColumns({"token_type_ids": token_type_ids(F.col("input_ids")), "attention_mask": attention_mask(F.col("input_ids")), "labels": F.col("input_ids")})


def accumulation(max_tokens: int, tokens_a_step: int = 65_536) -> int:
    """Batches that make up one step of the optimizer; max_tokens must divide the tokens of a step."""
    if tokens_a_step % max_tokens:
        raise ValueError(f"{max_tokens} tokens a batch do not divide {tokens_a_step} tokens a step")
    return tokens_a_step // max_tokens


def random_cut(ids: Column, key: Column, size: int, seed: int = 0) -> Column:
    """A run of `size` ids from a place drawn by hash; shorter sequences stay whole."""
    start = F.pmod(hash_rank(key, seed), F.greatest(F.size(ids) - size + 1, F.lit(1))).cast("int")
    return F.slice(ids, start + 1, F.lit(size))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != PAD).cast("int"))


def mask_tokens(ids: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Masked-language-model inputs, one row per place: (pid, pos, input_id, label).

    15 % of the ids that are not special are chosen by hash; of these 80 % become MASK, 10 % another id, 10 % stay;
    the label is the id where chosen, else -100. ids: (pid, pos, token_id).
    """
    draw = lambda k: F.pmod(hash_rank(F.col("pid") * 4099 + F.col("pos") * 31 + k, seed), F.lit(10000))
    chosen = (F.col("token_id") > MASK) & (draw(1) < 1500)
    other = (F.lit(MASK + 1) + F.pmod(draw(3), F.lit(size - MASK - 1))).cast("int")
    new = F.when(chosen & (draw(2) < 8000), F.lit(MASK)).when(chosen & (draw(2) < 9000), other).otherwise(F.col("token_id"))
    return ids.select("pid", "pos", new.cast("int").alias("input_id"), F.when(chosen, F.col("token_id")).otherwise(F.lit(-100)).cast("int").alias("label"))


def chunks(lengths_: DataFrame, size: int, length: str = "length") -> DataFrame:
    """(pid, chunk_idx, start, end) for every chunk of `size` tokens."""
    n = F.ceil(F.col(length) / size).cast("int")
    i = F.col("chunk_idx")
    return lengths_.where(F.col(length) > 0).select("pid", length, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx")).select("pid", "chunk_idx", (i * size).cast("long").alias("start"), F.least((i + 1) * size, F.col(length)).cast("long").alias("end"))


def stride_windows(lengths_: DataFrame, size: int, stride: int, length: str = "length") -> DataFrame:
    """(pid, begin, end, n_targets): windows for scoring every token but the first once; the last window ends at the end."""
    n = F.col(length)
    rows = lengths_.where(n >= 2).select("pid", n.alias("n"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(stride))).alias("at"))
    rows = rows.withColumn("end", F.least(F.col("at") + size, F.col("n")))
    previous = F.lag("end").over(Window.partitionBy("pid").orderBy("at"))
    rows = rows.withColumn("prev", previous).where("prev is null or prev < n")
    return rows.select("pid", F.greatest(F.least(F.col("at"), F.col("end") - size), F.lit(0)).cast("long").alias("begin"), F.col("end").cast("long").alias("end"), (F.col("end") - F.coalesce("prev", F.lit(1))).cast("long").alias("n_targets"))


def shuffled(ordered: DataFrame, bucket: int, within: bool = False, across: bool = False, key: str = "pid", seed: int = 0) -> DataFrame:
    """Ranked rows (key, rank, bucket) dealt anew: rows within their bucket, and buckets among themselves, by hash.

    The last bucket, which may be short, stays last. The seed is the same each epoch unless it is changed.
    """
    out = ordered
    if within:
        own = F.row_number().over(Window.partitionBy("bucket").orderBy(hash_rank(F.col(key), seed), key)) - 1
        out = out.withColumn("rank", (F.col("bucket") * bucket + own).cast("long"))
    if across:
        buckets = out.groupBy("bucket").agg(F.count("*").alias("_n"))  # one row a bucket
        place = F.row_number().over(Window.orderBy(F.col("_n") < bucket, hash_rank(F.col("bucket"), seed), "bucket")) - 1
        out = out.join(buckets.select("bucket", place.alias("_place")), "bucket")
        out = out.withColumn("rank", (F.col("_place") * bucket + F.col("rank") % bucket).cast("long")).withColumn("bucket", F.col("_place").cast("long")).drop("_place")
    return out


def loader(lengths_: DataFrame, split: str, max_tokens: int, context: int, bucket: int, all_chunks: bool = False, key: str = "pid", seed: int = 0) -> DataFrame:
    """(split, rank, batch_idx, key, length) as a model reads them: training data in shuffled buckets of like length (not
    within the buckets if a patient's chunks stay together), other splits in plain order of length, one row a bucket."""
    train = split == "train"
    ranked = sortish_buckets(lengths_, bucket if train else 1, key)
    ranked = shuffled(ranked, bucket, not all_chunks, True, key, seed) if train else ranked
    ranked = ranked.select(F.lit(split).alias("split"), F.col("rank").cast("long").alias("rank"), key, "length")
    return batches(ranked, max_tokens, context).join(ranked, ["split", "rank"])


def sortish_buckets(lengths_: DataFrame, bucket: int, key: str = "pid", length: str = "length", second: str | None = None) -> DataFrame:
    """(key, length, rank, bucket): longest first, ties by the second key if there is one, then by key, in buckets of `bucket` rows.

    Ranks come from the counts of lengths and a rank within each length, so only one row per length meets in one task.
    """
    counts = lengths_.groupBy(length).agg(F.count("*").alias("_n"))
    before = counts.select(length, (F.sum("_n").over(Window.orderBy(F.col(length).desc())) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(length).orderBy(*([second] if second else []), key)) - 1
    out = lengths_.withColumn("_own", own).join(before, length)
    return out.select(key, length, (F.col("_before") + F.col("_own")).alias("rank")).withColumn("bucket", F.floor(F.col("rank") / bucket))


def batches(ordered: DataFrame, max_tokens: int, context: int, max_examples: int = 1 << 30, batch_mult: int = 1, start: int = 0) -> DataFrame:
    """(split, rank, batch_idx): greedy batches of at most max_tokens padded tokens, in rank order within each split.

    ordered: (split, rank, length). A batch takes an example while (size + 1) x the longest, cut to the context, fits.
    When the next one does not fit, the batch goes out with the greatest multiple of batch_mult that it holds, one
    example at least, and hands the rest on; when it holds max_examples, it goes out whole. Batches before `start` are
    left out, but what is left at the end always goes out. The fold is sequential by nature: a split is one group.
    """
    if max_tokens < context:
        raise ValueError("max_tokens must be at least the context length")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        out, held, no = [], [], 0
        longest = 0
        for rank, length in zip(pdf["rank"].tolist(), pdf["length"].tolist()):
            size = min(length, context)
            while held and (len(held) + 1) * max(longest, size) > max_tokens:
                keep = max(1, len(held) // batch_mult * batch_mult)
                out += [(r, no) for r, _ in held[:keep]]
                held, no = held[keep:], no + 1
                longest = max((s for _, s in held), default=0)
            held.append((rank, size))
            longest = max(longest, size)
            if len(held) == max_examples:
                out += [(r, no) for r, _ in held]
                held, no, longest = [], no + 1, 0
        rows = pd.DataFrame([x for x in out if x[1] >= start] + [(r, no) for r, _ in held], columns=["rank", "batch_idx"])
        rows.insert(0, "split", pdf["split"].iloc[0])
        return rows

    return ordered.select("split", "rank", "length").groupBy("split").applyInPandas(run, "split string, rank long, batch_idx long")


def replicas(batched: DataFrame, n: int) -> DataFrame:
    """batched with `replica`: contiguous runs of floor(batches / n) batches each; the remainder is dropped."""
    each = batched.groupBy("split").agg(F.floor((F.max("batch_idx") + 1) / n).alias("_each"))
    out = batched.join(F.broadcast(each), "split").withColumn("replica", F.floor(F.col("batch_idx") / F.col("_each")))
    return out.where((F.col("_each") > 0) & (F.col("replica") < n)).drop("_each")


def pooled(vectors: DataFrame, key: str, ids: str, vector: str, how: str = "mean") -> DataFrame:
    """(key, dim, value): vectors of places that are not PAD pooled by mean, max, first or last."""
    rows = vectors.select(key, F.posexplode(F.arrays_zip(F.col(ids).alias("i"), F.col(vector).alias("v"))).alias("pos", "z")).where(F.col("z.i") != PAD)
    rows = rows.select(key, "pos", F.posexplode("z.v").alias("dim", "x"))
    agg = {"mean": F.avg("x"), "max": F.max("x"), "first": F.min_by("x", "pos"), "last": F.max_by("x", "pos")}[how]
    return rows.groupBy(key, "dim").agg(agg.alias("value"))
