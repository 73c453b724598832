"""Column expressions: Python's float notation, buckets, n-grams, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_float_str(x: Column) -> Column:
    """A double as Python's repr shows it: inf, 1e+20, 10000000.0 where Spark shows Infinity, 1.0E20, 1.0E7."""
    s = x.cast("string")
    mantissa, power = F.split_part(s, F.lit("E"), F.lit(1)), F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, "[-.]", ""), "0+$", "")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    plain = F.when(power >= 0, F.concat(sign, F.rpad(digits, power + 1, "0"), F.lit("."), F.when(F.length(digits) > power + 1, F.substr(digits, power + 2)).otherwise("0"))).otherwise(F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    whole = F.when(F.length(digits) > power + 1, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0")))
    far = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    return F.when(x.isNull(), "None").when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(~s.contains("E"), s).when((power >= -4) & (power < 0), plain).when((power >= 0) & (power < 16), F.concat(sign, whole)).otherwise(far)


def range_token(code: Column, unit: Column, start: Column, end: Column) -> Column:
    return F.concat(code, F.lit(" || "), F.coalesce(unit, F.lit("None")), F.lit(" || "), py_float_str(start), F.lit(" - "), py_float_str(end))


def category_token(code: Column, categories: Column) -> Column:
    return F.concat(code, F.lit(" || "), F.array_join(categories, ","))


def prefix(code: Column) -> Column:
    """The vocabulary a code belongs to: what stands before the first slash."""
    return F.split_part(code, F.lit("/"), F.lit(1))


def md5_uuid(x: Column) -> Column:
    return F.regexp_replace(F.md5(x.cast("string").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def ngrams(items: Column, n: int) -> Column:
    """Sliding runs of n items; none if there are fewer. The items are bound once, not evaluated for every run."""
    runs = lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.array().cast("array<array<string>>"))
    return F.get(F.transform(F.array(items), runs), F.lit(0))


def remap_range(value: Column, ranges: list[tuple[float, float]]) -> Column:
    """R1, R2, ... by the first inclusive range that holds the value, else R0."""
    out = F.lit(None).cast("string")
    for i, (a, b) in reversed(list(enumerate(ranges, 1))):
        out = F.when(value.between(a, b), f"R{i}").otherwise(out)
    return F.coalesce(out, F.lit("R0"))


def remap_quantile(value: Column, cuts: list[float]) -> Column:
    """Q1, Q2, ... by the first cut that is not below the value, else Q0."""
    out = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(cuts, 1))):
        out = F.when(value <= c, f"Q{i}").otherwise(out)
    return F.coalesce(out, F.lit("Q0"))


def learning_rate(step: Column, warmup: int, decay: int, initial: float, final: float, peak: float) -> Column:
    """Multiplier of the peak rate: linear warm-up, linear decay, plateau."""
    return F.when(step < warmup, (initial + (peak - initial) * step / warmup) / peak).when(step < warmup + decay, (peak + (final - peak) * (step - warmup) / decay) / peak).otherwise(final / peak)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(logits, lambda x: x - top - F.log(total))
