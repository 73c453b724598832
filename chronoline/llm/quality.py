"""Quality scores from a sparse rule ensemble.

Boosted trees over statistics of the text give conjunctive rules (every path from a root); lasso logistic regression
keeps few of them; the rules and weights compile into one Spark column expression, so scoring needs no Python. The fit
reads a bounded sample of labelled rows (`bound`, chosen by hash); scoring covers every whole text.

A null or empty text has all statistics zero and is scored like any other; rows with null or other labels than 0 and 1
are not learnt from; repeated rows are scored alike; an empty table gives an empty result. If no labelled row is
given, or only one class, the score is the share of label 1 (0.5 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import unused

BOUND, TREES, DEPTH, BINS, PENALTY = 20_000, 24, 3, 24, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts by name; none depends on anything but the text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    lines = F.split(t, "\n")
    return {"chars": chars, "words": words, "lines": lines, "letters": F.regexp_count(t, F.lit(r"\p{L}+")), "upper": F.regexp_count(t, F.lit(r"\p{Lu}")), "digits": F.regexp_count(t, F.lit("[0-9]")), "shouts": F.regexp_count(t, F.lit("[!?]")), "symbols": F.regexp_count(t, F.lit(r"[#$%&*@~^|<>{}=_+\\/\[\]]")), "stops": F.regexp_count(t, F.lit("[.]")), "commas": F.regexp_count(t, F.lit("[,;:]"))}


#: Names of the inputs of the rules, in order.
INPUTS = ("words", "word_length", "distinct_words", "distinct_lines", "words_a_line", "letters", "upper", "digits", "shouts", "symbols", "stops", "commas")


def with_inputs(docs: DataFrame, text: str, to: str = "_x") -> DataFrame:
    """docs with the struct `to` of the rules' inputs."""
    raw = docs.withColumn(to, F.struct(*(c.alias(k) for k, c in statistics(F.col(text)).items())))
    s = lambda k: F.col(f"{to}.{k}")
    words, chars = F.size(s("words")).cast("double"), s("chars").cast("double")
    many, lines = F.greatest(words, F.lit(1.0)), F.size(s("lines")).cast("double")
    columns = {"words": words, "word_length": chars / many, "distinct_words": F.size(F.array_distinct(s("words"))) / many, "distinct_lines": F.size(F.array_distinct(s("lines"))) / lines, "words_a_line": words / lines, "letters": s("letters") / many} | {k: s(k) / chars for k in ("upper", "digits", "shouts", "symbols")} | {k: s(k) / many for k in ("stops", "commas")}
    return raw.withColumn(to, F.struct(*(columns[k].cast("double").alias(k) for k in INPUTS)))


@dataclass
class Rules:
    """A fitted ensemble: the intercept, and weighted conjunctions of (input, is_above, threshold)."""

    intercept: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]] = field(default_factory=list)

    def score(self, of: str = "_x") -> Column:
        total = F.lit(float(self.intercept))
        for weight, terms in self.rules:
            test = None
            for i, above, cut in terms:
                x = F.col(f"{of}.{INPUTS[i]}")
                one = x > cut if above else x <= cut
                test = one if test is None else test & one
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, terms in self.rules:
            total += weight * np.all([x[:, i] > cut if above else x[:, i] <= cut for i, above, cut in terms], axis=0)
        return 1 / (1 + np.exp(-total))


def grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """One tree of Newton steps by binned splits: its value for the rows, and all its paths into `out`."""
    value = np.full(len(rows), -g[rows].sum() / (h[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 20:
        return value
    best = (1e-6, None)
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        c = codes[rows, j]
        gs, hs = (np.cumsum(np.bincount(c, weights=w[rows], minlength=len(cut) + 1))[:-1] for w in (g, h))
        n = np.cumsum(np.bincount(c, minlength=len(cut) + 1))[:-1]
        gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - base
        gain[(n < 10) | (n > len(rows) - 10)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (j, k))
    if best[1] is None:
        return value
    j, k = best[1]
    above = codes[rows, j] > k
    for side in (False, True):
        terms = (*path, (j, side, float(cuts[j][k])))
        out.append(terms)
        value[above == side] = grow(codes, cuts, g, h, rows[above == side], depth - 1, terms, out)
    return value


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Rules from boosted trees, weighted by lasso logistic regression (proximal gradient with momentum)."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Rules(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    at = np.full(len(y), np.log(share / (1 - share)))
    paths: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        at = at + 0.3 * grow(codes, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, (), paths)
    paths = list(dict.fromkeys(paths))
    masks = np.stack([np.all([x[:, i] > cut if above else x[:, i] <= cut for i, above, cut in terms], axis=0) for terms in paths], axis=1).astype(np.float64)
    scale = np.maximum(masks.std(0), 1e-3)
    z = (masks - masks.mean(0)) / scale
    step = 4.0 * len(y) / np.linalg.norm(z, 2) ** 2
    w, v, b, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), float(np.log(share / (1 - share))), 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        new = v - step * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4.0 * float((p - y).mean())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    w = w / scale
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(b - (w * masks.mean(0)).sum()), [(float(w[k]), paths[k]) for k in keep])


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, key: str = "doc_id", text: str = "text", label: str = "quality") -> Rules:
    """Rules from at most `bound` labelled rows, the least by a hash of their key."""
    some = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("double").alias("_y"))
    some = some.orderBy(F.xxhash64("_k"), "_k").limit(bound)
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(some), "_k")  # at most `bound` rows of 16 bytes
    rows = with_inputs(sample, "_t").select("_y", *(f"_x.{c}" for c in INPUTS)).orderBy(F.xxhash64("_k"), "_k").limit(2 * bound).collect()
    held = np.array([list(r) for r in rows], float).reshape(-1, len(INPUTS) + 1)
    return fit(held[:, 1:], held[:, 0])


def score(docs: DataFrame, rules: Rules, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`, 0 to 1, higher where label 1 is likelier."""
    rest = docs.drop(out)
    (x,) = unused(rest, "x")
    return with_inputs(rest, text, x).withColumn(out, rules.score(x)).drop(x)


def learnable(key: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the key as text, modulo 3, is not 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1
