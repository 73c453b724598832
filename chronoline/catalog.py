"""Building a vocabulary step by step: manifest of finished steps, checks, versions, visit and time tokens."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.functions.expressions import prefix

STAT = "array<struct<type:string,dataset:string,split:string,count:bigint,model:string,ppl:double>>"


def attach_counts(vocab: DataFrame, counts: DataFrame, dataset: str, split: str, kind: str = "count_occurrences", n: str = "n") -> DataFrame:
    """vocab with a stat appended to the entries whose token has a count; others get none. counts: (token, n)."""
    stat = F.struct(F.lit(kind).alias("type"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col("_n").cast("bigint").alias("count"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("ppl"))
    before = F.coalesce("stats", F.array().cast(STAT)) if "stats" in vocab.columns else F.array().cast(STAT)
    out = vocab.join(counts.select("token", F.col(n).alias("_n")), "token", "left")
    return out.withColumn("stats", F.when(F.col("_n").isNotNull(), F.concat(before, F.array(stat))).otherwise(before)).drop("_n")


def visit_time_entries(spark: SparkSession, first: int = 0) -> DataFrame:
    """(entry_idx, code, type, token): visit marks, days 0 to 6, weeks 0 to 3, months 0 to 11 and the long term, as plain codes.

    Days are numbered from 1 to 6, weeks from 1 to 4, months from 1 to 12.
    """
    marks = ["[VISIT START]", "[VISIT END]", *(f"[DAY {i}]" for i in range(1, 7)), *(f"[WEEK {i}]" for i in range(1, 5)), *(f"[MONTH {i}]" for i in range(1, 13)), "[LONG TERM]"]
    rows = [(first + i, m, "code", m) for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, "entry_idx int, code string, type string, token string")


def problems(vocab: DataFrame, excluded: list[str] = [], counts: bool = False) -> DataFrame:
    """(problem, n): what is wrong with a vocabulary, no rows if nothing is: no code, a category entry without categories,
    a range without ends or upside down, no count where counts are wanted, an excluded vocabulary."""
    kind = F.col("type")
    tests = {
        "no code": F.coalesce(F.col("code") == "", F.lit(True)),
        "no categories": (kind == "categorical") & (F.coalesce(F.size("categories"), F.lit(0)) <= 0),
        "no range": (kind == "numerical_range") & (F.col("range_start").isNull() | F.col("range_end").isNull() | (F.col("range_start") > F.col("range_end"))),
        "no count": F.lit(counts) & (F.coalesce(F.size("stats"), F.lit(0)) <= 0) if "stats" in vocab.columns else F.lit(counts),
        "excluded vocabulary": F.lower(prefix(F.col("code"))).isin([x.lower() for x in excluded]) if excluded else F.lit(False),
    }
    if "categories" not in vocab.columns:
        del tests["no categories"]
    wide = vocab.agg(*(F.coalesce(F.sum(F.coalesce(t, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, t in tests.items()))
    return wide.unpivot([], list(tests), "problem", "n").where("n > 0")


def check(vocab: DataFrame, excluded: list[str] = [], counts: bool = False) -> None:
    """Fails with what is wrong with a vocabulary."""
    found = problems(vocab, excluded, counts).collect()  # five rows at most
    if found:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']}" for r in found))


class Manifest:
    """A JSON file of metadata and of the steps that are done, so that a build can be started again."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> dict:
        if not os.path.exists(self.path):
            return {"metadata": {}, "done": []}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def write(self, content: dict) -> None:
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(content, f, sort_keys=True, indent=1)
        os.replace(f"{self.path}.new", self.path)

    def run(self, name: str, step: Callable[[], None]) -> bool:
        """Runs a step unless it is marked as done; it is marked only after it has ended. True if it ran."""
        content = self.read()
        if name in content["done"]:
            return False
        step()
        self.write(content | {"done": [*content["done"], name]})
        return True


#: Keys of metadata that say nothing about what a version holds, and those that hold a path of which only the last part counts.
IGNORED, PATHS = ("is_already_run", "done", "timestamp"), ("path_to_extract", "path_to_dataset")


def fingerprint(metadata: dict) -> str:
    """A name for metadata: equal if all keys and values are, paths by their last part, whatever the order."""
    plain = {k: os.path.basename(str(v).rstrip("/")) if k in PATHS else v for k, v in metadata.items() if k not in IGNORED}
    return hashlib.md5(json.dumps(plain, sort_keys=True).encode()).hexdigest()


def version_dir(root: str, metadata: dict) -> tuple[str, bool]:
    """The folder of the version with this metadata, and whether it was there before."""
    path = os.path.join(root, "versions", fingerprint(metadata))
    known = os.path.exists(os.path.join(path, "metadata.json"))
    if not known:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, "metadata.json"), "w", encoding="utf-8") as f:
            json.dump(metadata, f, sort_keys=True)
    return path, known


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first if it is not there whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
