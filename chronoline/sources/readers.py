"""Readers and writers: timelines, vocabularies, labels, result folders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = {"train": "train", "val": "tuning", "test": "held_out"}
ENTRY_TYPES = {"0": "code", "1": "numerical_range", "numeric": "numerical_range", "2": "categorical", "text": "categorical", "3": "unused", "unused": "unused", "code": "code"}


def read_meds(spark: SparkSession, path: str, split: str | None = None, zero_is_missing: bool = True) -> DataFrame:
    """A MEDS extract as events. zero_is_missing: a numeric value of 0 falls through to the text, as in the data's own reader."""
    data = spark.read.parquet(f"{path}/data")
    if split:
        ids = spark.read.parquet(f"{path}/metadata/subject_splits.parquet").where(F.col("split") == SPLITS[split]).select("subject_id")
        data = data.join(ids, "subject_id", "left_semi")
    number = F.col("numeric_value").cast("double")
    number = F.when(number != 0, number) if zero_is_missing else number
    has = lambda c, t: F.col(c) if c in data.columns else F.lit(None).cast(t)
    text = F.when(number.isNull(), has("text_value", "string"))
    # events keep the order that the file has them in; of equal times the first row of the file comes first
    data = data.withColumn("_row", F.monotonically_increasing_id())
    idx = (F.row_number().over(Window.partitionBy("subject_id").orderBy(F.col("time").asc_nulls_first(), "_row")) - 1).alias("event_idx")
    return data.select(F.col("subject_id").alias("pid"), idx, "code", number.alias("value_num"), text.alias("value_str"), has("unit", "string").alias("unit"), F.col("time").alias("start"), has("end", "timestamp").alias("end"), has("omop_table", "string").alias("omop_table"), has("hadm_id", "bigint").alias("hadm_id"))


def read_events(spark: SparkSession, path: str, splits: DataFrame | None = None, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Timelines from Parquet: of one split if it is named, of the named columns only."""
    out = spark.read.parquet(path)
    if split is not None:
        out = out.join(splits.where(F.col("split") == split).select("pid"), "pid", "left_semi")
    return out.select(*columns) if columns else out


def read_token_config(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tokenizer configuration (JSON) as a vocabulary; an unknown type fails."""
    schema = "tokens array<struct<code:string,type:string,description:string,tokenization:struct<unit:string,range_start:string,range_end:string,categories:array<string>>,stats:array<struct<type:string,dataset:string,split:string,count:bigint,model:string,ppl:double>>>>"
    rows = spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path, multiLine=True).select(F.posexplode("tokens").alias("entry_idx", "t"))
    known = F.when(F.col("t.type").isin("code", "numerical_range", "categorical"), F.col("t.type")).otherwise(F.raise_error(F.concat(F.lit("unknown token type: "), F.coalesce("t.type", F.lit("null")))).cast("string"))
    return rows.select("entry_idx", "t.code", known.alias("type"), "t.description", "t.tokenization.unit", F.col("t.tokenization.range_start").cast("double").alias("range_start"), F.col("t.tokenization.range_end").cast("double").alias("range_end"), "t.tokenization.categories", "t.stats")


def write_token_config(vocab: DataFrame, path: str) -> None:
    """A vocabulary as a tokenizer configuration that read_token_config reads: entries in order, with stats, one object
    with an array of tokens a file. Infinite ends of ranges are written as strings.

    A configuration is one object, so its entries meet in one task; larger vocabularies are kept as Parquet (write_table).
    """
    have = lambda c, t: F.col(c) if c in vocab.columns else F.lit(None).cast(t)
    ends = {c: F.when(F.isnan(have(c, "double")), None).otherwise(have(c, "double")).cast("string") for c in ("range_start", "range_end")}
    inner = F.struct(have("unit", "string").alias("unit"), *(e.alias(c) for c, e in ends.items()), have("categories", "array<string>").alias("categories"))
    entry = F.struct("code", "type", have("description", "string").alias("description"), inner.alias("tokenization"), have("stats", "array<string>").alias("stats"))
    rows = vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_idx", entry.alias("t")))), lambda x: x["t"]).alias("tokens"))
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_vocabulary(ids: DataFrame, vocab: DataFrame, path: str) -> None:
    """The ids of tokens and the filtered vocabulary that they belong to, as two tables below path."""
    ids.write.mode("overwrite").parquet(f"{path}/vocab")
    vocab.write.mode("overwrite").parquet(f"{path}/entries")


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A code dictionary with types by name or number, unused entries dropped, in file order; an unknown type fails."""
    schema = "regular array<struct<code_string:string,val_start:double,val_end:double,type:string,text_string:string,weight:double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("regular").alias("entry_idx", "r"))
    kind = F.create_map(*(F.lit(x) for kv in ENTRY_TYPES.items() for x in kv))[F.col("r.type")]
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce("r.type", F.lit("null")))).cast("string"))
    out = rows.select("entry_idx", F.col("r.code_string").alias("code"), kind.alias("type"), F.col("r.val_start").alias("range_start"), F.col("r.val_end").alias("range_end"), F.when(F.col("r.text_string").isNotNull(), F.array("r.text_string")).alias("categories"), F.col("r.weight").alias("weight"))
    return out.where("type <> 'unused'")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_texts(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A text corpus without blank rows."""
    return spark.read.parquet(path).where(F.trim(F.col(text)) != "")


def name_columns(path: Column, names: list[str], separator: str = "__") -> dict[str, Column]:
    """Columns from the parts of a file's name, such as model__context__task.csv."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return {c: F.split_part(name, F.lit(separator), F.lit(i + 1)) for i, c in enumerate(names)}


def score_file_columns(path: Column) -> dict[str, Column]:
    """model and step from a file name of the form val-ppl-model-step.parquet; null if it has another form."""
    at = lambda i, kind: F.when(path.rlike(r"val-ppl-[\w-]+-\d+\.parquet"), F.regexp_extract(path, r"val-ppl-([\w\-]+)-(\d+)\.parquet", i).cast(kind))
    return {"model": at(1, "string"), "step": at(2, "long")}


def history(rows: DataFrame, last_step: int, step: str = "_step") -> DataFrame:
    """(step, record): the rows of a run's log up to a step as JSON without their nulls."""
    return rows.where(F.col(step) <= last_step).select(F.col(step).alias("step"), F.to_json(F.struct(*rows.columns)).alias("record"))


def read_config(path: str) -> dict:
    """A JSON configuration; `name` and `metadata` must be there, a `metadata` of null is empty."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    missing = [k for k in ("name", "metadata") if k not in found]
    if missing:
        raise KeyError(", ".join(missing))
    return found | {"metadata": found["metadata"] or {}}


def vectors_of(arrays: dict, spark: SparkSession) -> DataFrame:
    """(pid, label_time, features, label): features kept as numpy arrays (data_matrix, patient_ids, labeling_time, label_values) as a table."""
    rows = zip(arrays["patient_ids"], arrays["labeling_time"], arrays["data_matrix"], arrays["label_values"])
    return spark.createDataFrame([(int(p), t, [float(x) for x in v], float(y)) for p, t, v, y in rows], "pid long, label_time timestamp, features array<double>, label double")


def write_parts(parts: list[tuple[str, DataFrame]], path: str) -> list[str]:
    """Writes named parts of a long computation one by one; those that are there whole already are not computed again. Returns those written."""
    written = []
    for name, df in parts:
        done = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if not done.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            written.append(name)
    return written


def read_results(spark: SparkSession, root: str, schema: str, levels: list[str], parameters: list[str] = []) -> DataFrame:
    """CSV files below nested folders; the folders' names become columns, outermost first, and the named parameters of a
    column `hparams` of JSON become columns too."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("escape", '"').csv(root, header=True).withColumn("_path", F.input_file_name())
    parts = F.split("_path", "/")
    for i, name in enumerate(levels):
        rows = rows.withColumn(name, F.element_at(parts, i - len(levels) - 1))
    for name in parameters:
        rows = rows.withColumn(name, F.get_json_object("hparams", f"$.{name}"))
    return rows.drop("_path")


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
