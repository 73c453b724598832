"""From raw documents to packed training sequences, in five stages of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import minhash, packing, pii, quality, suffix
from chronoline.llm.queries import KEY
from chronoline.llm.shared import drop_settled, settled_alone, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it learns from the labels of this stage's own documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.learnable(F.col("doc_id")))
    (score,) = unused(docs, "score")
    return quality.score(docs, quality.train(docs, labels), out=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id; documents without words all stay.

    Of rows that share a doc_id one stays, one with a text before one without; of equal rows without an id one stays.
    """
    name, order = unused(docs, "kept_id", "order")
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    # one shuffle by doc_id serves the join and the choice among rows of one id; rows without an id need no join
    named = docs.join(kept, docs.doc_id == F.col(name), "left_semi")
    first = F.min_by(F.struct(*docs.columns), F.struct(F.coalesce(F.length(F.trim("text")) == 0, F.lit(True)), F.xxhash64("text"), F.to_json(F.struct(*docs.columns))))
    one = named.groupBy("doc_id").agg(first.alias(order)).select(f"{order}.*")
    return one.unionByName(docs.where("doc_id is null").dropDuplicates())


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that stand elsewhere too."""
    out = suffix.remove_repeats(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pii.pseudonymize(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("private", hide_private), ("packing", pack)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        after = settled_alone(spark, lambda: stage(spark, docs, sf_dir))
        if i:
            drop_settled(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
