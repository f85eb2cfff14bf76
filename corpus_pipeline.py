"""The corpus pipeline: each stage is one operator of spoor.llm over all that its predecessor kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's docs. All but the last return the columns of documents. Rows with nulls and rows that
repeat follow the operators' docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontamination, minhash, packing, pii, storage, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit_and_score(docs.select(*COLUMNS), labels, F.lit(True)).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of least doc_id."""
    return minhash.keep_one(docs.select(*COLUMNS), k=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage or its paraphrase go."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars is that of the new text. All documents stay."""
    found = pii.annotate(docs.select(*COLUMNS))
    changed = F.size("spans") > 0
    return found.select("doc_id", F.col("sanitized").alias("text"), "lang", "source", F.when(changed, F.char_length("sanitized").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", sanitise), ("packing", pack)]

#: A classifier and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), name)
    return docs
