"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import language, quality
from hushframe.llm.common import remainder, written
from hushframe.llm.decontaminate import decontaminate
from hushframe.llm.neardup import representatives
from hushframe.llm.packing import pack


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels of op6_quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0)
    weights = quality.train(docs, labels)
    return docs.where(quality.score(spark, weights, F.col("text")) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The filters learn from what came in."""
    learned = language.train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    told = language.identify(spark, learned, F.col("text"))
    return docs.where(told["told"])


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, each window mixed from the sources."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_language),
    ("jaccard_join", keep_representatives),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
