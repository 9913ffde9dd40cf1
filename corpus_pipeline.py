"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

Stages work on everything their predecessor kept. All but the last return the columns of ``documents``; where a stage
changes texts, n_chars follows. The last gives a document's ids instead of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpick.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from labelpick.llm.common import documents, materialize
from labelpick.llm.queries import tokenizer_path


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars of the changed texts, in the type it had."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model is trained on their labels."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines found in 10 or more documents. Whole copies are left to the next stage."""
    return _measured(line_dedup.drop_repeated_lines(docs, min_docs=10, spare_copies=True), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by a Jaccard similarity of five-word n-grams of 0.8 or more."""
    return jaccard_join.keep_one_of_each(docs, n=5, threshold=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents of which they cover more than half go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate.remove_benchmark(docs, items, window=10, max_coverage=0.5), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit numbers), and whether decoding gives it back."""
    return bpe.tokenize(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("jaccard_join", drop_near_copies),
          ("decontaminate", drop_benchmark), ("bpe", tokenize)]

# SQL can't express the trained model of the first stage; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
