"""A training-data pipeline of five operators; each stage is written as Parquet and read as the next one's documents.

Stages use the five columns of documents alone, whatever others a table has; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language, mixing, packing, simhash, spans
from tracewright.llm.common import written
from tracewright.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known by a clear margin; the prediction is their language from here on.

    Null texts, texts without a letter and near ties go; null ids and repeated rows are rows like any other.
    """
    found = language.classify(docs.select(*COLUMNS)).where(~F.col("rejected"))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: the smallest id, null ids last; of repeated rows one."""
    return simhash.keep_one_of_each(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has, null ids before all; those with no word left go."""
    cleaned = spans.remove_repeats(docs.select(*COLUMNS))
    cleaned = cleaned.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; null sources are one source, the last."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the mix, packed into sequences of 2048 tokens; a null text is its end alone."""
    return packing.pack(docs.select("doc_id", "text"), public_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: The classifier, fingerprints and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
