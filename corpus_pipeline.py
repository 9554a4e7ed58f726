"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents.  A row without an id passes the stages that go by ids.  Labels are read from
``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import mixing, ngram_join, packing, store, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more of five-word shingles the first stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start more than once go."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, each with its sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_strings", cut_repeats), ("mixing", mix_sources), ("packing", pack_sequences)]
#: SQL expresses neither the models nor the draws; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = store.new_path(spark, name)
        with store.scope(spark):  # what the stage wrote on its way goes when its result is written
            docs = store.written(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
