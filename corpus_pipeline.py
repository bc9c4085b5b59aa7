"""A corpus pipeline: toxicity, near duplicates, repeated passages, the mix, and packing.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the next one gets it as its docs. All but the
last keep the columns of documents. A stage writes what it reads several times in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from objgrove.llm import jaccard, mixing, packing, suffix, toxicity
from objgrove.llm.common import new_folder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that are linked by a similarity of 0.8 or more, the one of the smallest id stays."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of a smaller id has go from the texts; n_chars follows."""
    return suffix.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", one_of_near_copies), ("repeated passages", cut_repeats), ("mix", mix_sources), ("packing", pack)]

#: Tokens and compressed lengths are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), new_folder(spark, f"pipeline-{name.replace(' ', '-')}"))
    return STAGES[-1][1](spark, docs, sf_dir)
