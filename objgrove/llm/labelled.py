"""Labelled rows: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import text_or_empty

FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text, modulo FOLDS, is 0; such rows' labels are never learned. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> DataFrame:
    """(label, text) of at most per_class documents of each label, those of the smallest hashes.

    Ids labelled twice, in two ways, are left out. Longer texts than max_bytes are not learned from, so the sample is
    bounded in rows and in bytes.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").withColumn("h", F.xxhash64("id"))
    parts = [known.where(F.col("label") == k).orderBy("h", "id").limit(per_class).select("id", "label", "h") for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.octet_length("text") <= max_bytes)
    # at most 2 * per_class rows of three numbers
    return d.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id", "label", "h").agg(F.min("text").alias("text")).select("label", "h", "id", "text")
