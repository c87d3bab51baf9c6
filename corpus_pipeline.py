"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the
last return the columns of documents.  Stages judge rows, not ids: rows with null or repeated doc_ids
stay or go by their text.  Empty tables stay empty, long texts are read whole, and names of other
columns don't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tectra.llm import exact_dedup, language, mixing, near_dedup, packing
from tectra.llm.common import remove, scratch_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages that the labelled rows teach; null, empty and letterless texts go."""
    return language.keep_known_languages(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space, that of the smallest doc_id; those without a doc_id stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: one document of each group; those without a doc_id stay."""
    return near_dedup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice is there twice, one it leaves is not."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens of all documents, one row a piece; every copy is packed."""
    return packing.packed(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("packing", sequences),
]

#: Classification, LSH and seeded rounding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's table is deleted when the next one is written; the last one's input stays until
    the driver ends, since the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
