"""A training-data pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to shared storage and read again as the
next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import golay_simhash, mil_quality, packing, resemblance, toxic_segments
from quern.llm.common import discard, materialize, plain_reads, small_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with toxic passages; learns from the labelled documents of ``sf_dir``."""
    small_batches(spark)
    plain_reads(spark)
    model = toxic_segments.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxic_segments.without_toxic(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality; learns from the labelled documents of ``sf_dir``."""
    small_batches(spark)
    plain_reads(spark)
    model = mil_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mil_quality.of_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints of the shingles and their Golay keys propose the links within three bits, minimum hashes those
    beyond; all links are verified.
    """
    small_batches(spark)
    plain_reads(spark)
    return golay_simhash.one_of_each_group(docs, resemblance.near_duplicates)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of at most 2048 tokens."""
    small_batches(spark)
    plain_reads(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned models, connected components and packing have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
