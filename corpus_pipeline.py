"""The corpus pipeline: the STAGES in order, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on all the rows it is given; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segstats.llm import exact, mixing, packing, simhash, toxicity
from segstats.llm.common import prepare, table
from segstats.scale import settle


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents classed as toxic go; the classifier learns from the labels of the documents that are there."""
    prepare(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    prepare(spark)
    return exact.keep_first_seen(docs, exact.DigestIndex(spark))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles similar to 0.8 or more, the row with the smallest doc_id stays."""
    prepare(spark)
    return simhash.keep_one_of_similar(docs)


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, up to three copies of each, so that every source comes near its target."""
    prepare(spark)
    return mixing.mix_documents(docs)


def sequences_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("exact dedup", exact_copies_go),
    ("near dedup", near_copies_go),
    ("mixing", sources_are_mixed),
    ("packing", sequences_are_packed),
]

#: No SQL expresses the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
