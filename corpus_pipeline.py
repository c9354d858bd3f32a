"""A training-data pipeline over `documents`: quality, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hybridctx.llm import exact_dedup, mixing, near_dup, packing, quality
from hybridctx.llm.common import stored, table
from hybridctx.llm.queries import END_ID


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranker rejects go; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_exact(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (the smallest id)."""
    return near_dup.keep_one_per_group(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it: 0 to 3 rows."""
    return mixing.keep_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents (repeats are packed as documents of their own) in sequences of up to 4096 ids."""
    return packing.pack(docs, packing.document_ids(public_tokenizers.path("word_bpe_49k.json"), END_ID))


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", mix_to_targets),
    ("packing", pack_sequences),
]

#: The fitted classifier, sketches and tokenizers have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
