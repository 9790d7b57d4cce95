"""Corpus preparation: quality filter, near-duplicate removal, benchmark
decontamination, masking of personal data, packing.

Each stage gets the documents that its predecessor kept, rereads them from
Parquet in the shared folder, and its decisions take effect. All but the last
return the columns of documents; they need doc_id and text, and hand on
whatever other columns there are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import decontaminate, neardup, packing, pii, quality
from slotwise.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with all their
    columns. Null and empty texts are scored by their statistics, very long
    ones whole, repeated rows alike; without labels of both kinds nothing is
    rejected; an empty table stays empty."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id,
    with all its columns. Null and empty texts are one class; a row that
    repeats another goes; long texts are compared whole; an empty table stays
    empty."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns. Null and
    empty texts hold none; long ones are searched whole; repeated rows stay or
    go together; with an empty table on either side nothing goes."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked and, if there is
    one, n_chars counted anew. Null texts stay null; long ones are masked
    throughout; repeated rows stay alike; an empty table stays empty."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or
    empty text is one token; long ones are cut; repeated rows are packed once
    per row; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages' models and walks are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages the documents are written to a
    new folder under spark.checkpoint.dir; only a local session may do without
    that setting."""
    folder, docs = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
