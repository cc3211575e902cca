"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept, written as Parquet and read again:

1. quality rules: documents that they reject go;
2. line dedup: lines that repeat earlier ones go, documents stay;
3. SimHash near-dedup: one document of each group stays;
4. mixing: documents repeat or go so that sources meet their target weights;
5. packing: the pieces of what is left, with their places in sequences of 1024 tokens.

A null text counts as empty; equal rows, ties, empty tables and further columns are handled as
the operators' docstrings say. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideguard.llm import lines, mixing, packing, quality, simhash
from tideguard.llm.common import table
from tideguard.llm.queries import ranks_file
from tideguard.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, ranks_file())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Fingerprints and tokens are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
