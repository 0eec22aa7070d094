"""The corpus pipeline: five stages, each one of the operators, over documents.

Each stage works on all rows that its predecessor kept; all but the last return
the columns of documents. No stage crashes on nulls, empty or very long texts,
repeated rows, further columns or an empty table; the operators state what they
do with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import stored, table
from barloom.llm.entries import vocabulary
from barloom.llm.mixing import mixed_documents
from barloom.llm.near_duplicates import keep_one
from barloom.llm.personal_data import redact
from barloom.llm.piece_codec import piece_codec
from barloom.llm.quality_rules import keep_good

#: Near-duplicates of the pipeline: similarity in hundredths.
SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (those without 50 words among them)."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return keep_one(docs, least=SIMILAR)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows the text."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it (0 to 3 times)."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the decoded text of every document of the mix."""
    return piece_codec(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("source_mix", mixing_stage),
    ("piece_codec", encoding_stage),
]
ORACLE_SQL = None  # the stages are tested against brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
