"""The corpus pipeline: each stage works on all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import decontaminate, language, line_dedup, pieces, simhash
from quotemill.llm.common import saved
from quotemill.llm.queries import piece_model, read

# Language identification, line cutting and piece ids have no SQL form as a whole; the pipeline
# is tested against brute-force versions of its stages.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no learned language go."""
    return language.accepted(docs)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 3 documents share stay only in the one with the largest doc_id."""
    return line_dedup.without_repeated(docs, least_chars=20, least_docs=3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return simhash.keep_first(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), size=5, containment=0.8)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, with the digests of the encoding query."""
    return pieces.digests(pieces.encode(docs, piece_model()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", cut_lines),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
