"""From raw documents to packed training sequences, in stages that each work on all that the one before kept.

Defined results of every stage: an empty table gives an empty one; very long texts are worked on whole; null sources and ids are kept; further columns are kept as they are, whatever
their names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table, written
from barloom.llm.dedup import drop_near_duplicates
from barloom.llm.mixing import emit
from barloom.llm.packing import pack
from barloom.llm.pii import sanitise
from barloom.llm.quality import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines; null and empty texts go."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows that repeat an id give way to one of them."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data generalised, and terms that disclose it removed; every document stays."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: rows repeat, and those that the draw leaves out go."""
    return emit(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences; repeated rows are packed each by itself."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Hashes, registers and ids of a vocabulary have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
