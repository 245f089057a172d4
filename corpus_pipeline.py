"""From raw documents to packed training sequences.

Each stage works on all rows of the one before, written as Parquet and read again. Stages but the last keep the columns of documents.

Edge cases, as the operators that the stages call define them: null and empty texts have no words and go with the quality rules, where a stage is called alone they
pass near_dedup as one class, keep nothing in substring_dedup, take nothing in mix and are the end id in pack; texts of any length are worked on whole; of equal
rows near_dedup keeps one, and those that reach mix or pack alone each have a place; ties go by id; an empty table gives no rows at every stage; further columns,
whatever their names, stay until pack.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import mixing, packing, quality, simhash, substrings
from loam.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.FULL)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles; texts link at a Jaccard similarity of 0.8 or more, verified on whole sets."""
    return simhash.one_of_each(docs, shingle=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In training order: the files that hold the rows are in it, and so are the rows of each."""
    return mixing.ordered(docs).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs each file of the stage before by itself, so that sequences follow the curriculum from file to file."""
    try:
        path = docs.metadataColumn("_metadata")["file_path"]
        # files by their numbers, which have more digits from 100,000 files on
        order = F.concat(F.lpad(F.regexp_extract(path, r"part-(\d+)[^/]*$", 1), 12, "0"), F.lit(" "), path)
        docs.select(order)
    except AnalysisException:  # rows that aren't read from files have no order
        order = None
    return packing.pack(docs, order=order)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Fingerprint components and best-two-fit packing aren't expressible in SQL; tests/llm has a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
