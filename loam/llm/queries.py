"""The operators' queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm import conversations, extraction, idfile, katz, media, mixing, negatives, packing, quality, simhash, substrings, toxicity, warc
from loam.llm.common import documents


def _of_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(documents(spark, sf_dir))


def _of(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _of_documents(quality.op1_quality_rules),
        "op2_toxicity": _toxicity,
        "op3_packing": _of_documents(packing.op3_packing),
        "op4_simhash": _of_documents(simhash.op4_simhash),
        "op5_media": _of_documents(media.op5_media),
        "op6_mixing": _of_documents(mixing.op6_mixing),
        "op7_katz": _of_documents(katz.op7_katz),
        "op8_token_ids": _of_documents(idfile.op8_token_ids),
        "op9_substrings": _of_documents(substrings.op9_substrings),
        "op10_extraction": _of("pages", extraction.op10_extraction),
        "op11_prefix_trie": _of("conversations", conversations.op11_prefix_trie),
        "op12_warc": _of("pages", warc.op12_warc),
        "op13_hard_negatives": _of("embeddings", negatives.op13_hard_negatives),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op11_prefix_trie": conversations.OP11_SQL,
        "op12_warc": warc.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
