"""Readers of article corpora, and what a search for articles is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import EXCLUDED_SECTIONS, LICENCE_FILTERS
from loam.functions import text as T

# fixed value: what a search must not find
INTEGRITY = 'NOT "pmc embargo"[filter] NOT articletyperetraction NOT hasretractionin NOT articletypeexpressionofconcern NOT hasexpressionofconcernin NOT articletypecorrection'
_PASSAGES = "array<struct<documents:array<struct<passages:array<struct<infons:map<string,string>,section_type:string,text:string>>>>>>"


def jsonl(spark: SparkSession, paths: str | Sequence[str], schema) -> DataFrame:
    """Lines of JSON of a declared schema; blank lines are skipped, malformed ones raise. ``_input_source`` is each row's file."""
    df = spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths), mode="FAILFAST")
    return df.withColumn("_input_source", F.col("_metadata.file_path"))


def eos_chunks(files: DataFrame, mark: str = "<eos>") -> DataFrame:
    """``files`` (stem, text, ...) to a row per chunk that isn't blank: i counts blank ones too; id is stem-i-hash."""
    parts = files.select(*[c for c in files.columns if c != "text"], F.posexplode(F.split("text", mark, -1)).alias("i", "c"))
    parts = parts.withColumns({"text": T.strip(F.col("c")), "i": F.col("i").cast("long")}).drop("c").filter("text <> ''")
    return parts.withColumn("id", F.concat_ws("-", "stem", F.col("i").cast("string"), F.substring(T.content_hash(F.col("text")), 1, 16)))


def eos_files(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("_input_source"))
    return eos_chunks(f)


def records(spark: SparkSession, paths: Sequence[str], schema) -> DataFrame:
    """Files by suffix, all together."""
    out = None
    for p in paths:
        df = jsonl(spark, p, schema) if p.endswith(".jsonl") else eos_files(spark, p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no input")
    return out


def one_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def instruction_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of instructions, any of whose fields may be missing; ``ord`` is a row's place by file and line."""
    df = spark.read.schema("id string, instruction string, context string, response string").json(path, mode="FAILFAST")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return df.select("id", "instruction", F.coalesce("context", F.lit("")).alias("context"), "response", place.alias("ord"))


def query_text(query: Column, licence: Column) -> Column:
    return F.concat(F.lit("("), query, F.lit(") AND "), licence, F.lit(f" {INTEGRITY}"))


def query_plan(spark: SparkSession, topics: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Every topic with every licence filter. Both are small literals; the product is made by exploding an array."""
    t = spark.createDataFrame([(name, q) for name, q, _ in topics], "topic string, q string")
    licences = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(v).alias("f")) for k, v in LICENCE_FILTERS.items()])
    return t.select("topic", "q", F.inline(licences)).select("topic", "licence", query_text(F.col("q"), F.col("f")).alias("query"))


def merge_found(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``found`` (id, topic, licence) to a row per id: its topics' weights, each counted once, topics and licences."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    once = found.groupBy("id", "topic").agg(F.collect_set("licence").alias("l"))
    got = once.groupBy("id").agg(F.sum(F.coalesce(weight[F.col("topic")], F.lit(0.0))).alias("score"), F.sort_array(F.collect_set("topic")).alias("topics"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("licences"))
    return got


def rights(xml: Column, field: str = "rights") -> Column:
    """Texts of a metadata field, whatever its namespace."""
    return F.xpath(xml, F.lit(f"//*[local-name()='{field}']/text()"))


def flatten_passages(payload: Column) -> Column:
    """Passages of a JSON payload (an object or a list of them), without those of excluded sections, joined by empty lines. No shuffle."""
    trimmed = F.trim(payload)
    whole = F.when(trimmed.startswith("["), trimmed).otherwise(F.concat(F.lit("["), trimmed, F.lit("]")))
    docs = F.flatten(F.transform(F.from_json(whole, _PASSAGES), lambda c: F.coalesce(c["documents"], F.array())))
    passages = F.flatten(F.transform(docs, lambda d: F.coalesce(d["passages"], F.array())))
    kind = lambda p: F.lower(F.coalesce(p["section_type"], p["infons"]["section_type"], F.lit("")))
    texts = F.transform(F.filter(passages, lambda p: ~kind(p).isin(*EXCLUDED_SECTIONS)), lambda p: T.strip(T.filled(p["text"])))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
