"""Selection of documents from a stream of files: stages, exact duplicates by keyed state, running counts that a restart doesn't change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.config import HOSTED_LIMITS, Lexicon, Limit
from loam.functions import text as T
from loam.operators import classify, quality

#: What can become of a document, in the order of the checks.
STAGES = ("missing_id_or_licence", "no_category", "quality", "exact_duplicate", "accepted")
ROWS = "id string, licence string, category string, stage string, duplicate_of string, text string"


def judged(docs: DataFrame, lexicon: Lexicon, limits: tuple[Limit, ...]) -> DataFrame:
    """``docs`` (id, text, licence), static or a stream, with the first stage that each row fails; rows are judged alone."""
    d = docs.select("id", "licence", T.normalise_text(F.col("text")).alias("t"))
    bad = quality.reasons(quality.metrics(F.col("t")), limits)
    found = F.struct(classify.licence_of_value(F.col("licence")).alias("lic"), classify.classify_text(F.col("t"), lexicon).alias("category"), F.size(bad).alias("bad"))
    # a struct in an array of one: what it holds is worked out once a row, however often it is named after
    d = d.select("id", "t", F.inline(F.array(found)))
    stage = F.when(F.col("id").isNull() | F.col("lic").isNull(), STAGES[0]).when(F.col("category").isNull(), STAGES[1]).when(F.col("bad") > 0, STAGES[2]).otherwise(STAGES[4])
    return d.select("id", F.col("lic").alias("licence"), "category", stage.alias("stage"), F.lit(None).cast("string").alias("duplicate_of"), F.col("t").alias("text"))


#: Groups that rows which failed a stage pass the state in; they leave nothing there.
FAILED = 4096


def first_of_each(rows: DataFrame) -> DataFrame:
    """A stream's ``rows`` (ROWS) with all but the first of each text that passed marked as duplicates of it; the texts' digests met so far are state.

    Of one trigger's rows the least id is first. A text's rows of one trigger are together in memory, so what a trigger reads bounds them. Rows that failed
    go through as they are, so that the stream is judged once and not for each of two branches.
    """

    def mark(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0].startswith("-"):
            for part in parts:
                yield part.drop(columns="sha")
            return
        rows = pd.concat(list(parts)).sort_values("id", kind="stable").reset_index(drop=True)
        if state.exists:
            (first,), known = state.get, 0
        else:
            first, known = rows["id"][0], 1
            state.update((first,))
        rows.loc[known:, "stage"] = STAGES[3]
        rows.loc[known:, "duplicate_of"] = first
        yield rows.drop(columns="sha")

    group = F.concat(F.lit("-"), F.pmod(F.xxhash64("id", "text"), F.lit(FAILED)).cast("string"))
    keyed = rows.withColumn("sha", F.when(F.col("stage") == STAGES[4], T.content_hash(F.col("text"))).otherwise(group)).groupBy("sha")
    return keyed.applyInPandasWithState(mark, ROWS, "first string", "append", GroupStateTimeout.NoTimeout)


def json_documents(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """JSON lines (id, text, licence) as a stream, ``files`` files a trigger."""
    return spark.readStream.schema("id string, text string, licence string").option("maxFilesPerTrigger", files).json(path)


def select_stream(
    docs: DataFrame, sink: str, checkpoint: str, lexicon: Lexicon, limits: tuple[Limit, ...] = HOSTED_LIMITS, then: Callable[[int], None] | None = None
) -> StreamingQuery:
    """A stream of ``docs`` (id, text, licence) to tables under ``sink``; runs until what is there is done.

    ``rows`` has each document with its stage, ``counts`` the documents of each stage, both by trigger. A trigger that is done again after a failure
    writes its own part again, so neither loses nor doubles rows; ``then`` is called after each. Near duplicates are left to the batch job, as they depend on
    the order of all documents. What is observed of each trigger, as ``scan``, goes to listeners (see ``progress``).
    """
    out = first_of_each(judged(docs, lexicon, limits))
    out = out.observe("scan", F.count("*").alias("scanned"), *[F.count(F.when(F.col("stage") == s, 1)).alias(s) for s in STAGES])

    def save(rows: DataFrame, trigger: int) -> None:
        part = f"{sink}/rows/trigger={trigger}"
        rows.write.mode("overwrite").parquet(part)
        counts = rows.sparkSession.read.schema(ROWS).parquet(part).groupBy("stage").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{sink}/counts/trigger={trigger}")
        if then:
            then(trigger)

    return out.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_counts(spark: SparkSession, sink: str) -> DataFrame:
    """(stage, n) of all triggers so far."""
    return spark.read.parquet(f"{sink}/counts").groupBy("stage").agg(F.sum("n").alias("n"))
