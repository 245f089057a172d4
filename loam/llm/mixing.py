"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: its base weight times ``1 + slope * (t - 1/2)``.
The integral of the schedule is its share of the mix, its running integral the cumulative token demand
``D(t) = target * (t + slope * (t*t - t) / 2)``. A source's documents, in hash order and epoch after epoch, lie
end to end on its token axis; a document trains at the t at which the demand reaches its first token, which is D
inverted. ``curriculum`` range-sorts the chosen documents by that position, and so are the rows of ``op6_mixing`` sorted, those that take nothing last.

Prefix sums are two-level: sums per (source, hash bucket), a running sum over the buckets of a source, and a window
inside each bucket. So a source with a third of all rows is spread over BUCKETS groups.

``ordered`` moves texts twice: to the side of their places, and into the range sort. Places themselves are worked out on ids and sizes.

Edge cases: null text has size 0; rows without an id are ordered by a hash of their text; null source is a source of its own, last in order; a document of no words takes
nothing; ties of the hash go by id and then by size, so repeated rows lie one after the other in either order alike;
an empty table gives an empty mix; if all sizes are 0, all targets are 0. Other columns of the input may have any names; one named
``train_position`` gives way to ``curriculum``'s own. Sizes are of whole texts, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import boxed, n_words, written

WEIGHTS = (3, 1, 2)
#: The schedules' slopes, by the source's place as the weights: early, steady, late.
SLOPES = (-1.0, 0.0, 1.0)
SHARE = 1.5
MOST = 2
#: Hex digits of md5(doc_id) that make a bucket: 4,096 buckets a source, which is also what a source's running sum has to read at most.
BUCKET_DIGITS = 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the order key h, and k, the hash of the text."""
    i = F.col("doc_id").cast("string")
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(i, "text", F.lit(""))).alias("h"), F.xxhash64("text").alias("k"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source_size, weight, slope, target. The windows here run over one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    s = by.select("*", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"))
    cap = F.col("source_size") * MOST
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    # Filling up: in order of cap / weight the first k sources are at their caps, the rest share what is left by weight.
    s = s.select(
        "*", cap.alias("cap"), F.row_number().over(order).alias("_k"),
        (F.sum("source_size").over(every) * SHARE).alias("_all"), F.sum("weight").over(every).alias("_w"),
        F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gone"),
    )
    level = (F.col("_all") - F.col("_capped")) / (F.col("_w") - F.col("_gone"))
    s = s.withColumn("_level", level).withColumn("_free", F.col("cap") >= F.col("_level") * F.col("weight"))
    first = F.min(F.when(F.col("_free"), F.struct("_k", "_level"))).over(every)
    s = s.withColumn("_first", first)
    target = F.when(F.col("_k") >= F.col("_first._k"), F.col("_first._level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", "slope", target.alias("target"))


def position(demand: Column, target: Column, slope: Column) -> Column:
    """t in [0, 1] with ``target * (t + slope * (t*t - t) / 2) = demand``."""
    x = F.least(demand / target, F.lit(1.0))
    b = 1 - slope / 2
    root = 2 * x / (b + F.sqrt(F.greatest(b * b + 2 * slope * x, F.lit(0.0))))
    return F.when(target > 0, F.least(F.when((slope == 0), x).otherwise(root), F.lit(1.0)))


def plan(docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target, taken (long), epochs begun, and position (null if nothing is taken)."""
    d = written(sized(docs), "sizes").withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    t = targets(d)
    sums = d.groupBy("source", "b").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    # one row per source and bucket; the null source joins as itself
    offs = sums.alias("s").join(t.alias("t"), F.expr("s.source <=> t.source")).select(
        F.col("s.source").alias("_s"), F.col("s.b").alias("_b"), "_before", "source_size", "target", "slope"
    )
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(offs, F.expr("source <=> _s AND b = _b")).withColumn("_at", F.col("_before") + F.col("_in"))
    goal = F.floor("target")
    took = lambda e: F.least(F.greatest(goal - F.col("_at") - e * F.col("source_size"), F.lit(0)), F.col("size"))
    return d.select(
        "doc_id", "source", "k", "size", "source_size", "target", (took(0) + took(1)).cast("long").alias("taken"),
        F.when(took(0) > 0, F.round(position(F.col("_at").cast("double"), F.col("target"), F.col("slope")), 9)).alias("position"),
        F.when(took(1) > 0, F.round(position((F.col("_at") + F.col("source_size")).cast("double"), F.col("target"), F.col("slope")), 9)).alias("again_at"),
        took(0).cast("long").alias("_first"), took(1).cast("long").alias("_second"),
    )


def _same(doc_id: Column, source: Column, k: Column) -> Column:
    """One key for the rows that share id, source and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), k.cast("string"), F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), source))))


def ordered(docs: DataFrame) -> DataFrame:
    """The mix itself, in training order: ``_doc`` (the row of ``docs``) and ``train_position``, once per copy of a document that is taken.

    A copy that the target cuts stays whole if half of it or more is taken, else goes. Rows that share id, source and text are interchangeable:
    they are numbered on both sides, so that each joins one place.
    """
    place = F.filter(
        F.array(F.when(2 * F.col("_first") >= F.col("size"), F.col("position")), F.when(2 * F.col("_second") >= F.col("size"), F.col("again_at"))),
        lambda x: x.isNotNull(),
    )
    p = plan(docs.select("doc_id", "source", "text")).select(_same(F.col("doc_id"), F.col("source"), F.col("k")).alias("key"), "position", place.alias("places"))
    p = p.select("key", "places", F.row_number().over(Window.partitionBy("key").orderBy(F.col("position").asc_nulls_last())).alias("m"))
    mine = boxed(docs, key=_same(F.col("doc_id"), F.col("source"), F.xxhash64("text")))
    mine = mine.select("_doc", "key", F.row_number().over(Window.partitionBy("key").orderBy("key")).alias("m"))
    # the number is a join key, so repeated rows meet one place each; both sides stay where their windows have put them, by key
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    j = mine.join(p.filter(F.size("places") > 0), ["key", "m"]).select("_doc", F.explode("places").alias("train_position"))
    return j.repartitionByRange("train_position", "_doc.doc_id").sortWithinPartitions("train_position", "_doc.doc_id")


def curriculum(docs: DataFrame) -> DataFrame:
    """``ordered`` with all columns of ``docs`` and ``train_position``."""
    keep = [F.col("_doc")[c].alias(c) for c in docs.columns if c != "train_position"]
    return ordered(docs).select(*keep, "train_position")


def op6_mixing(docs: DataFrame) -> DataFrame:
    order = (F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("size"))
    p = written(plan(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "position", "again_at"), "places")
    return p.repartitionByRange(*order).sortWithinPartitions(*order)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap, [3, 1, 2][n % 3 + 1] AS weight, [-1.0, 0.0, 1.0][n % 3 + 1]::DOUBLE AS slope FROM s),
o AS (SELECT *, row_number() OVER q AS k, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total, sum(weight) OVER () AS allw,
  coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM w WINDOW q AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST)),
l AS (SELECT *, (total - capped::DOUBLE) / (allw - gone)::DOUBLE AS lvl FROM o),
f AS (SELECT min(k) AS k FROM l WHERE cap >= lvl * weight),
t AS (SELECT source, source_size, slope, CASE WHEN l.k >= f.k THEN (SELECT l2.lvl FROM l l2, f f2 WHERE l2.k = f2.k) * weight ELSE cap::DOUBLE END AS target FROM l, f),
p AS (SELECT doc_id, d.source, size, source_size, target, slope,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, least(greatest(floor(target)::BIGINT - pos, 0), size) AS a, least(greatest(floor(target)::BIGINT - pos - source_size, 0), size) AS b,
  least(pos::DOUBLE / target, 1.0) AS xa, least((pos + source_size)::DOUBLE / target, 1.0) AS xb, 1 - slope / 2 AS c FROM p)
SELECT doc_id, source, size, source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a > 0 THEN round(least(CASE WHEN slope = 0 THEN xa ELSE 2 * xa / (c + sqrt(greatest(c * c + 2 * slope * xa, 0.0))) END, 1.0), 9) END AS position,
  CASE WHEN b > 0 THEN round(least(CASE WHEN slope = 0 THEN xb ELSE 2 * xb / (c + sqrt(greatest(c * c + 2 * slope * xb, 0.0))) END, 1.0), 9) END AS again_at
FROM x
"""
