"""Numbers of training and sampling, as far as they are data operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Ties at the cut stay."""
    r = F.rank().over(Window.partitionBy("vec_id").orderBy(F.desc("logit")))
    return logits.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy("vec_id")
    x = logits.withColumn("_x", F.exp((F.col("logit") - F.max("logit").over(w)) / temperature))
    return x.withColumn("p", F.col("_x") / F.sum("_x").over(w)).drop("_x")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """The most likely tokens until their sum passes p, the one that passes it included."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, 0)
    return softmax(logits).withColumn("_b", F.sum("p").over(w) - F.col("p")).filter(F.col("_b") <= p).drop("_b")


def draw(logits: DataFrame, seed: int) -> DataFrame:
    """One token of each row by its probability, the same for the same seed."""
    w = Window.partitionBy("vec_id").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    u = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    c = softmax(logits).withColumn("_c", F.sum("p").over(w)).filter(F.col("_c") > u)
    return c.groupBy("vec_id").agg(F.min("token").alias("token"))


def token_nll(logits: DataFrame, labels: DataFrame, ignore: int = -100) -> DataFrame:
    """``labels`` (vec_id, label): minus the label's log probability; labels to be ignored have none."""
    on = labels.filter(F.col("label") != ignore)
    return softmax(logits).join(on, (logits["vec_id"] == on["vec_id"]) & (F.col("token") == F.col("label"))).select(logits["vec_id"], (-F.log("p")).alias("nll"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def lr_schedule(spark: SparkSession, steps: int, peak: float, least: float, warmup: int, most: int) -> DataFrame:
    """A linear rise, then half a cosine down to ``least``."""
    s = F.col("step")
    ratio = (s - warmup) / max(1, most - warmup)
    lr = F.when(s < warmup, peak * (s + 1) / max(1, warmup)).when(s >= most, F.lit(least)).otherwise(least + 0.5 * (1 + F.cos(F.pi() * ratio)) * (peak - least))
    return spark.range(steps).select(F.col("id").alias("step")).withColumn("lr", lr)


def causal_attention(x: DataFrame) -> DataFrame:
    """``x`` (vec_id, seq, pos, v) to (vec_id, n, out): each vector's mean of its sequence's vectors so far, weighted by softmax(v.v / sqrt(d)).

    A sequence is one context window, so its pairs are bounded by the context's length, not by the table.
    """
    q, k = x.select("vec_id", "seq", "pos", "v"), x.select("seq", F.col("pos").alias("kp"), F.col("v").alias("kv"))
    dot = F.aggregate(F.zip_with("v", "kv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.sqrt(F.size("v"))
    pairs = q.join(k, "seq").filter("kp <= pos").select("vec_id", F.struct(dot.alias("s"), F.col("kv").alias("v")).alias("e"))
    g = pairs.groupBy("vec_id").agg(F.collect_list("e").alias("e"))
    top = F.array_max(F.transform("e", lambda y: y["s"]))
    g = g.withColumn("_m", top).withColumn("_w", F.transform("e", lambda y: F.exp(y["s"] - F.col("_m"))))
    g = g.withColumn("_z", F.aggregate("_w", F.lit(0.0), lambda a, b: a + b))
    zero = F.transform(F.element_at("e", 1)["v"], lambda _: F.lit(0.0))
    out = F.aggregate(F.zip_with("e", "_w", lambda y, w: F.struct(y["v"].alias("v"), (w / F.col("_z")).alias("w"))), zero, lambda acc, y: F.zip_with(acc, y["v"], lambda a, b: a + b * y["w"]))
    return g.select("vec_id", F.size("e").cast("long").alias("n"), out.alias("out"))


def latest_step(names: DataFrame) -> DataFrame:
    """The checkpoint of the highest number; names without one count as -1."""
    step = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(name, '^step_([0-9]+)[.]pt$', 1), '') AS bigint)"), F.lit(-1).cast("long"))
    return names.select("name", step.alias("step")).orderBy(F.desc("step")).limit(1)


def parameter_count(vocab: int, context: int, layers: int, width: int, hidden: int, tied: bool = True, bias: bool = False) -> int:
    """Weights of a decoder of this shape: embeddings, attention, feed-forward, norms and, if not tied, the head."""
    b = 1 if bias else 0
    block = 4 * width * width + 4 * b * width + 2 * width * hidden + b * (hidden + width) + 4 * width
    return vocab * width + context * width + layers * block + 2 * width + (0 if tied else vocab * width)
