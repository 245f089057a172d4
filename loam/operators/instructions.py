"""Instruction examples: validation, deduplication, splits, label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T


def from_conversations(turns: DataFrame) -> DataFrame:
    """Each assistant turn after a user turn; the conversation's system text is the context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumns({
        "pr": F.lag("role").over(w), "pt": F.lag("text").over(w),
        "sys": F.max(F.when(F.col("role") == "system", F.col("text"))).over(Window.partitionBy("conv_id")),
    })
    t = t.filter("role = 'assistant' AND pr = 'user'")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("pt").alias("instruction"), T.filled(F.col("sys")).alias("context"), F.col("text").alias("response"))


def valid(ex: DataFrame, strict: bool = False) -> DataFrame:
    """Stripped; rows without an instruction or response go, or raise if ``strict``."""
    s = ex.withColumns({c: T.strip(T.filled(F.col(c))) for c in ("instruction", "context", "response")})
    good = (F.col("instruction") != "") & (F.col("response") != "")
    if strict:
        return s.filter(F.when(good, True).otherwise(F.raise_error("instruction and response are required").cast("boolean")))
    return s.filter(good)


def last_of_each(ex: DataFrame) -> DataFrame:
    """Of equal examples the last; a maximum per fingerprint, combined within tasks."""
    fp = T.fingerprint(F.col("instruction"), F.col("context"), F.col("response"))
    rest = [c for c in ex.columns if c != "ord"]
    x = ex.withColumn("fp", fp)
    return x.groupBy("fp").agg(F.max(F.struct("ord", *rest)).alias("x")).select("fp", "x.*")


def every_kth(ex: DataFrame, fraction: float) -> DataFrame:
    """``ex`` (fp) in order of fp: every k-th row, k = round(1 / fraction), 2 at least, is for validation.

    The rank is two-level: counts of each fingerprint prefix, then ranks within a prefix, so no task sorts all rows.
    """
    if not 0 < fraction < 0.5:
        raise ValueError("fraction must be between 0 and 0.5")
    k = max(2, round(1 / fraction))
    x = ex.withColumn("_p", F.substring("fp", 1, 3))
    n = x.groupBy("_p").agg(F.count("*").alias("_n"))
    n = n.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 4,096 rows at most
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("fp")) - 1).join(F.broadcast(n), "_p")
    return x.withColumn("split", F.when((F.col("_before") + F.col("_i")) % k == 0, "val").otherwise("train")).drop("_p", "_i", "_before")


def masked(prompt: Column, response: Column, ctx: int, bos: int = 2, eos: int = 3, pad: int = 0, ignore: int = -100) -> Column:
    """Struct of x and y, both ``ctx`` long: the prompt (cut to ctx) and the response; labels of the prompt and of padding are ``ignore``."""
    p = F.slice(F.concat(F.array(F.lit(bos).cast("long")), prompt), 1, ctx)
    r = F.concat(response, F.array(F.lit(eos).cast("long")))

    def rows(s: Column) -> Column:
        np_, full = F.size(s["p"]), s["f"]
        n = F.size(full)
        fill = lambda v: F.array_repeat(F.lit(v).cast("long"), F.lit(ctx + 1) - n)
        x = F.concat(F.slice(full, F.lit(1), n - 1), fill(pad))
        y = F.concat(F.array_repeat(F.lit(ignore).cast("long"), np_ - 1), F.slice(full, np_ + 1, F.greatest(n - np_, F.lit(0))), fill(ignore))
        return F.struct(x.alias("x"), y.alias("y"))

    return T.let(T.let(p, lambda q: F.struct(q.alias("p"), F.slice(F.concat(q, r), 1, ctx + 1).alias("f"))), rows)
