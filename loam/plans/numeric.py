"""Queries of numbers: sampling filters, losses, schedules, attention, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import numeric as N
from loam.plans.registry import query

_LOGITS = "lg AS (SELECT vec_id, i - 1 AS token, embedding[i]::DOUBLE AS logit FROM embeddings, unnest(generate_series(1, 64)) AS g(i))"


def logits(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.posexplode("embedding").alias("token", "logit")).select("vec_id", F.col("token").cast("long").alias("token"), F.col("logit").cast("double").alias("logit"))


@query("topk_filter", f"WITH {_LOGITS} SELECT vec_id, token, logit FROM lg QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 8")
def _(spark, sf):
    return N.top_k(logits(spark, sf), 8)


_P = f"{_LOGITS}, p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS x FROM lg), q AS (SELECT vec_id, token, logit, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM p)"


@query("topp_filter", f"WITH {_P}, c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) - p AS before FROM q) SELECT vec_id, token FROM c WHERE before <= 0.5")
def _(spark, sf):
    return N.top_p(logits(spark, sf), 0.5).select("vec_id", "token")


@query("token_nll", f"WITH {_P} SELECT q.vec_id, round(-ln(p), 6) AS nll FROM q JOIN embeddings e ON e.vec_id = q.vec_id AND e.label = q.token")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"))
    return N.token_nll(logits(spark, sf), e).select("vec_id", F.round("nll", 6).alias("nll"))


@query("mean_loss", f"WITH {_P}, l AS (SELECT q.vec_id, -ln(p) AS nll FROM q JOIN embeddings e ON e.vec_id = q.vec_id AND e.label = q.token), b AS (SELECT vec_id // 16 AS b, avg(nll) AS m FROM l GROUP BY 1) SELECT round(avg(m), 6) AS loss FROM b")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"))
    b = N.token_nll(logits(spark, sf), e).groupBy(F.floor(F.col("vec_id") / 16).alias("b")).agg(F.avg("nll").alias("m"))
    return b.agg(F.round(F.avg("m"), 6).alias("loss"))


@query("perplexity", f"WITH {_P}, l AS (SELECT -ln(p) AS nll FROM q JOIN embeddings e ON e.vec_id = q.vec_id AND e.label = q.token) SELECT round(exp(least(avg(nll), 20)), 6) AS perplexity FROM l")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"))
    return N.token_nll(logits(spark, sf), e).agg(F.round(N.perplexity(F.avg("nll")), 6).alias("perplexity"))


@query("lr_schedule", """SELECT step, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100 WHEN step >= 2000 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos(pi() * (step - 100) / 1900)) * (3e-4 - 3e-5) END::DOUBLE, 12) AS lr FROM range(2100) AS r(step)""")
def _(spark, sf):
    return N.lr_schedule(spark, 2100, peak=3e-4, least=3e-5, warmup=100, most=2000).select("step", F.round("lr", 12).alias("lr"))


_ATT = """e AS (SELECT vec_id, vec_id // 32 AS seq, vec_id % 32 AS pos, embedding AS v FROM embeddings),
s AS (SELECT q.vec_id, q.seq, k.pos AS kp, k.v, list_sum(list_transform(generate_series(1, 64), lambda i: q.v[i]::DOUBLE * k.v[i]::DOUBLE)) / 8.0 AS s FROM e q JOIN e k ON q.seq = k.seq AND k.pos <= q.pos),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM s), a AS (SELECT vec_id, kp, v, x / sum(x) OVER (PARTITION BY vec_id) AS a FROM w)"""


@query("causal_attention", f"WITH {_ATT} SELECT vec_id, count(*)::BIGINT AS n, round(sum(a * v[1]), 5) AS first, round(sum(a * v[64]), 5) AS last FROM a GROUP BY vec_id")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = e.select("vec_id", F.floor(F.col("vec_id") / 32).alias("seq"), (F.col("vec_id") % 32).alias("pos"), F.col("embedding").cast("array<double>").alias("v"))
    return N.causal_attention(x).select("vec_id", "n", F.round(F.get("out", F.lit(0)), 5).alias("first"), F.round(F.get("out", F.lit(63)), 5).alias("last"))


@query("latest_step", "SELECT name, step FROM (SELECT name, coalesce(try_cast(regexp_extract(name, '^step_([0-9]+)[.]pt$', 1) AS BIGINT), -1) AS step FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'step_last.pt' ELSE 'step_' || o_orderkey || '.pt' END AS name FROM orders)) ORDER BY step DESC LIMIT 1")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    name = F.when(F.col("o_orderkey") % 5 == 0, "step_last.pt").otherwise(F.concat(F.lit("step_"), F.col("o_orderkey").cast("string"), F.lit(".pt")))
    return N.latest_step(o.select(name.alias("name")))
