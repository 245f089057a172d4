"""Connected components of a link table.

A table of at most SMALL links, by its count, is solved by one task. A larger one goes by alternating large and small stars, each round a written
table; a node with very many links is joined by broadcast (see ``join_unique``), so no task gets its group. Nothing is collected, and both ways give the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import join_unique, python_ready, written

#: Links that one task takes: 16 bytes each.
SMALL = 500_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def _solved(batches):
    """Links to (node, label), by hooking larger roots to smaller ones and halving paths."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        u, v = np.append(u, b.column("u").to_numpy()), np.append(v, b.column("v").to_numpy())
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])


def components(links: DataFrame, small: int | None = None) -> DataFrame:
    """``links`` (u, v: long) to (node, label): the smallest node of its component, for every node with a link."""
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last, now = None, _mark(edges)
    if now[0] <= (SMALL if small is None else small):
        python_ready(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(_solved, "node long, label long")
    while last != now and now[0]:
        last = now
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        big = join_unique(both, least, "u", "n", 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = written(big, "large-star")
        # small star: u and its smaller neighbours go to the smallest of them
        n = edges.count()
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small_ = join_unique(edges, least, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small_, "small-star")
        now = _mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
