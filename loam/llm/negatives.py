"""Hard negatives by exact search with a table of distances to pivots.

Vectors x of norm up to M get one more component, sqrt(M^2 - |x|^2), and anchors q a zero, so that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: a larger
inner product is a smaller distance. The table stores every row's distances to a few pivots; an anchor's are computed once. By the triangle inequality

    max_p |d(q', p) - d(x', p)|  <=  d(q', x')  <=  min_p (d(q', p) + d(x', p)),

which brackets the score. Rows whose bracket can't reach the scores still wanted are out; the rest are scored exactly, in integers.

* Anchors go in blocks of at most ANCHORS rows, each block a file of its own, to all tasks; rows of the table stay where they are. A task keeps the
  best few rows of each anchor, so what it hands on is bounded, whatever the labels and copies; Spark merges these.
* First each anchor's positives are found, then, with the score ranges that they set, its negatives.

Pivots come from a sample of at most SAMPLE rows, farthest first. They decide only which rows are scored: every row is in the table and the
result is exact.

Edge cases: rows with a null label, a null vector or a component that is null, NaN or infinite take no part; rows with a null id aren't anchors and follow equal scores
with ids; repeated rows are rows of their own, each an anchor if its id is, and rank by place; vectors of fewer components count as zeros after their end; components
beyond 2^27 after scaling count as that bound, so that scores fit a long; an anchor without positives or negatives, and an empty table, give no row. Columns beyond the three that are named, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import python_ready, quoted, shared_dir, written

SCALE, MOST = 256, 1 << 27
PIVOTS, SAMPLE = 8, 2000
#: Anchors of one block, and of one step in a task: a step's matrices have STEP rows and an Arrow batch's columns.
ANCHORS, STEP = 8192, 256
#: What brackets are widened by, relative to M^2: more than their rounding.
SLACK = 1e-6


def prepared(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """(id, label, q): rows that take part, with their components as integers."""
    x = quoted(vector).cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    got = rows.select(quoted(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x")).filter(F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    bound = lambda v: F.greatest(F.least(v * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))
    return got.select("id", "label", F.transform("x", lambda v: F.floor(bound(v)).cast("int")).alias("q"))


def matrix(column: pa.ListArray, dims: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each as far as any from those before it."""
    at, near = [0], np.full(len(x), np.inf)
    while len(at) < min(n, len(x)):
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
        at.append(int(near.argmax()))
    return x[at]


class Space:
    """Distances to pivots in the augmented space, and the brackets of scores that they give."""

    def __init__(self, m2: float, sample: np.ndarray):
        self.m2 = m2
        self.pivots = farthest_first(self.augmented(sample.astype(np.float64)), PIVOTS)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))])

    def _to(self, x: np.ndarray) -> np.ndarray:
        n = (x * x).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(n, 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._to(self.augmented(x))

    def anchors(self, q: np.ndarray) -> np.ndarray:
        return self._to(np.column_stack([q, np.zeros(len(q))]))

    def bracket(self, norms: np.ndarray, near_q: np.ndarray, near_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with each row."""
        low, high = np.zeros((len(near_q), len(near_x))), np.full((len(near_q), len(near_x)), np.inf)
        for p in range(len(self.pivots)):
            a, b = near_q[:, p, None], near_x[None, :, p]
            np.maximum(low, np.abs(a - b), out=low)
            np.minimum(high, a + b, out=high)
        both, slack = (norms + self.m2)[:, None], SLACK * self.m2 + 1
        return (both - high * high) / 2 - slack, (both - low * low) / 2 + slack


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of both."""
    largest = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    kind = np.float64 if largest * largest * max(1, q.shape[1]) < 2.0**53 else np.int64
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


class Best:
    """The best ``k`` rows of each group: the higher score, then the smaller id, null last, then place."""

    def __init__(self, groups: int, k: int):
        self.k, self.worst = k, np.full(groups, np.iinfo(np.int64).min)
        self.held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))

    def add(self, group, score, null, key, place) -> None:
        g, s, n, i, p = (np.concatenate(x) for x in zip(self.held, (group, score, null, key, place), strict=True))
        order = np.lexsort((p, i, n, -s, g))
        g = g[order]
        first = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
        rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        keep = order[rank < self.k]
        self.held = (g[rank < self.k], s[keep], n[keep], i[keep], p[keep])
        last = rank == self.k - 1
        self.worst[g[last]] = s[order[last]]


_FOUND = pa.schema([("anchor", pa.int64()), ("range", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
_FOUND_SQL = "anchor long, range int, score long, id long, place long"


def _search(table: DataFrame, block, k: int, same: bool, ranges=None) -> DataFrame:
    """Each task's best ``k`` rows per anchor of the block and range of scores.

    ``block``: a broadcast dict of the anchors' arrays and the space. ``ranges``: a broadcast (low, high), each anchors x ranges; an empty range has low > high.
    """

    def run(batches):
        a = block.value
        space, q, norms, near = a["space"], a["q"], a["norms"], a["near"]
        dims = q.shape[1]
        low, high = ranges.value if ranges else (np.full((len(q), 1), np.iinfo(np.int64).min), np.full((len(q), 1), np.iinfo(np.int64).max))
        n = low.shape[1]
        steps = [(lo, min(lo + STEP, len(q))) for lo in range(0, len(q), STEP)]
        best = [Best((hi - lo) * n, k) for lo, hi in steps]
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("q"), dims)
            to, label, place = matrix(b.column("near"), near.shape[1]), b.column("label").to_numpy(), b.column("place").to_numpy()
            null = b.column("id").is_null().to_numpy(zero_copy_only=False)
            key = b.column("id").fill_null(0).to_numpy()
            for (lo, hi), top in zip(steps, best, strict=True):
                want_low, want_high = np.maximum(low[lo:hi], top.worst.reshape(-1, n)), high[lo:hi]
                least, greatest = space.bracket(norms[lo:hi], near[lo:hi], to)
                here = (a["label"][lo:hi, None] == label) == same
                here &= a["place"][lo:hi, None] != place
                here &= (greatest >= want_low.min(1)[:, None]) & (least <= want_high.max(1)[:, None])
                some = np.flatnonzero(here.any(0))
                if not len(some):
                    continue
                s, here = exact(q[lo:hi], x[some]), here[:, some]
                for r in range(n):
                    i, j = np.nonzero(here & (s >= want_low[:, r, None]) & (s <= want_high[:, r, None]))
                    if len(i):
                        j_ = some[j]
                        top.add(i * n + r, s[i, j], null[j_], key[j_], place[j_])
        for (lo, _), top in zip(steps, best, strict=True):
            g, s, nul, i, p = top.held
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(g // n + lo), pa.array((g % n).astype(np.int32)), pa.array(s), pa.array(i, mask=nul), pa.array(p)], schema=_FOUND)

    rank = F.row_number().over(Window.partitionBy("anchor", "range").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "place"))
    return table.mapInArrow(run, _FOUND_SQL).withColumn("rank", rank).filter(F.col("rank") <= k)


def pivot_table(rows: DataFrame) -> tuple[DataFrame, Space | None, int]:
    """The table (id, label, q, place, near), its space and the vectors' length."""
    norm = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    m2, dims = rows.agg(F.max(norm), F.max(F.size("q"))).first()
    if m2 is None:
        return rows, None, 0
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(dims) - F.size("q"))))
    sample = rows.orderBy(F.xxhash64("id", "q")).limit(SAMPLE).select("q").toArrow()
    space = Space(float(m2), matrix(sample.column("q").combine_chunks(), dims))
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        place = TaskContext.get().partitionId() << 33
        for b in batches:
            near = shared.value.rows(matrix(b.column("q"), dims))
            ends = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            cols = [*b.columns, pa.array(np.arange(place, place + b.num_rows)), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))]
            place += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "q", "place", "near"])

    return written(rows.mapInArrow(run, "id long, label long, q array<int>, place long, near array<double>"), "pivots"), space, dims


def _blocks(table: DataFrame, anchors: Column, size: int):
    """The anchors, a file of at most ``size`` rows at a time."""
    path = f"{shared_dir(table.sparkSession)}/loam/anchors-{uuid.uuid4().hex}"
    spark = table.sparkSession
    rows = table.filter(anchors)
    rows.repartition(max(1, -(-rows.count() // size))).write.option("maxRecordsPerFile", size).parquet(path)
    held = spark.read.schema(table.schema).parquet(path)
    for file in sorted(held.inputFiles()):
        got = spark.read.schema(table.schema).parquet(file).toArrow()
        if got.num_rows:
            yield got


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = ANCHORS) -> DataFrame:
    """Negatives of each anchor and positive in ``rows`` (id, label, q).

    ``anchors``: a condition on id. Negatives have another label than the anchor and a score from ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    python_ready(spark)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    table, space, dims = pivot_table(rows)
    found: DataFrame | None = None
    for got in _blocks(table, anchors, block) if space else ():
        q = matrix(got.column("q").combine_chunks(), dims)
        arrays = {"q": q, "norms": (q * q).sum(1), "near": space.anchors(q), "label": got.column("label").to_numpy(), "place": got.column("place").to_numpy(), "space": space}
        shared = spark.sparkContext.broadcast(arrays)
        # at most ``positives`` rows an anchor of the block
        best = _search(table, shared, positives, True).select("anchor", "rank", "score", "id").toArrow()
        at, rank, score = (best.column(c).to_numpy() for c in ("anchor", "rank", "score"))
        least, most = np.ones((len(q), positives), np.int64), np.zeros((len(q), positives), np.int64)
        least[at, rank - 1], most[at, rank - 1] = -((-low * score) // 100), (high * score) // 100
        hits = _search(table, shared, negatives, False, spark.sparkContext.broadcast((least, most)))
        ids = got.column("id").to_numpy()
        pairs = spark.createDataFrame(pa.table({"anchor": pa.array(at), "range": pa.array((rank - 1).astype(np.int32)), "anchor_id": pa.array(ids[at]), "positive_id": best.column("id").combine_chunks(), "positive_score": pa.array(score)}))
        hits = hits.join(F.broadcast(pairs), ["anchor", "range"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        hits = written(hits, "negatives")
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], out) if found is None else found


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    key, label = quoted("vec_id"), quoted("label")
    label = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return mined(prepared(embeddings, "vec_id", label, "embedding"), F.col("id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.place AS anchor, a.id AS anchor_id, b.place, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.place <> b.place
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, place) AS k FROM s WHERE same QUALIFY k <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.id NULLS LAST, n.place)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
