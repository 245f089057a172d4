"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily, each time with the longest document that still fits; then its smallest document is replaced
by the two unpacked documents that fill the gap it leaves most tightly, if they fill it better. Only lengths matter to
that, and there are at most ``capacity`` of them, so the packing is planned on the histogram of lengths: a plan row says
how often a pattern of lengths is packed. Documents are then dealt to the plan's places by their rank among those of
their length. The rank is a two-level prefix sum over (length, salt), so that a length that a third of all
documents have is spread over many groups. Histogram and plan are bounded by the capacity, not by the input.

Documents in an order, such as a curriculum's, are packed in ranges of it, each with a plan of its own, made where its histogram is: sequences
then follow the order from range to range, at the cost of about one sequence a range that isn't full.

Edge cases: null texts are empty and have the end id only; longer documents are cut into pieces of ``capacity``, the first
one takes the remainder; repeated rows are packed once each; ties of rank go by id, piece and checksum, and rows equal in
all of these are interchangeable; an empty table gives no rows. A text of any length is encoded whole; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import common, tokens

CAPACITY = 1024
END = 2
#: Groups that the documents of one length are spread over, at least.
SALTS = 256
ROWS_A_GROUP = 50_000

OUT = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECES = "range string, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """range (the document's ``order``), doc_id and the pieces of each document: where they start, their lengths and checksums."""

    def run(batches):
        e = tokens.encoder(tokenizer)
        for b in batches:
            ids, bounds = tokens.encode_docs(e, b.column("text"), end)
            raw = memoryview(ids.astype("<u4")).cast("B")
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for g, d, lo, hi in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at, k = lo, 0
                step = (hi - lo) % capacity or capacity
                while at < hi:
                    for x, v in zip(out, (g, d, k, at - lo, step, zlib.crc32(raw[4 * at : 4 * (at + step)])), strict=True):
                        x.append(v)
                    at, k, step = at + step, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["range", *OUT])

    common.python_ready(docs.sparkSession)
    return docs.select((F.lit("") if order is None else order).alias("range"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each filling a bin, and how often each is used. Uses every document once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    span = np.arange(capacity + 1)
    out = []
    while have.any():
        left = have.copy()
        bin_: list[int] = []
        gap = capacity
        while gap and (fit := np.flatnonzero(left[: gap + 1])).size:
            length = int(fit[-1])
            # as many of this length as fit, in one step
            k = int(min(left[length], gap // length))
            bin_ += [length] * k
            left[length] -= k
            gap -= length * k
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            best = np.maximum.accumulate(np.where(left > 0, span, 0))  # the longest that fits a room
            a = np.flatnonzero(left[: room + 1])
            b = best[room - a]
            same = (b == a) & (left[a] < 2)
            b[same] = best[np.maximum(a[same] - 1, 0)]
            total = np.where(b > 0, a + b, 0)
            if total.size and (i := int(total.argmax())) >= 0 and total[i] > small:
                bin_[-1:] = [int(a[i]), int(b[i])]
        need = Counter(bin_)
        times = int(min(have[x] // k for x, k in need.items()))
        for x, k in need.items():
            have[x] -= k * times
        out.append((tuple(bin_), times))
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the documents of a length, by rank, at their places."""
    out, rank, seq = [], Counter(), 0
    for lengths, times in plan:
        at = 0
        for x in lengths:
            out.append((x, rank[x], times, seq, at))
            rank[x] += times
            at += x
        seq += times
    return out


def _plans(capacity: int):
    """Of a range's lengths and how many pieces have each: its places."""

    def run(table: pa.Table) -> pa.Table:
        hist = dict(zip(table.column("length").to_pylist(), table.column("n").to_pylist(), strict=True))
        rows = slots(best_two_fit(hist, capacity))
        names = ("length", "first", "times", "seq", "offset")
        cols = {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
        return pa.table({"range": pa.array([table.column("range")[0].as_py()] * len(rows), pa.string())} | cols)

    return run


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (a written table of ``pieces``) with sequence_id and offset; ranges in order, one after the other."""
    spark = parts.sparkSession
    hist = common.written(parts.groupBy("range", "length").agg(F.count("*").alias("n")), "lengths")  # of a range at most ``capacity`` rows
    places = common.written(hist.groupBy("range").applyInArrow(_plans(capacity), "range string, length long, first long, times long, seq long, offset long"), "places")
    # one row per range
    ranges = places.groupBy("range").agg(F.max(F.col("seq") + F.col("times")).alias("_n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))
    places = places.join(ranges, "range").select("range", "length", "first", "times", (F.col("base") + F.col("seq")).alias("seq"), "offset")
    n_ranges, total = hist.agg(F.count_distinct("range"), F.sum("n")).first()
    common.python_ready(spark)
    salts = max(1, SALTS // max(1, n_ranges), (total or 0) // max(1, n_ranges) // ROWS_A_GROUP)
    p = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    group = p.groupBy("range", "length", "_salt").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("range", "length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("range", "length", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("range", "length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    p = p.withColumn("_in", F.row_number().over(inside) - 1).join(group, ["range", "length", "_salt"]).withColumn("_r", F.col("_before") + F.col("_in"))
    if n_ranges == 1:
        places = F.broadcast(places)  # a bin holds a bounded number of lengths and uses up one of them, so rows are bounded by the capacity
    p = p.join(places, ["range", "length"]).filter((F.col("_r") >= F.col("first")) & (F.col("_r") < F.col("first") + F.col("times")))
    return p.select(*OUT, (F.col("seq") + F.col("_r") - F.col("first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """``order``: a string per document. Documents are packed among those of the same string, and sequences are numbered in its order."""
    return assign(common.written(pieces(docs, tokenizer or tokens.default_tokenizer(), end, capacity, order), "pieces"), capacity)


def op3_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
