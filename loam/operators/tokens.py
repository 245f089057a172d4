"""Token streams: encoding, fixed blocks, random windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.dedup import settled, small_batches

_loaded: dict = {}


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Bytes of text that are encoded at once, about.
PART = 1 << 18


def encode(docs: DataFrame, model: str | None = None, bos: bool = False, eos: bool = False, mark: str | None = None) -> DataFrame:
    """``docs`` (ord, text) to (ord, ids) by a SentencePiece model, in Arrow batches of bounded bytes; ids are 32-bit arrays, never lists of all of a batch.

    With ``mark``, a text holds documents that it ends: each is stripped and encoded by itself, with its own first and last id, and blank ones are dropped.
    """
    path = model or _piece_model()
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in texts:
            lens, parts = [], [np.zeros(0, np.int32)]
            said, held, size = [], [], 0
            for k, t in enumerate(batch, 1):
                text = t.as_py() or ""
                own = [x for c in text.split(mark) if (x := c.strip())] if mark else [text]
                said += own
                held.append(len(own))
                size += len(text)
                if size >= PART or k == len(batch):
                    found = iter(sp.encode(said, num_threads=1, add_bos=bos, add_eos=eos))
                    for n in held:
                        mine = [np.array(x, np.int32) for x in islice(found, n)]
                        lens.append(sum(map(len, mine)))
                        parts += mine
                    said, held, size = [], [], 0
            yield pa.ListArray.from_arrays(pa.array([0, *accumulate(lens)], pa.int32()), pa.array(np.concatenate(parts)))

    return docs.select("ord", ids("text").alias("ids"))


def decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` (ord, ids) to (ord, text): what ``encode`` has made of a text, put together again."""
    path = model or _piece_model()
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for x in ids:
            yield pd.Series([sp.decode([int(i) for i in t]) for t in x])

    return docs.select("ord", text("ids").alias("text"))


def require_vocabulary(size: int, model: str | None = None) -> None:
    """Raises unless the model has so many pieces."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=model or _piece_model()).get_piece_size()
    if found != size:
        raise ValueError(f"the tokenizer has {found:,} pieces, the settings say {size:,}")


def blocks(docs: DataFrame, ctx: int) -> DataFrame:
    """``docs`` (ord, ids) laid end to end in order and cut into whole blocks: (block, ids, y), where y is ids shifted by one token.

    A document's place is a sum over ranges of ord, then over the documents of its range, where tokens move once: blocks inside a range are made there, and
    only parts of blocks that reach from one range into the next move again. At least one block is made, and the last token of the stream never starts one.
    ``docs`` are made once and kept, as lengths and tokens are both asked for.
    """
    d = settled(docs.select("ord", "ids", F.size("ids").cast("long").alias("n"), F.floor(F.col("ord") / 4096).alias("g")))
    sums = settled(d.groupBy("g").agg(F.sum("n").alias("s")))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("g", "s", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("o"))  # a row per range
    inside = Window.partitionBy("g").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    total = sums.agg(F.greatest(F.lit(1), F.floor((F.sum("s") - 1) / ctx)).alias("blocks"))
    d = d.withColumn("i", F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("n > 0").join(F.broadcast(offs), "g").withColumn("at", F.col("o") + F.col("i"))
    # a block also has the token after it, for y
    first, last = F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / ctx), F.floor((F.col("at") + F.col("n") - 1) / ctx)
    d = d.select("g", "o", "s", "at", "ids", "n", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * ctx - F.col("at"), F.lit(0))
    hi = F.least((F.col("block") + 1) * ctx + 1 - F.col("at"), F.col("n"))
    alone = (F.col("block") * ctx >= F.col("o")) & ((F.col("block") + 1) * ctx < F.col("o") + F.col("s"))
    part = d.select("g", "block", "at", F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"), alone.alias("alone"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids")
    whole = part.filter("alone").groupBy("g", "block").agg(joined).select("block", "ids").unionByName(part.filter("NOT alone").groupBy("block").agg(joined))
    return whole.join(F.broadcast(total)).filter("block < blocks").select("block", F.slice("ids", 1, ctx).alias("ids"), F.slice("ids", 2, ctx).alias("y"))  # one row


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` (ord, text) in order of ord, from one partition to the next: texts move, which are smaller than their ids."""
    n = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    return docs.repartitionByRange(n, "ord").sortWithinPartitions("ord")


def stream(ranges: DataFrame, lengths: DataFrame, ctx: int) -> DataFrame:
    """Files of ids as one stream in order of their names, all of it, in rows of ``ctx`` ids, the last with what is left: (block, start, ids).

    ``ranges`` (file, start, ids) are the files' ids and ``lengths`` (file, n) has a row per file. Rows are made where a range is read, without a copy; only parts of those over two ranges or more move.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    at = lengths.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    placed = ranges.join(F.broadcast(at), "file").select((F.col("o") + F.col("start")).alias("at"), "ids")

    def cut(batches):
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.values, ids.offsets.to_numpy()
            starts, offsets = [], [int(ends[0])]
            for at, lo, hi in zip(b.column("at").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                while lo < hi:
                    n = min(ctx - at % ctx, hi - lo)
                    starts.append(at)
                    at, lo = at + n, lo + n
                    offsets.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["at", "ids"])

    small_batches(ranges.sparkSession)
    parts = placed.mapInArrow(cut, "at long, ids array<int>").withColumn("block", F.floor(F.col("at") / ctx))
    whole = F.size("ids") == ctx
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids")
    made = parts.filter(~whole).groupBy("block").agg(joined)
    return parts.filter(whole).select("block", "ids").unionByName(made).select("block", (F.col("block") * ctx).alias("start"), "ids")


def random_windows(cut: DataFrame, ctx: int, n: int, seed: int) -> DataFrame:
    """n windows of ctx tokens at seeded uniform starts, with replacement: (i, start, digest)."""
    spark = cut.sparkSession
    most = cut.agg(F.sum(F.size("ids")).alias("t"))
    h = F.pmod(F.xxhash64(F.col("i"), F.lit(seed)), F.greatest(F.col("t") - ctx, F.lit(1)))
    starts = spark.range(n).withColumnRenamed("id", "i").join(F.broadcast(most)).select("i", h.alias("start"))
    want = starts.select("i", "start", F.explode(F.array(F.floor(F.col("start") / ctx), F.floor(F.col("start") / ctx) + 1)).alias("block"))
    got = cut.join(F.broadcast(want), "block").groupBy("i", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda x: x["ids"])).alias("t"))
    return got.select("i", "start", F.md5(F.array_join(F.slice("t", (F.col("start") % ctx + 1).cast("int"), ctx).cast("array<string>"), ",")).alias("digest"))
