"""Token ids in fixed-width bit-packed shards.

A shard is one binary value: a header, the ends of its documents, the byte offset of each block, and the ids, each in the
fewest bits that the vocabulary needs, lowest bit first. Blocks hold BLOCK ids, so any id range is unpacked by numpy from
the blocks it touches alone. Shards are rows of a Parquet table in ascending id order (part, shard), written by
Spark's own committer: a lost executor or a second attempt leaves no half shard, and any store that Spark reaches will do.

Edge cases: null and empty texts hold the end id only; rows with a null id come first; rows that repeat an id follow
each other, by text; a document longer than a shard gets a shard of its own size; an empty table gives an empty file.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import common, tokens

MAGIC = b"LOAMIDS1"
HEAD = struct.Struct("<8sIIQI")
BLOCK = 4096
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
END = 0
STORE = "part int, shard int, local_start long, n_ids long, doc_ids array<long>, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def width(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack_bits(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (rows.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def make_shard(ids: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return HEAD.pack(MAGIC, bits, len(ends), len(ids), BLOCK) + ends.astype("<u8").tobytes() + offsets.tobytes() + b"".join(blocks)


class Shard:
    def __init__(self, data: bytes):
        magic, self.bits, self.n_docs, self.n_ids, self.block = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        n = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.data = memoryview(data)[at + 8 * (n + 1) :]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, from the blocks that hold them."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        n = min(self.n_ids, b * self.block) - a * self.block
        if self.block * self.bits % 8:
            raise ValueError("blocks must end on a byte")
        got = unpack_bits(self.data[self.offsets[a] : self.offsets[b]], n, self.bits)
        return got[lo - a * self.block : hi - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write(docs: DataFrame, tokenizer: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards' table, read from where it was written."""
    path = tokenizer or tokens.default_tokenizer()

    def run(batches):
        e = tokens.encoder(path)
        bits, part, shard, start = width(max(e.vocab, end + 1)), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []
        n = 0

        def close():
            row = [[part], [shard], [start], [n], [names], [make_shard(np.concatenate(held), np.cumsum(sizes), bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for b in batches:
            ids, bounds = tokens.encode_docs(e, b.column("text"), end)
            for d, lo, hi in zip(b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                held.append(ids[lo:hi])
                sizes.append(hi - lo)
                names.append(d)
                n += hi - lo
                if n >= shard_ids:
                    yield close()
                    shard, start = shard + 1, start + n
                    held, sizes, names, n = [], [], [], 0
        if names:
            yield close()

    common.python_ready(docs.sparkSession)
    order = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return common.written(order.mapInArrow(run, STORE), "ids")


def read(store: DataFrame) -> DataFrame:
    """Per document, from the shards' bytes: doc_id, start, n_tokens, ids_crc32, part, shard."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for r in b.to_pylist():
                s = Shard(r["payload"])
                ids = s.ids(0, s.n_ids).astype("<u4")
                raw = memoryview(ids).cast("B")
                lo = 0
                for d, hi in zip(r["doc_ids"], s.ends.tolist(), strict=True):
                    for x, v in zip(out, (d, r["local_start"] + lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]), r["part"], r["shard"]), strict=True):
                        x.append(v)
                    lo = hi
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "_local", "n_tokens", "ids_crc32", "part", "shard"])

    spark = store.sparkSession
    common.python_ready(spark)
    # one row per part, and there are as many parts as the writer had partitions
    sums = store.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    got = store.mapInArrow(run, "doc_id long, _local long, n_tokens long, ids_crc32 long, part int, shard int")
    return got.join(F.broadcast(offs), "part").select("doc_id", (F.col("_before") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def op8_token_ids(docs: DataFrame) -> DataFrame:
    return read(write(docs))
