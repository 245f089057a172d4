"""Media columns: media files cut by content into chunks, kept once each, and put together again from ordered chunk lists.

A text's payload is its UTF-8 bytes and bytes 255 up to a multiple of UNIT; its stored form is a WAV file of 8-bit samples, one per payload
byte. The file's bytes, header included, are what is cut, stored, put together and parsed again. A rolling gear hash cuts files where the hash of the last 16 bytes ends in zero bits, so an insertion moves
cuts near it only. A chunk's digest is its SHA-256.

* The spool table has a row per chunk of each document: the manifest, and the chunk's bytes where this task meets the
  digest first.
* Digests are elected by Spark: of each one exactly one spool row is the stored chunk; manifests of all other documents lead to it.
* A file of one chunk is read back where it lies. Distinct longer files are put together from their lists of chunks, by joins on digests; the
  lists of equal files are equal and done once.
* What is read back must have the file's SHA-256 and parse as a WAV file; its samples are what all values are computed from.

Edge cases: null and empty texts have a payload of UNIT bytes 255; repeated rows and copies share all chunks and have equal values; an empty table
gives no rows; a text of any length is stored whole. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common

UNIT = 576
PAD = b"\xff"
LEAST, MOST = 8 << 10, 64 << 10
#: Zero bits at a cut: on average a cut every 8 KiB after the least size.
CUT_BITS = 13
RATE = 8000
#: Bytes of the header.
HEADER = 44
#: Bytes of a SHA-256 that name a chunk or payload in joins.
KEY = 16
#: Digests that a task remembers for not storing a chunk twice; election drops what it forgets.
REMEMBERED = 200_000
#: The gear: 256 pseudo-random numbers from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def cuts(data: bytes) -> list[int]:
    """Where chunks end."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # doubles the window up to 16 bytes
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero((h >> np.uint32(3)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    out, last = [], 0
    while n - last > LEAST:
        i = int(np.searchsorted(at, last + LEAST))
        end = int(at[i]) if i < len(at) else n
        last = min(end, last + MOST, n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def stored_header(size: int) -> bytes:
    """RIFF header of a WAV file, one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def stored(text: str | None) -> bytes:
    data = payload(text)
    return stored_header(len(data)) + data


def samples(media: bytes) -> bytes:
    """The samples of a WAV file of this form."""
    riff, size, wave, fmt, n_fmt, kind, channels, rate, _, _, bits, mark, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, n_fmt, mark, kind, channels, rate, bits) != (b"RIFF", b"WAVE", b"fmt ", 16, b"data", 1, 1, RATE, 8) or size + 8 != len(media) or n + HEADER != len(media):
        raise ValueError("not a WAV file of this form")
    return media[HEADER:]


def features(data: bytes) -> str:
    """Sum, sum of squares, crossings of the middle, commonest sample and number of different samples."""
    x = np.frombuffer(data, np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256)
    high = x >= 128
    return f"sum={int(n @ v)};squares={int(n @ (v * v))};crossings={int((high[1:] != high[:-1]).sum())};mode={int(n.argmax())};kinds={int((n > 0).sum())}"


_SPOOL = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("n_chunks", pa.int32()), ("want", pa.binary()), ("digest", pa.binary()), ("data", pa.binary())])
_SPOOL_SQL = "doc_id long, row long, seq int, n_chunks int, want binary, digest binary, data binary"


def spool(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        seen: set = set()
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            cols: list[list] = [[] for _ in _SPOOL]
            held = 0
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = stored(t)
                want, ends, lo = hashlib.sha256(data).digest()[:KEY], cuts(data), 0
                for k, hi in enumerate(ends):
                    part = data[lo:hi]
                    digest = hashlib.sha256(part).digest()[:KEY] if len(ends) > 1 else want
                    # chunks of long payloads are kept among themselves, so that only those are moved
                    name = (digest, len(ends) > 1)
                    new = name not in seen
                    if new and len(seen) < REMEMBERED:
                        seen.add(name)
                    for c, v in zip(cols, (d, row, k, len(ends), want, digest, part if new else None), strict=True):
                        c.append(v)
                    held += len(part) * new
                    lo = hi
                row += 1
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SPOOL, strict=True)], schema=_SPOOL)
                    cols, held = [[] for _ in _SPOOL], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SPOOL, strict=True)], schema=_SPOOL)

    common.python_ready(docs.sparkSession)
    return common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SPOOL_SQL), "spool", level=9)


_READ = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string())])
_READ_SQL = "n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _read_back(want: bytes, media: bytes) -> tuple:
    sha = hashlib.sha256(media).digest()
    if sha[:KEY] != want:
        raise ValueError("a stored file differs from what was stored")
    data = samples(media)
    return len(data.rstrip(PAD)), len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-32:]), len(media), sha, features(data)


def _of_single(batches):
    kept = pa.schema([("want", pa.binary()), ("row", pa.int64()), ("seq", pa.int32()), *_READ])
    for b in batches:
        rows = [(w, r, s, *_read_back(w, d)) for w, r, s, d in zip(*(b.column(c).to_pylist() for c in ("want", "row", "seq", "data")), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kept, strict=True)], schema=kept)


def _of_many(table: pa.Table) -> pa.Table:
    want = table.column("want")[0].as_py()
    parts = sorted(zip(table.column("seq").to_pylist(), table.column("data").to_pylist(), strict=True))
    row = (want, *_read_back(want, b"".join(d for _, d in parts)))
    return pa.table([pa.array([v], t) for v, t in zip(row, (pa.binary(), *_READ.types), strict=True)], names=["want", *_READ.names])


def manifests(s: DataFrame) -> DataFrame:
    """Each document's ordered chunk list."""
    return s.groupBy("row", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda x: x["digest"]).alias("chunks"))


def store_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    s = spool(docs)
    many = F.col("n_chunks") > 1
    kept = F.col("data").isNotNull()
    # the store: of each digest (for long payloads and others apart) the first row that has its bytes
    elected = s.filter(kept).groupBy("digest", many.alias("many")).agg(F.min(F.struct("row", "seq")).alias("at"))
    at = elected.select("many", "digest", F.col("at.row").alias("row"), F.col("at.seq").alias("seq"))
    common.python_ready(spark)
    one = s.filter(~many & kept).select("want", "row", "seq", "data").mapInArrow(_of_single, f"want binary, row long, seq int, {_READ_SQL}")
    one = one.join(at.filter("NOT many").select("row", "seq"), ["row", "seq"], "left_semi").drop("row", "seq")
    lists = s.filter(many).groupBy("want").agg(F.min("row").alias("row"))
    lists = s.filter(many).select("want", "row", "seq", "digest").join(lists, ["want", "row"], "left_semi").drop("row")
    # where each chunk of a list is stored, then its bytes, once to each list; the stored rows are unique, so skew-join handling can split
    # the lists of a chunk that very many distinct payloads share
    places = lists.alias("lists").join(at.filter("many").alias("at"), "digest").select("want", F.col("lists.seq").alias("place"), F.col("at.row").alias("row"), F.col("at.seq").alias("seq"))
    store = s.filter(many & kept).select("row", "seq", "data")
    long_ = places.join(store, ["row", "seq"]).select("want", F.col("place").alias("seq"), "data").groupBy("want").applyInArrow(_of_many, f"want binary, {_READ_SQL}")
    heads = s.filter("seq = 0").select("doc_id", "want", "n_chunks")
    n = heads.count()
    values = common.written(one.unionByName(long_), "read-back")
    got = common.join_unique(heads, values, "want", None, n).drop("want")
    return got.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def op5_media(docs: DataFrame) -> DataFrame:
    return store_and_read(docs)
