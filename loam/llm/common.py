"""Helpers that the operators of this subpackage share.

Words are maximal runs of anything but ASCII white space (space, tab, LF, VT, FF, CR), the set
``bytes.split()`` uses, so Python, Spark and SQL agree on them.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` in one struct column ``_doc``, beside ``more``: no name of a caller's column can clash with what an operator adds."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"), *[v.alias(k) for k, v in more.items()])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it.

    Catalyst would otherwise copy the expression into every place, in lambdas once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_hashes(w: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words; of fewer words, of all of them; of none, nothing."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([h64(b" ".join(w), 42)] if w else [], np.uint64)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    lo = np.concatenate([[0], ends[: len(w) - shingle]]).tolist()
    hi = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((h64(flat[a:b], 42) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))


class Shingles:
    """64-bit hashes of runs of words, from hashes of words; a bounded memory of the words met."""

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, {}

    def words(self, w: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > 500_000:
            self.known = {}
        for x in set(w).difference(self.known):
            self.known[x] = xxhash.xxh64_intdigest(x)
        return np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))

    def of(self, w: list[bytes]) -> np.ndarray:
        """Of each run of so many words; of fewer words, of all of them; of none, nothing."""
        h = self.words(w)
        k = min(self.shingle, len(h))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (local tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loam-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str, codec: str = "zstd", level: int = 3) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


#: Bounds of an Arrow batch, the same for all plans, whenever they run: bytes, as texts and blobs are of any size, and rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


def python_ready(spark: SparkSession) -> None:
    """Before Python runs on executors: they get this package, and Arrow batches of bounded bytes."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="loam-code-")) / "loam-code.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)


def lean() -> None:
    """On an executor, before work that doesn't tokenise: a worker that served a tokenising stage lets go of its caches."""
    m = sys.modules.get("loam.llm.tokens")
    if m:
        m._loaded.clear()


#: At most this many keys can each hold more than 1 / HOT_KEYS of the rows; so small a table may be broadcast.
HOT_KEYS = 500


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], count: str | None, total: int, known: str | None = None) -> DataFrame:
    """Left join to ``right``, which has one row per ``key`` and in ``count`` the left rows of it (None: they are counted here).

    Fewer than HOT_KEYS keys can hold more than ``total / HOT_KEYS`` rows, so those go by broadcast, whatever
    the size of the input, and their rows stay where they are; all other keys are shuffled. ``known``: a column of ``left`` that has the number of
    its key's rows, so that frequent keys without a row in ``right`` aren't shuffled either.
    """
    on = [key] if isinstance(key, str) else key
    bound = max(total // HOT_KEYS, 100)
    if count:
        hot, rest = right.filter(F.col(count) > bound).drop(count), right.filter(F.col(count) <= bound).drop(count)
    else:
        often = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound).select(*on)
        hot, rest = right.join(F.broadcast(often), on, "left_semi"), right
    cols = [c for c in right.columns if c not in (*on, count)]
    tagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    stays = F.col("_hot").isNotNull() | (F.col(known) > bound) if known else F.col("_hot").isNotNull()
    cold = tagged.filter(~stays).drop("_hot", *cols).join(rest, on, "left")
    names = [*left.columns, *cols]
    return tagged.filter(stays).select(*names).unionByName(cold.select(*names))
