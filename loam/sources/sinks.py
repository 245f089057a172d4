"""Writers: JSON lines, texts by split, manifests, reports, token files."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def jsonl(df: DataFrame, path: str, keep: bool = False) -> None:
    """``keep``: what is there already stays, and nothing is computed."""
    df.write.mode("ignore" if keep else "overwrite").json(path)


class _TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, replaces: bool):
        # names of a later write sort after those of an earlier one
        self.path, self.replaces, self.write_id = path, replaces, f"{time.time_ns():020d}"

    def write(self, batches: Iterator) -> WriterCommitMessage:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(top, recursive=True)
        c = TaskContext.get()
        name = f"{top}/.{self.write_id}-{c.partitionId():06d}-{c.taskAttemptId()}"
        with store.open_output_stream(name) as out:
            for b in batches:
                if b.column(0).null_count:
                    raise ValueError("a row has no ids")
                out.write(b.column(0).flatten().to_numpy().astype("<i4", copy=False).tobytes())
        return _Part(name, c.partitionId())

    def commit(self, messages: list) -> None:
        """Only files of tasks that ended get their names. Of a path that is written again, the files that were there before go, and so do hidden ones of lost attempts."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        before = [f.path for f in store.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("part-") and f.base_name.endswith(".bin")] if self.replaces else []
        for m in messages:
            if m:
                store.move(m.name, f"{top}/part-{self.write_id}-{m.part:06d}.bin")
        for f in before:
            store.delete_file(f)
        self._drop_hidden()

    def abort(self, messages: list) -> None:
        self._drop_hidden()

    def _drop_hidden(self) -> None:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if f.base_name.startswith(f".{self.write_id}-"):
                store.delete_file(f.path)


@dataclass
class _Part(WriterCommitMessage):
    name: str
    part: int


class TokenFiles(DataSource):
    """Flat little-endian int32 files, one a partition, of rows (ids) in their order; read in ranges of a file, whatever its size.

    Options: path, a file or folder; and for reading ``range``, the ids of one row (2^18 if not given). What an overwrite replaces goes once the new files are in place.
    """

    @classmethod
    def name(cls) -> str:
        return "int32_tokens"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TokenWriter(self.options["path"], overwrite)

    def schema(self) -> str:
        return "file string, start long, ids array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options["path"], int(self.options.get("range", 1 << 18)))


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    stop: int


class _TokenReader(DataSourceReader):
    #: Ids that one task reads.
    SHARE = 1 << 25

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[_Range]:
        """Ranges of whole rows, from the files' sizes alone."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(top)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(top)) if f.is_file and f.base_name[:1] not in "._"]
        share = max(1, self.SHARE // self.width) * self.width
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.size % 4:
                raise ValueError(f"{f.path} doesn't hold whole 32-bit ids")
            out += [_Range(f.path, lo, min(lo + share, f.size // 4)) for lo in range(0, f.size // 4, share)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        if part.start < part.stop:
            store, _ = fs.FileSystem.from_uri(self.path)
            with store.open_input_file(part.file) as f:
                for lo in range(part.start, part.stop, self.width):
                    n = min(self.width, part.stop - lo)
                    ids = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(f.read_at(4 * n, 4 * lo))])
                    row = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([lo], pa.int64()), row], names=["file", "start", "ids"])


def token_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``df`` (ids) to ``path``, a URI that every executor reaches; ``append`` adds files after those that are there."""
    df.sparkSession.dataSource.register(TokenFiles)
    df.select(F.col("ids").cast("array<int>").alias("ids")).write.format("int32_tokens").mode(mode).save(path)


def token_ranges(spark: SparkSession, path: str, width: int = 1 << 18) -> DataFrame:
    """(file, start, ids): the ids of flat int32 files in rows of ``width``, from their place ``start`` in the file."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("int32_tokens").option("range", width).load(path)


def split_texts(df: DataFrame, path: str, mark: str = "<eos>") -> None:
    """``df`` (split, text) to a folder of text files per split, each text followed by a line of ``mark``."""
    df.select("split", F.concat("text", F.lit(f"\n{mark}")).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def manifest(spark: SparkSession, values: Mapping, path: str) -> None:
    """Indented JSON with sorted keys."""
    text = json.dumps(values, sort_keys=True, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files of any size, empty ones too: Spark lists them, and each streams through one hash on an executor, a few MB at a time."""

    def hashed(batches):
        import hashlib
        from urllib.parse import unquote

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            out = []
            for uri in b.column("uri").to_pylist():
                h, n = hashlib.sha256(), 0
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(name, compression=None) as f:
                    while part := f.read(4 << 20):
                        h.update(part)
                        n += len(part)
                out.append((unquote(uri), n, h.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "sha256"), x, strict=True)) for x in out], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    uris = [(u,) for u in spark.read.format("binaryFile").load(path).inputFiles()]
    files = spark.createDataFrame(uris, "uri string").repartition(max(1, min(len(uris), spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(hashed, "path string, bytes long, sha256 string")


def run_manifest(spark: SparkSession, data: Sequence[str], parameters: Mapping, path: str) -> dict:
    """What a run was made of: the code, its parameters, and bytes and SHA-256 of each of the named files; written to ``path``."""
    files = [] if not data else [r.asDict() for p in data for r in file_hashes(spark, p).orderBy("path").collect()]  # a row per named file
    made = {"code": code_version(), "parameters": dict(parameters), "data": files, "bytes": sum(f["bytes"] for f in files)}
    manifest(spark, made, path)
    return made


def code_version() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def markdown(counts: DataFrame, title: str, path: str) -> None:
    """A report of (item, n), the largest first and every item, as one Markdown file written by Spark."""
    line = F.concat(F.lit("- "), F.coalesce(F.col("item").cast("string"), F.lit("unknown")), F.lit(": "), F.format_number("n", 0))
    rows = counts.select(F.lit(1).alias("part"), "n", "item", line.alias("value"))
    head = counts.sparkSession.createDataFrame([(0, f"# {title}\n")], "part int, value string").select("part", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("item"), "value")
    whole = head.unionByName(rows.withColumn("item", F.col("item").cast("string"))).orderBy("part", F.desc("n"), "item")
    whole.select("value").coalesce(1).write.mode("overwrite").text(path)
