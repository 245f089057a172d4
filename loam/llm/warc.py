"""WARC archives with an index: records are written once, found by file, offset and length, and read back in few large ranges.

* Of pages with equal payloads of at least LEAST bytes, one is elected by digest, without the payloads: the others are revisits of it.
* Each task writes the records of its rows to files of its own, a gzip member a record, and returns their index rows: file, offset, length, URL
  and digest. The index is a Parquet table that Spark commits, so it names the files of attempts that succeeded and no others; what a lost attempt
  has written is never read.
* ``read`` takes any rows of the index, sorts them by file and offset, and reads neighbours with gaps of at most GAP bytes at once. Each record
  is parsed, and a payload must have the digest that its record states.
* A revisit holds no payload; its size and digest are those of the response that it refers to, joined by record id.

Archives go to the shared folder by pyarrow's file systems, so a local mount, HDFS or an object store will do.

Edge cases: a null html is empty; null ids come last, so such a page is a response only if all of its equals have none, and what revisits it has a
null refers_to; rows that repeat an id and payload are one response and revisits of it; an empty table gives no archive and no row; a page of any length is one record;
a null or empty url is stored as about:blank, and characters that a header can't hold are percent-encoded. Columns beyond page_id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import join_unique, python_ready, quoted, shared_dir, written

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes after which a task begins another archive.
FILE_BYTES = 1 << 30
#: Bytes of one read, if a record isn't longer, and of a gap that is read with its neighbours.
READ_BYTES, GAP = 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The named field that holds the caller's key.
PAGE = "X-Page-Id"
INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record as a gzip member of its own; fields without a value are left out."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return gzipped(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields and block."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.decode().split(": ", 1) for x in lines)
    block = data[end + 4 : -4]
    if len(block) != int(fields["Content-Length"]) or data[-4:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it states")
    return fields, block


def http(payload: bytes | None, size: int) -> bytes:
    """An HTTP message; without a payload its head alone, as a revisit holds it."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")


def target(url: str | None) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: quote(m[0], safe="", errors="replace"), url or "") or "about:blank"


def _named(digest: str, file: str, row: int) -> str:
    """A record's id, of its payload's digest and the row's place."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{digest}:{file}:{row}'.encode()).hexdigest()[:32])}>"


def _rows(pages: DataFrame) -> DataFrame:
    """``pages`` with the file and row that each was read from; rows that come from no file are written to some first."""
    pages = pages.select(quoted("page_id").cast("long").alias("page_id"), quoted("url").cast("string").alias("url"), quoted("html").cast("string").alias("html"))
    try:
        place = pages.metadataColumn("_metadata")
        rows = pages.select("page_id", "url", "html", place["file_path"].alias("_file"), place["row_index"].alias("_row"))
        rows.schema  # noqa: B018  fails here if there is no such column
    except AnalysisException:
        pages = written(pages, "pages")
        rows = pages.select("page_id", "url", "html", "_metadata.file_path", "_metadata.row_index").toDF("page_id", "url", "html", "_file", "_row")
    html = F.coalesce("html", F.lit(""))
    return rows.withColumns({"html": html, "digest": F.sha2(html, 256), "size": F.octet_length(html).cast("long")})


def elected(rows: DataFrame) -> DataFrame:
    """(digest, n, first, first_url): for payloads that several rows have, the place and url of the row with the smallest page_id."""
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("_file").alias("file"), F.col("_row").alias("row"), "url")
    found = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("o")).filter("n > 1")
    return found.select("digest", "n", F.struct("o.file", "o.row").alias("first"), F.col("o.url").alias("first_url"))


def write(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of all ``pages``; returns their index, a row per record, read from where it was written."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/loam/warc-{uuid.uuid4().hex}"
    rows = _rows(pages)
    rows = join_unique(rows, elected(rows), "digest", "n", rows.count())
    again = (F.col("first.file") != F.col("_file")) | (F.col("first.row") != F.col("_row"))
    rows = rows.select("page_id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("html")).alias("html"), "digest", "size", "_file", "_row", "first.file", "first.row", "first_url")

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        task, n, out, at = TaskContext.get(), 0, None, 0
        try:
            for b in batches:
                found = []
                for r in b.to_pylist():
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        name = f"{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.gz"
                        out, n = store.open_output_stream(f"{top}/{name}", compression=None), n + 1  # members are compressed one by one
                        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    revisit, key = r["html"] is None, r["page_id"]
                    fields = [
                        ("WARC-Type", "revisit" if revisit else "response"),
                        ("WARC-Record-ID", _named(r["digest"], r["_file"], r["_row"])),
                        ("WARC-Date", DATE),
                        ("WARC-Target-URI", target(r["url"])),
                        ("WARC-Payload-Digest", f"sha256:{r['digest']}"),
                        (PAGE, None if key is None else str(key)),
                        ("Content-Type", "application/http; msgtype=response"),
                    ]
                    if revisit:
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _named(r["digest"], r["file"], r["row"])), ("WARC-Refers-To-Target-URI", target(r["first_url"])), ("WARC-Refers-To-Date", DATE)]
                    member = record(fields, http(None if revisit else r["html"].encode(), r["size"]))
                    out.write(member)
                    found.append((key, r["url"], fields[0][1], r["digest"], name, at, len(member)))
                    at += len(member)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _INDEX, strict=True)], schema=_INDEX)
        finally:
            if out:
                out.close()

    python_ready(spark)
    index = written(rows.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(f"{path}/"), "file"))


def ranges(files: list[str], offsets: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Runs [i, j) of records, in order of file and offset, that are read at once."""
    out, lo = [], 0
    for i in range(1, len(files) + 1):
        if i < len(files) and files[i] == files[lo]:
            gap = offsets[i] - offsets[i - 1] - lengths[i - 1]
            if gap <= GAP and offsets[i] + lengths[i] - offsets[lo] <= READ_BYTES:
                continue
        if lo < i:
            out.append((lo, i))
        lo = i
    return out


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name: record_id, page_id, record_type, refers, payload_digest, payload_bytes, payload (null without ``payloads``, and in revisits)."""

    def run(batches):
        from pyarrow import fs

        now, store, f = None, None, None
        for b in batches:
            files, offsets, lengths = (b.column(c).to_pylist() for c in ("file", "offset", "length"))
            for lo, hi in ranges(files, offsets, lengths):
                if files[lo] != now:
                    if f:
                        f.close()
                    now = files[lo]
                    store, name = fs.FileSystem.from_uri(now)
                    f = store.open_input_file(name)
                start = offsets[lo]
                data = memoryview(f.read_at(offsets[hi - 1] + lengths[hi - 1] - start, start))
                out = []
                for o, n in zip(offsets[lo:hi], lengths[lo:hi], strict=True):
                    fields, block = parsed(data[o - start : o - start + n])
                    digest, key = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get(PAGE)
                    body, size = None, None
                    if fields["WARC-Type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        size = len(body)
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError("a payload differs from its digest")
                    out.append((fields["WARC-Record-ID"], None if key is None else int(key), fields["WARC-Type"], fields.get("WARC-Refers-To"), digest, size, body if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)
        if f:
            f.close()

    spark = index.sparkSession
    python_ready(spark)
    # index rows are small beside what they name, so tasks are dealt by the bytes that they will read
    share = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // share))
    order = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return order.mapInArrow(run, "record_id string, page_id long, record_type string, refers string, payload_digest string, payload_bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with revisits completed from the responses that they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    whole = records.filter("record_type = 'response'")
    to = whole.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    revisits = records.filter("record_type = 'revisit'").join(to, "refers")
    same = F.when(F.col("d") == F.col("payload_digest"), F.col("d")).otherwise(F.raise_error(F.lit("a revisit of another payload")))
    rows = whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return rows.unionByName(revisits.select("page_id", F.col("n").alias("payload_bytes"), same.alias("payload_digest"), "record_type", "refers_to"))


def op12_warc(pages: DataFrame) -> DataFrame:
    return resolved(written(read(write(pages), payloads=False).drop("payload"), "warc-read"))


OP12_SQL = """
SELECT page_id, strlen(h) AS payload_bytes, d AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND k > 1 THEN least_id END AS refers_to
FROM (SELECT page_id, h, d, row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY d) AS least_id
  FROM (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages))
"""
