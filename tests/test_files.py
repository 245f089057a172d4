"""Token files in ranges, written again and after failures; files' digests; reports."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.sources import sinks


def names(path):
    return sorted(f for f in os.listdir(path) if not f.endswith(".crc"))


def ids_of(spark, path, width=1 << 18):
    rows = sorted((r["file"], r["start"], r["ids"]) for r in sinks.token_ranges(spark, f"file://{path}", width).collect())
    return [x for _, _, ids in rows for x in ids]


def test_ranges_of_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks._TokenReader, "SHARE", 1000)
    want = np.arange(2345, dtype="<i4") * 7 - 5000
    (tmp_path / "one.bin").write_bytes(want.tobytes())
    df = sinks.token_ranges(spark, f"file://{tmp_path}/one.bin", 100)
    rows = sorted((r["start"], r["ids"]) for r in df.collect())
    assert [s for s, _ in rows] == list(range(0, 2345, 100)) and [x for _, ids in rows for x in ids] == want.tolist()
    assert len(sinks._TokenReader(f"file://{tmp_path}/one.bin", 100).partitions()) == 3
    (tmp_path / "none.bin").write_bytes(b"")
    assert sinks.token_ranges(spark, f"file://{tmp_path}/none.bin").count() == 0
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole 32-bit ids"):
        sinks.token_ranges(spark, f"file://{tmp_path}/odd.bin").count()


def test_a_large_file_is_many_tasks(tmp_path):
    """3 GB, sparse: planned from its size."""
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(3 << 30)
    parts = sinks._TokenReader(f"file://{tmp_path}/big.bin", 1 << 18).partitions()
    assert len(parts) == 24 and parts[0].start == 0 and parts[-1].stop == (3 << 30) // 4 and all(a.stop == b.start for a, b in zip(parts, parts[1:], strict=False))


def test_written_again(spark, tmp_path):
    path = f"{tmp_path}/ids"
    many = spark.createDataFrame([([k, k + 1],) for k in range(40)], "ids array<int>")
    sinks.token_files(many.repartition(4), f"file://{path}")
    assert len(names(path)) == 4 and sorted(ids_of(spark, path)) == sorted(x for k in range(40) for x in (k, k + 1))
    sinks.token_files(spark.createDataFrame([([7, 8, 9],)], "ids array<int>").coalesce(1), f"file://{path}")
    assert len(names(path)) == 1 and ids_of(spark, path) == [7, 8, 9]
    sinks.token_files(spark.createDataFrame([([1],)], "ids array<int>").coalesce(1), f"file://{path}", "append")
    assert ids_of(spark, path) == [7, 8, 9, 1]
    bad = spark.range(8).repartition(2).select(F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.array(F.col("id").cast("int"))).alias("ids"))
    with pytest.raises(Exception, match="lost"):
        sinks.token_files(bad, f"file://{path}")
    assert ids_of(spark, path) == [7, 8, 9, 1] and all(n.startswith("part-") for n in names(path))


def test_digests_of_files(spark, tmp_path):
    for k, size in enumerate((0, 10, 9 << 20)):
        (tmp_path / f"f {k}.bin").write_bytes(os.urandom(size))
    got = {os.path.basename(r["path"]).replace("%20", " "): (r["bytes"], r["sha256"]) for r in sinks.file_hashes(spark, f"{tmp_path}").collect()}
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    assert got == want


def test_every_item_is_reported(spark, tmp_path):
    counts = spark.range(3000).select(F.concat(F.lit("item "), "id").alias("item"), (F.col("id") * 2).alias("n"))
    sinks.markdown(counts, "Corpus", f"{tmp_path}/report")
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/report", wholetext=True).collect())
    lines = text.strip().split("\n")
    assert lines[:3] == ["# Corpus", "", "- item 2999: 5,998"] and len(lines) == 3002 and lines[-1] == "- item 0: 0"
