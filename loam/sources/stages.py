"""Stages of a job that are kept: a table is made again only if what it is made of has changed.

A stage's key is a digest of its name, its inputs' contents, its settings and the code. Its table goes to a folder of that key, and then its manifest
is put in place in one move. A stage without a manifest of its key, as after a crash half way, is made again from nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loam.sources.sinks import file_hashes
from loam.streaming.progress import get, put_whole


def code_digest() -> str:
    """SHA-256 of this package's sources; the subpackage of training-data operators isn't part of it."""
    top = Path(__file__).resolve().parents[1]
    h = hashlib.sha256()
    for p in sorted(top.rglob("*.py")):
        name = p.relative_to(top).as_posix()
        if not name.startswith("llm/"):
            h.update(f"{name}\0{hashlib.sha256(p.read_bytes()).hexdigest()}\n".encode())
    return h.hexdigest()


def made_of(spark: SparkSession, name: str, inputs: Sequence[str], settings: Mapping, code: str | None = None) -> dict:
    """What a stage's table depends on: each input file with its bytes and SHA-256, the settings, the code; and the key, a digest of all that.

    Where a file lies doesn't count, what it holds does.
    """
    files = [r.asDict() for p in inputs for r in file_hashes(spark, p).orderBy("path").collect()]  # a row per file
    held = {"stage": name, "settings": dict(settings), "code": code or code_digest(), "inputs": sorted((f["bytes"], f["sha256"]) for f in files)}
    key = hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()
    return held | {"inputs": files, "key": key}


def kept(spark: SparkSession, top: str, name: str, inputs: Sequence[str], settings: Mapping, make: Callable[[], DataFrame], code: str | None = None) -> DataFrame:
    """The table of stage ``name`` under the folder ``top``, a URI: what is there if it was made of the same, else what ``make`` gives.

    ``manifest.json`` beside the table says what it was made of, its rows and where it is.
    """
    manifest, now = f"{top}/{name}/manifest.json", made_of(spark, name, inputs, settings, code)
    before = get(manifest)
    if before is None or before["key"] != now["key"]:
        table = f"{top}/{name}/{now['key'][:32]}"
        make().write.mode("overwrite").parquet(table)
        before = now | {"table": table, "rows": spark.read.parquet(table).count()}
        put_whole(manifest, json.dumps(before, sort_keys=True, indent=2, default=str) + "\n")
    return spark.read.parquet(before["table"])
