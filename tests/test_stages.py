"""A stage is made again if its inputs, settings or code have changed, or if it was left half way; else it is read."""

import json

import pytest
from pyspark.sql import functions as F

from loam.sources import sinks, stages


def test_kept_stages(spark, tmp_path):
    made = []
    source, top = f"{tmp_path}/in", f"file://{tmp_path}/out"

    def put(n):
        spark.range(n).coalesce(1).write.mode("overwrite").json(source)

    def run(least, code="1", fail=False):
        def make():
            made.append(least)
            bad = F.raise_error(F.lit("lost")) if fail else F.col("id")
            return spark.read.schema("id long").json(source).filter(F.col("id") >= least).select(F.when(F.col("id") == 5, bad).otherwise(F.col("id")).alias("id"))

        return stages.kept(spark, top, "filter", [source], {"least": least}, make, code).count()

    put(10)
    assert run(2) == 8 and run(2) == 8 and made == [2]
    assert run(3) == 7 and made == [2, 3]
    assert run(3, code="2") == 7 and made == [2, 3, 3]
    put(20)
    assert run(3, code="2") == 17 and made == [2, 3, 3, 3]
    with pytest.raises(Exception, match="lost"):
        run(4, fail=True)
    held = json.loads((tmp_path / "out/filter/manifest.json").read_text())
    assert held["settings"] == {"least": 3} and held["rows"] == 17  # the manifest is still that of the last whole table
    assert run(4) == 16 and run(4) == 16 and made == [2, 3, 3, 3, 4, 4]
    held = json.loads((tmp_path / "out/filter/manifest.json").read_text())
    assert held["rows"] == 16 and all(len(f["sha256"]) == 64 for f in held["inputs"]) and held["code"] == "1"


def test_the_same_contents_elsewhere_are_the_same(spark, tmp_path):
    for d in ("a", "b"):
        sinks.jsonl(spark.range(3).coalesce(1), f"{tmp_path}/{d}")
    a, b = (stages.made_of(spark, "s", [f"{tmp_path}/{d}/*.json"], {"x": 1}) for d in ("a", "b"))
    assert a["key"] == b["key"] and a["inputs"] != b["inputs"] and len(stages.code_digest()) == 64
