"""Every query with SQL gives what DuckDB gives on the smallest tables; entry() runs."""

import glob
import os

import pytest

import __spark_entry__ as E
from loam.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = {os.path.basename(p)[:-8]: p for p in glob.glob(f"{SF}/*.parquet")}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, same, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], TABLES)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_mixture_takes_the_whole_quota(spark):
    sf = "/root/testdata/sf0.01"
    classified = sum(r["n"] for r in registry.queries()["category_counts"](spark, sf).collect() if r["category"] != "unclassified")
    assert classified > 400
    assert registry.queries()["select_mixture"](spark, sf).count() == min(6000, classified)
    assert sum(r["quota"] for r in registry.queries()["target_counts"](spark, sf).collect()) == 6000


def test_entry(spark):
    assert E.entry(spark).count() == 200
    assert set(registry.queries()) <= set(E.queries())
