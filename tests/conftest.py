import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Holds a query against its SQL, as sets of rows."""
    import duckdb

    def check(df, sql, tables: dict):
        con = duckdb.connect()
        for name, path in tables.items():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        want = con.sql(sql).df()
        got = df.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)

        def rows(x):
            norm = lambda v: None if v is None or v != v else (round(float(v), 6) if isinstance(v, float) else str(v))
            return sorted(map(str, x[cols].map(norm).itertuples(index=False, name=None)))

        assert len(got) == len(want)
        fix = lambda r: [x.replace(".0,", ",").replace(".0)", ")").replace("'", "") for x in r]
        assert fix(rows(got)) == fix(rows(want))

    return check
