from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


def _plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(v + 0.0)
    return repr(v) if isinstance(v, str) else str(v)


@pytest.fixture(scope="session")
def against_sql(spark, data):
    """Run a registered query and its SQL, and compare their rows without order."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")

    def compare(query, sql: str) -> None:
        df = query(spark, data)
        columns = sorted(df.columns)
        ours = sorted(tuple(_plain(x) for x in r) for r in df.select(*columns).collect())
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        place = [names.index(c) for c in columns]
        theirs = sorted(tuple(_plain(r[k]) for k in place) for r in result.fetchall())
        assert ours == theirs

    return compare
