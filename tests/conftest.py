"""One Spark session for all tests, and DuckDB views of the small tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def agrees(spark, small, duck):
    """A check that a query returns the rows of its SQL."""

    def check(query, sql: str) -> int:
        df = query(spark, small)
        names = sorted(df.columns)
        ours = sorted(repr(tuple(r)) for r in df.select(*names).collect())
        result = duck.execute(sql)
        theirs_names = [c[0] for c in result.description]
        assert sorted(theirs_names) == names
        order = [theirs_names.index(c) for c in names]
        theirs = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
        assert ours == theirs
        return len(ours)

    return check
