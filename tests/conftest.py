import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL at sf0.01, as bags of rows."""

    def check(query, sql):
        got = query(spark, SF)
        want = duck.sql(sql)
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        key = lambda r: repr(r)
        a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
        b = sorted((tuple(r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
        assert len(a) == len(b)
        assert a == b

    return check
