import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query gives the rows of its SQL, columns and rows in any order."""

    def key(x):
        if x is None or pd.isna(x):
            return "null"
        return f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return list(frame.columns), sorted(tuple(key(x) for x in r) for r in frame.astype(object).itertuples(index=False))

    def run(query, sql):
        assert rows(query(spark, DATA).toPandas()) == rows(duck.execute(sql).df())

    return run
