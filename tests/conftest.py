import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def _cell(x):
    import pandas as pd

    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if hasattr(x, "__len__") and not isinstance(x, str):
        return tuple(map(_cell, x))
    if pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else x if isinstance(x, bool) else str(x)


def rows(pdf):
    """Rows in an order of their own, columns by name, numbers to nine digits."""
    names = sorted(pdf.columns)
    return names, sorted((tuple(map(_cell, r)) for r in pdf[names].itertuples(index=False, name=None)), key=repr)
