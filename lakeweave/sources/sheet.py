"""GOOGLE_SHEET: a tab of a spreadsheet, through a fetcher that can be replaced.

A fetcher takes (sheet id, tab or None) and returns rows of strings, the header first. The one that is set at the start
reads CSV files `<folder>/<sheet id>/<tab>.csv`, the folder named by the environment variable LAKEWEAVE_SHEETS.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import QueryError

Fetcher = Callable[[str, "str | None"], list[list[str]]]


def from_folder(sheet: str, tab: str | None) -> list[list[str]]:
    folder = os.path.join(os.environ.get("LAKEWEAVE_SHEETS", "."), os.path.basename(sheet))
    names = [f"{os.path.basename(tab)}.csv"] if tab else sorted(x for x in os.listdir(folder) if x.endswith(".csv"))[:1] if os.path.isdir(folder) else []
    path = os.path.join(folder, names[0]) if names else folder
    if not os.path.isfile(path):
        raise QueryError(f"Sheet `{sheet}` has no tab `{tab or ''}`")
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


_fetch: list[Fetcher] = [from_folder]


def set_fetcher(fetch: Fetcher) -> None:
    _fetch[0] = fetch


def string_table(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """A header and rows of strings; short rows are filled with nulls, long ones cut."""
    if not rows or not rows[0]:
        raise QueryError("The source has no header row")
    names = [str(x) for x in rows[0]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    body = [tuple((list(r) + [None] * len(names))[: len(names)]) for r in rows[1:]]
    return spark.createDataFrame(body, schema)


def read_sheet(spark: SparkSession, sheet: str, tab: str | None = None) -> DataFrame:
    """The tab is fetched once, when the query is planned; all uses in the query share its rows."""
    return string_table(spark, _fetch[0](str(sheet), tab))
