"""Top rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def top_per_group(frame: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order. Spark limits each group before the shuffle, so a hot group
    sends k rows a task."""
    place = "_place"
    while place in frame.columns:
        place += "_"
    return frame.withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(place) <= k).drop(place)
