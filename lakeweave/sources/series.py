"""GENERATE_SERIES: the whole numbers from 0 to count - 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError


def generate_series(spark: SparkSession, count: int, delay: float = 0) -> DataFrame:
    """Column i. A batch query has all rows at hand, so `delay` paces only the stream (streaming.paced_series)."""
    if not isinstance(count, int) or isinstance(count, bool):
        raise QueryError("GENERATE_SERIES takes a whole number of rows")
    return spark.range(max(count, 0)).select(F.col("id").alias("i"))
