"""The paced series: GENERATE_SERIES(count, delay) as a stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paced_series(spark: SparkSession, count: int, delay: float) -> DataFrame:
    """A streaming frame of i = 0..count-1, about one row each `delay` seconds."""
    rate = max(1, math.floor(1 / delay)) if delay > 0 else 1000
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().where(F.col("value") < count).select(F.col("value").alias("i"))
