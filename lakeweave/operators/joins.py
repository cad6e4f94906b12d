"""Joins beyond what adaptive execution does by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join with each of the left's keys dealt to `salts` tasks, and the right repeated as often.

    For keys so hot that splitting partitions at run time is not enough. how: inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is an inner or left join")
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in left.dtypes if "map" not in t]), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt_right", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, (dealt[left_key] == repeated[right_key]) & (F.col("_salt") == F.col("_salt_right")), how).drop("_salt", "_salt_right")
