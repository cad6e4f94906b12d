"""Running totals over a whole table without moving it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def running_total(frame: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """frame with the sum of `value` over all rows up to each, by `order` (unique numbers; rows without one come first).

    Rows are dealt by range of the order; each range is summed alone and the ranges' totals, one row each, are added up.
    """
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = frame.approxQuantile(order, [i / tasks for i in range(1, tasks)], 0.001) if tasks > 1 else []
    above = F.aggregate(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))).cast("array<double>"), F.lit(0), lambda n, c: n + (F.col(order) > c).cast("int"))
    dealt = frame.withColumn("_range", F.coalesce(above, F.lit(0)))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_range", before.alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
