"""Windows whose partitions are too large for a task: rows are dealt by range, and ranges tell each other what they hold.

Rows are ranged by partition, order and, for ties, their place in the input, so that a partition of any size takes as many
tasks as its share of the rows. A range passes on what other ranges' frames need of the partitions that may go on there,
its first and its last one: to later ranges the last `before` rows and one row that stands for all rows ahead of them, to
earlier ranges the first `after` rows and one row for the rest. A range with fewer rows sends no such row, so frames of
rows count right across any number of ranges. Passed rows are dropped in the end. All of it is one line of steps over one
reading of the rows, so no two readings need to agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.window import Merge
from .relation import fresh

#: Rows that a range may pass on to each other one, times ranges; wider frames get fewer ranges.
PASSED = 50_000
LEAST_RANGES = 8


@dataclass
class Dealt:
    """One window column: `make` over the frame, which looks `low` to `high` rows from the current one (None: unbounded).

    Where a bound is None, `merge` says how totals of ranges stand for their rows. `framed`: `make` takes a frame.
    """

    name: str
    make: Column
    args: list[Column]
    low: int | None
    high: int | None
    merge: Merge | None
    framed: bool = True

    @property
    def merged(self) -> bool:
        return self.low is None or self.high is None


def dealt_windows(frame: DataFrame, partition: list[str], order: list[tuple[str, bool]], calls: list[Dealt]) -> DataFrame:
    """frame with a column for each call; order: columns and whether they descend."""
    bounds = [b for c in calls for b in (c.low, c.high) if b is not None]
    before, after = max(0, *(-b for b in bounds), 0), max(0, *bounds, 0)
    ahead, behind = any(c.low is None for c in calls), any(c.high is None for c in calls)
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(ranges, max(LEAST_RANGES, PASSED // (before + after + 1)))
    base = frame.columns
    kinds = dict(frame.select(*(c.make.alias(c.name) if c.framed else F.lit(1).alias(c.name) for c in calls if c.merged)).dtypes) if any(c.merged for c in calls) else {}

    place, at, to, i, n = (fresh() for _ in range(5))
    keys = [F.col(p).asc() for p in partition]
    sort = [*keys, *(F.col(o).desc() if down else F.col(o).asc() for o, down in order), F.col(place).asc()]
    out = frame.withColumn(place, F.monotonically_increasing_id())
    out = out.repartitionByRange(ranges, *sort).withColumn(at, F.spark_partition_id()).repartitionById(ranges, F.col(at))

    whole = (W.unboundedPreceding, W.unboundedFollowing)
    by_range = W.partitionBy(at).orderBy(*sort)
    out = out.select(*base, at, F.row_number().over(by_range).alias(i), F.count(F.lit(1)).over(by_range.rowsBetween(*whole)).alias(n))
    here, left = F.col(at), F.col(n) - F.col(i)

    # What stands for the last partition's rows here without its last `before`, and the first's without its first `after`.
    # Rows of other partitions get such sums and may be passed on too, but no other range has their partitions.
    parts = {c.name: [(fresh(), fresh(), fresh(), row, fold) for row, fold in zip(c.merge.rows(c.args), c.merge.folds)] for c in calls if c.merged}
    totals, part = [], W.partitionBy(at, *partition)
    for made in parts.values():
        for _, head, tail, row, fold in made:
            totals += [fold(F.when(left >= before, row)).over(part).alias(head)] if ahead else []
            totals += [fold(F.when(F.col(i) > after, row)).over(part).alias(tail)] if behind else []
    out = out.select("*", *totals)

    later = F.when((left < before + ahead) & (here < ranges - 1), F.sequence(here + 1, F.lit(ranges - 1)))
    earlier = F.when((F.col(i) <= after + behind) & (here > 0), F.sequence(F.lit(0), here - 1))
    none = F.array().cast("array<int>")
    out = out.withColumn(to, F.explode(F.concat(F.array(here), F.coalesce(later, none), F.coalesce(earlier, none))))
    values = []
    for made in parts.values():
        for name, head, tail, row, _ in made:
            value = F.when((F.col(to) > here) & (left == before), F.col(head)).otherwise(row) if ahead else row
            value = F.when((F.col(to) < here) & (F.col(i) == after + 1), F.col(tail)).otherwise(value) if behind else value
            values.append(value.alias(name))
    out = out.select(*base, at, to, i, *values).repartitionById(ranges, F.col(to))

    there = W.partitionBy(to, *partition)
    forth, back = there.orderBy(at, i), there.orderBy(F.desc(at), F.desc(i))
    results = []
    for c in calls:
        # A frame that only its start bounds is a running frame of the reversed order.
        window, low, high = (back, None, -c.low) if c.low is not None and c.high is None else (forth, c.low, c.high)
        framed = window.rowsBetween(W.unboundedPreceding if low is None else low, W.unboundedFollowing if high is None else high)
        if c.merged:
            made = c.merge.finish([fold(F.col(name)).over(framed) for name, _, _, _, fold in parts[c.name]])
            made = made.cast(kinds[c.name]) if c.framed else made
        else:
            made = c.make.over(framed if c.framed else forth)
        results.append(made.alias(c.name))
    return out.select(*base, at, to, *results).where(F.col(to) == here).select(*base, *(c.name for c in calls))
