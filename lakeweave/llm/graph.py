"""Connected components by alternating large-star and small-star steps, for operators 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) of any orderable type -> rows (node, root): root is the smallest node of node's component.

    Nodes that are their own root are left out, as are self-loops, repeated edges and edges with a null end. No edges
    give no rows. Each round is written to the shared folder, so lineage stays one round long; a node with very many
    edges is aggregated before it is shuffled and its join is left to skew splitting.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = keep(pairs.distinct(), name)
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo")))
        after = keep(small.distinct(), name)
        drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
