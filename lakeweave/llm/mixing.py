"""Operator 1, mixing sources to target weights: hash-threshold histograms.

Each source's target is met by whole copies of all its documents and, for the rest, by the documents whose hash lies
below a threshold. The threshold is found without sorting: sizes are summed by source and hash bucket, the bucket in
which the budget ends is found, and only that bucket is refined, by the next digits of the hash. Nested budgets follow:
what the boundary document leaves open is filled the same way from documents that are no larger than what is open, until
no document left fits into it.

Defined results: a null text has size 0; a null source is a source, last in order; a null key hashes as the text
'null'; rows of equal key are taken or left together, as are keys of equal hash (ties); repeated rows count each;
sources without words have target 0; an empty table gives an empty result; other columns, whatever their names, are
ignored, or kept by mixed_rows(); texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .store import broadcast_below, keep, read_all

WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters: weights by a source's place, share of all words, most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Digits of the hash: LEVELS steps of STEP bits.
STEP, LEVELS = 12, 5
BITS = STEP * LEVELS
#: Per-source figures are broadcast up to so many sources (some 20 MB); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def hash60(key: Column, seed: str) -> Column:
    """60 bits of the MD5 of seed:key."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with `number`, from 0 in order of skey: ranges are numbered alone, one count a range reaches the driver."""
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(sources.repartitionByRange(tasks, "skey").withColumn("pid", F.spark_partition_id()), "mix-sources")
    offsets, total = [F.lit(-1), F.lit(0).cast("long")], 0
    for pid, n in sorted(dealt.groupBy("pid").count().collect()):
        offsets += [F.lit(pid), F.lit(total).cast("long")]
        total += n
    place = F.row_number().over(W.partitionBy("pid").orderBy("skey")) - 1
    return dealt.withColumn("number", F.element_at(F.create_map(*offsets), F.col("pid")) + place).drop("pid")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """sources (skey, source_size) -> with target: shares by weight, capped at `most` times the size, the excess reshared.

    The level (words per unit of weight) only rises as sources reach their cap; each round is one aggregate.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    table = keep(_numbered(sources).withColumn("weight", w).drop("number"), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * float(most) <= F.lit(level) * F.col("weight")
        n, held, rest = table.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size") * float(most)).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (share * total - held) / rest
    return table.withColumn("target", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("weight")))


def _thresholds(rows: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """Per source with rows: the largest hash threshold below which sizes stay within the budget, and their sum.

    rows (skey, h, size); budgets (skey, budget). Returns (skey, thr, got); thr is 2**BITS where all rows fit.
    """
    state, found = budgets.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("got")), []
    before = F.coalesce(F.sum("s").over(W.partitionBy("skey").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    for level in range(LEVELS):
        shift = BITS - STEP * (level + 1)
        inside = rows.join(broadcast_below(state, n, BROADCAST_SOURCES), "skey").where(F.shiftright("h", shift + STEP) == F.col("prefix"))
        bins = inside.groupBy("skey", "budget", "got", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        # The boundary is the first bin that oversteps; without one, all rows of the source (or of the bin above) fit.
        over = (F.col("got") + F.col("before") <= F.col("budget")) & (F.col("got") + F.col("before") + F.col("s") > F.col("budget"))
        edges = bins.withColumn("before", before).groupBy("skey", "budget", "got").agg(F.min(F.when(over, F.struct("bin", "before", "lo", "hi"))).alias("e"), F.sum("s").alias("all"))
        one = (F.col("e.lo") == F.col("e.hi")) | F.lit(level == LEVELS - 1)
        found.append(
            keep(
                edges.select(
                    "skey",
                    "budget",
                    F.col("e.bin").alias("prefix"),
                    (F.col("got") + F.when(F.col("e").isNull(), F.col("all")).otherwise(F.col("e.before"))).alias("got"),
                    F.when(F.col("e").isNull(), F.lit(1 << BITS)).when(one, F.col("e.lo")).alias("thr"),
                ),
                "mix-thresholds",
            )
        )
        state = found[-1].where("thr is null").select("skey", "budget", "prefix", "got")
        if not state.limit(1).count():
            break
    return read_all(found).where("thr is not null").select("skey", "thr", "got")


def _keyed(docs: DataFrame, seed: str, key: str, text: str, source: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    skey = F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))
    return [skey.alias("skey"), size.alias("size"), hash60(F.col(key), seed).alias("h")]


def plan_mix(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> tuple[DataFrame, Column]:
    """rows (skey, size, h) -> figures by source, to be joined to rows on skey, and the copies of a row by them."""
    plan = targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = keep(plan.select("skey", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("open"), F.array().cast("array<struct<most:double,thr:long>>").alias("budgets")), "mix-plan")
    n = plan.count()
    left = rows.where("size > 0").select("skey", "size", "h")
    while True:
        # Only rows that fit into what is open, and that no budget has taken, go on.
        fits = left.join(broadcast_below(plan.select("skey", "open", F.element_at("budgets", -1).alias("last")), n, BROADCAST_SOURCES), "skey")
        fits = fits.where(~F.coalesce((F.col("size") <= F.col("last.most")) & (F.col("h") < F.col("last.thr")), F.lit(False)))
        if n and plan.where(F.size("budgets") > 0).limit(1).count():
            left = keep(fits.where("size <= open").select("skey", "size", "h"), "mix-left")
            if not left.limit(1).count():
                break
        found = _thresholds(left, plan.select("skey", F.col("open").alias("budget")), n)
        first = F.size("budgets") == 0
        entry = F.struct(F.when(first, F.lit(float("inf"))).otherwise(F.col("open")).alias("most"), F.coalesce("thr", F.lit(0).cast("long")).alias("thr"))
        after = plan.join(found, "skey", "left").select("skey", "source_size", "target", "whole", (F.col("open") - F.coalesce("got", F.lit(0))).alias("open"), F.array_append("budgets", entry).alias("budgets"))
        plan = keep(after, "mix-plan")
        if not n or not left.limit(1).count():
            break
    chosen = F.exists("budgets", lambda b: (F.col("size") <= b["most"]) & (F.col("h") < b["thr"])) & (F.col("size") > 0)
    return broadcast_below(plan, n, BROADCAST_SOURCES), F.col("whole") + chosen.cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source)."""
    rows = keep(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), *_keyed(docs, seed, key, text, source)), "mix-rows")
    plan, copies = plan_mix(rows, weights, share, most)
    return rows.join(plan, "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), "source")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as the mix takes it."""
    keyed = docs.select(F.struct("*").alias("row"), *_keyed(docs, seed, key, text, source))
    plan, copies = plan_mix(keep(keyed.select("skey", "size", "h"), "mix-rows"), weights, share, most)
    taken = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int")
    return keyed.join(plan, "skey").select("row", F.explode(F.array_repeat(F.lit(0), taken))).select("row.*")
