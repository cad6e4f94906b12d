"""Operator 10, sharding: two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash. Pass two shuffles each bucket by
Fisher-Yates (Spark's ``shuffle`` on the bucket's array) and writes its records; a record's global position is its
bucket's offset plus its place in the bucket. Shards are equal cuts of the positions: the law that holds is ``rows``
(shard counts differ by at most one).

Records move once. Rows that are repeated whole would all fall into one bucket; they are found by a narrow aggregate and
scattered by their row number as well, so that a third of all rows being one row fills no bucket beyond its size.

Defined results: a null text counts as empty; null keys are a key like any other; repeated rows are rows of their own,
and which of them stands where is the same (only with repeated rows do places depend on how the input is cut into
partitions); ties of the hash are broken by the record itself; an empty table gives an empty result; all columns travel,
whatever their names, maps included; a text of any length is one record, and a bucket holds one at least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .store import broadcast_below, keep

#: Buckets hold about so many rows and bytes of text.
BUCKET_ROWS = 4096
BUCKET_BYTES = 16 << 20
#: Buckets per group in the two-level sum of offsets: one task adds up groups, n / (4096 * 4096) of them.
GROUP = 4096
#: Repeated keys and buckets that are broadcast (some 30 MB); beyond, these joins are shuffled.
BROADCAST_KEYS, BROADCAST_BUCKETS = 1_000_000, 1_000_000
_KEYS = ("doc_id", "size", "text_crc32")


def _flat(column: Column, kind) -> Column:
    """Maps as arrays of entries, which have an order."""
    return F.map_entries(column) if isinstance(kind, MapType) else column


def _back(column: Column, kind) -> Column:
    return F.map_from_entries(column) if isinstance(kind, MapType) else column


def _narrow(key: Column, text: Column) -> list[Column]:
    body = F.coalesce(text.cast("string"), F.lit(""))
    return [key.cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")]


def scatter(docs: DataFrame, seed: int = 20240607, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """All records, shuffled and written: (bucket, place, rec), rec a struct of all columns; and their number."""
    spark, fields = docs.sparkSession, docs.schema.fields
    counted = docs.select(*_narrow(F.col(key), F.col(text))).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    counted = keep(counted, "shuffle-keys")
    total, volume = counted.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    many = counted.where("n > 1").select(*(F.col(c).alias(f"many_{c}") for c in _KEYS))
    repeated = many.count()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / BUCKET_ROWS), math.ceil((volume or 0) / BUCKET_BYTES))

    records = docs.select(F.struct(*(_flat(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)).alias("rec"))
    records = records.select("rec", *_narrow(F.col(f"rec.`{key}`"), F.col(f"rec.`{text}`")), F.lit(0).cast("long").alias("salt"))
    if repeated:
        same = F.col("doc_id").eqNullSafe(F.col("many_doc_id")) & (F.col("size") == F.col("many_size")) & (F.col("text_crc32") == F.col("many_text_crc32"))
        marked = records.withColumn("salt", F.monotonically_increasing_id()).join(broadcast_below(many, repeated, BROADCAST_KEYS), same, "left")
        records = marked.select("rec", *_KEYS, F.when(F.col("many_size").isNotNull(), F.col("salt") + 1).otherwise(F.lit(0)).alias("salt"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *_KEYS, "salt"), F.lit(buckets).cast("long")).cast("int")
    record = F.struct(F.xxhash64(F.lit(seed + 1), *_KEYS, "salt").alias("h"), "salt", "rec")
    dealt = records.select(bucket.alias("bucket"), record.alias("r")).repartition(buckets, "bucket")
    shuffled = dealt.groupBy("bucket").agg(F.shuffle(F.sort_array(F.collect_list("r")), seed).alias("recs"))
    return keep(shuffled.select("bucket", F.posexplode("recs").alias("place", "r")).select("bucket", "place", "r.rec"), "shuffle-records"), total or 0


def placed(records: DataFrame, total: int, shards: int) -> DataFrame:
    """(rec, shard, slot) of what scatter() gives: positions are cut into equal shards."""
    sizes = records.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.expr(f"bucket div {GROUP}"))
    groups = sizes.groupBy("grp").agg(F.sum("n").alias("n"))
    groups = groups.select("grp", F.coalesce(F.sum("n").over(W.partitionBy().orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("grp_offset"))
    within = W.partitionBy("grp").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "grp", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("in_grp")).join(groups, "grp").select("bucket", (F.col("grp_offset") + F.col("in_grp")).alias("offset"))
    p = F.col("offset") + F.col("place")
    out = records.join(broadcast_below(offsets, math.ceil(total / BUCKET_ROWS), BROADCAST_BUCKETS), "bucket").select("rec", p.alias("p"))
    out = out.withColumn("shard", F.expr(f"cast(p * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return out.select("rec", "shard", (F.col("p") - first).cast("long").alias("slot"))


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 20240607, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), read from the shuffled records; slots are gapless from 0 in each shard."""
    records, total = scatter(docs, seed, key, text)
    out = placed(records, total, shards)
    return out.select(*_narrow(F.col(f"rec.`{key}`"), F.col(f"rec.`{text}`")), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 20240607, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole records as Parquet folders shard=0..; each in slot order. Returns the table: rec, slot, shard."""
    records, total = scatter(docs, seed, key, text)
    rec = F.struct(*(_back(F.col(f"rec.`{f.name}`"), f.dataType).alias(f.name) for f in docs.schema.fields))
    out = placed(records, total, shards).select(rec.alias("rec"), "slot", "shard")
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
