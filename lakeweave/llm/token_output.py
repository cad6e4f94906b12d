"""Operator 5, token-ID output: training-order materialisation.

Texts become token ids, ids are cut into sequences of STRIDE ids, and a keyed Feistel permutation with cycle-walking
gives every sequence a global slot. Slot s is record s mod RECORDS of shard s div RECORDS; records have a fixed length,
so a reader seeks to any slot and resumes from a slot number alone.

Sequences are numbered by document key and text, so slots depend on neither partitions nor file layout: rows are dealt
by ranges of that order, each range is tokenised and numbered alone, and one number a range reaches the driver. Equal
rows may lie in several ranges, as it is the same which of them is which. Slots then go to range partitions of shards.

With a tokenizer (rank file and split pattern of the byte-level BPE codec, as production has) ids are little-endian
unsigned 16-bit numbers; without one they are the bytes of the text. Two ids that neither uses end a text and pad a
sequence.

Defined results: a null or empty text is one sequence with the end mark only; repeated rows are sequences of their own;
null keys come first in the numbering; rows of one key are numbered by a hash of their texts; an empty table gives no
sequences; other columns, whatever their names, are ignored; long texts become many sequences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .store import keep, release
from .textkernel import mix, pieces
from .workers import map_batches

STRIDE, RECORDS, SEED, ROUNDS = 1024, 8192, 20240607, 6
#: Ids of the byte tokenizer that no UTF-8 text holds.
END, PAD = 255, 254
#: Those of 16-bit ids; a larger vocabulary is refused.
END_ID, PAD_ID = 65535, 65534
_SCHEMA = "slot long, shard int, record int, doc_id long, seq_no long, n_tokens int, ids binary"


class Permutation:
    """A keyed bijection of 0..n-1: Feistel rounds on (x div b, x mod b), walked until the value is below n."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n, self.rounds = n, rounds
        self.a = max(1, int(np.ceil(np.sqrt(n))))
        self.b = max(1, -(-n // self.a))
        self.keys = mix(np.arange(1, 2 * rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _rounds(self, x: np.ndarray, forth: bool) -> np.ndarray:
        a, b = np.uint64(self.a), np.uint64(self.b)
        left, right = x // b, x % b
        for i in range(self.rounds) if forth else reversed(range(self.rounds)):
            if forth:
                left = (left + mix(right + self.keys[2 * i]) % a) % a
                right = (right + mix(left + self.keys[2 * i + 1]) % b) % b
            else:
                right = (right + b - mix(left + self.keys[2 * i + 1]) % b) % b
                left = (left + a - mix(right + self.keys[2 * i]) % a) % a
        return left * b + right

    def __call__(self, x: np.ndarray, forth: bool = True) -> np.ndarray:
        out = self._rounds(np.asarray(x).astype(np.uint64), forth)
        while (over := np.flatnonzero(out >= self.n)).size:
            out[over] = self._rounds(out[over], forth)
        return out.astype(np.int64)

    def inverse(self, slot: np.ndarray) -> np.ndarray:
        return self(slot, False)


def _numbered(stride: int, tokenizer: tuple[str, str] | None):
    """Sorted rows (doc_id, text) -> (pid, start, n, doc_id, ids): sequences are counted within the partition."""
    width = 2 if tokenizer else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pid, start = bpe.codec(*tokenizer) if tokenizer else None, TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, texts in pieces(batch.column(1), bpe.RUN):
                ids, first = coder.encode(texts) if coder else (texts.data, texts.offsets)
                if coder and len(ids) and int(ids.max()) >= PAD_ID:
                    raise ValueError(f"token id {int(ids.max())} does not fit below {PAD_ID}")
                body = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((width * first).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u2") if coder else ids))])
                n = np.diff(first) // stride + 1
                ends = start + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, pid, np.int32)), pa.array(ends - n), pa.array(n), batch.column(0).slice(i, j - i), body], ["pid", "start", "n", "doc_id", "ids"])
                start = int(ends[-1])

    return run


def _sequences(offsets: dict[int, int], total: int, stride: int, records: int, seed: int, width: int):
    """Rows of _numbered() -> sequences with their slots."""
    end, pad, kind = (END, PAD, np.dtype(np.uint8)) if width == 1 else (END_ID, PAD_ID, np.dtype("<u2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(total, seed)
        for batch in batches:
            for i, j, texts in pieces(batch.column(4), 1 << 21):
                ids, first = np.ascontiguousarray(texts.data).view(kind), texts.offsets // width
                length, count = np.diff(first) + 1, np.asarray(batch.column(2))[i:j]
                at = np.cumsum(count) - count
                row = np.repeat(np.arange(texts.n), count)
                flat = np.full(int(count.sum()) * stride, pad, kind)
                flat[np.arange(len(ids)) + np.repeat(at * stride - first[:-1], np.diff(first))] = ids
                flat[at * stride + length - 1] = end
                seq = np.arange(len(row)) - at[row]
                used = np.minimum(length[row] - seq * stride, stride).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, (len(row) + 1) * stride * width, stride * width, dtype=np.int32)), pa.py_buffer(flat)])
                doc = batch.column(3).slice(i, j - i).take(pa.array(row))
                before = np.array([offsets[x] for x in np.asarray(batch.column(0))[i:j].tolist()], np.int64) + np.asarray(batch.column(1))[i:j]
                slot = permute(before[row] + seq)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // records).astype(np.int32)), pa.array((slot % records).astype(np.int32)), doc, pa.array(seq), pa.array(used), body], ["slot", "shard", "record", "doc_id", "seq_no", "n_tokens", "ids"])

    return run


def training_order(docs: DataFrame, stride: int = STRIDE, records: int = RECORDS, seed: int = SEED, key: str = "doc_id", text: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Rows (slot, shard, record, doc_id, seq_no, n_tokens, ids) in range partitions of shards, sorted by slot; a shard is in one partition."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "k1", "k2", "copy"]
    named = named.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), F.monotonically_increasing_id().alias("copy"))
    dealt = named.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    numbered = keep(map_batches(dealt, _numbered(stride, tokenizer), "pid int, start long, n long, doc_id long, ids binary"), "slots-numbered")
    del dealt
    release(docs.sparkSession)
    offsets, total = {}, 0
    for pid, n in sorted(numbered.groupBy("pid").agg(F.sum("n")).collect()):  # a row a partition
        offsets[pid], total = total, total + n
    cut = map_batches(numbered, _sequences(offsets, max(total, 1), stride, records, seed, 2 if tokenizer else 1), _SCHEMA)
    shards = max(1, -(-total // records))
    parts = min(tasks, shards)
    return cut.repartitionById(parts, F.expr(f"cast(cast(shard as long) * {parts} div {shards} as int)")).sortWithinPartitions("shard", "slot")


def write_shards(sequences: DataFrame, path: str, stride: int = STRIDE, records: int = RECORDS, width: int = 1, seed: int = SEED) -> dict:
    """Write shard folders shard=0, shard=1, ... of one file each: records of `stride` ids and a line feed, in slot order.

    Record r of a shard begins at byte r * (stride * width + 1), with width bytes an id. Spark's writer commits the
    files, so tasks may be repeated. The manifest (a JSON file beside the shards, written last) has the sizes and the
    number of records by shard; it is returned. Files' lengths say how many records there are: one number a shard reaches the driver.
    """
    sequences.select(F.col("ids").cast("string").alias("value"), "shard").write.partitionBy("shard").text(path)
    spark = sequences.sparkSession
    lengths = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("shard", (F.col("length") / F.lit(stride * width + 1)).cast("long").alias("n"))
    counts = lengths.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    manifest = {"stride": stride, "records": records, "width": width, "seed": seed, "slots": sum(r.n for r in counts), "shards": {str(r.shard): r.n for r in counts}}
    store, where = _store(spark, f"{path}/_manifest.json")
    out = store.create(where, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class ShardReader:
    """Sequences by slot from what write_shards() wrote, in any store that Spark reads: it seeks, and reads in runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        store, where = _store(spark, f"{self.path}/_manifest.json")
        stream = store.open(where)
        self.manifest = json.loads(bytes(stream.readAllBytes()))
        stream.close()

    def _file(self, shard: int):
        store, folder = _store(self.spark, f"{self.path}/shard={shard}")
        return store, next(f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))

    def read(self, slot: int = 0, run: int = 256) -> Iterator[tuple[int, bytes]]:
        """(slot, ids without padding) from a slot on, to the last one: to resume, ask for the first slot not yet seen."""
        m = self.manifest
        size, pad = m["stride"] * m["width"] + 1, (PAD if m["width"] == 1 else PAD_ID).to_bytes(m["width"], "little")
        while slot < m["slots"]:
            shard, record = divmod(slot, m["records"])
            store, where = self._file(shard)
            stream = store.open(where)
            stream.seek(record * size)
            while record < m["shards"][str(shard)]:
                data = bytes(stream.readNBytes(size * min(run, m["shards"][str(shard)] - record)))
                for at in range(0, len(data), size):
                    used = size - 1
                    while used and data[at + used - m["width"] : at + used] == pad:
                        used -= m["width"]
                    yield slot, data[at : at + used]
                    slot, record = slot + 1, record + 1
            stream.close()
