"""Operator 4, approximate nearest neighbours: a permutation index.

A bounded sample of vectors is drawn by hash, and PIVOTS of them, apart from each other, are the pivots. Every vector is
represented by the order of its POSTED nearest pivots, a quarter of all, and posted, with its place in that order, in the
inverted files of these pivots. The index is built and written once: rows are dealt to blocks by a hash of their id, so
that it depends on neither partitions nor file layout, and each block has its own inverted files. A query reads the
files of its own POSTED pivots, adds up how far the places differ (Spearman's footrule, cut at POSTED), the RERANK
fraction of the block with the smallest sums is reranked by the exact distance, and the best are merged. That holds at
every size: no block is searched whole.

Queries go to the blocks in groups of about QUERY_BLOCK, one after another: the driver holds one group, each group's
answers are written, nothing of the index is moved. Within a block equal vectors are one entry, so copies neither crowd
out others nor cost more.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, vectors of another length
than most, and rows without an id take no part; rows with the query's id are the query's own; rows that repeat an id
count once, at their smallest distance; ties go to the smaller id; fewer candidates than asked for are all returned;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .store import keep, read_all
from .workers import map_batches

#: Sampled rows, pivots, pivots posted per vector, and fraction of a block's entries that are reranked.
SAMPLE, PIVOTS, POSTED, RERANK = 1024, 256, 64, 0.2
#: Reranked as well: all entries whose footrule is below CLOSE times the block's FAR quantile, so that a crowd of near
#: equal vectors is told apart by distance. Sampled vectors within APART of the median distance share one pivot.
CLOSE, FAR, APART = 0.45, 0.9, 0.6
#: Queries that travel to the executors at once, and rows of a block (65,536 at most).
QUERY_BLOCK, BLOCK = 2048, 8192
_OUT = "query_id long, vec_id long, score double"


def valid_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, v as array<double> of the most frequent length."""
    v = F.col(vector).cast("array<double>")
    t = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    t = t.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    length = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return t.where(F.size("v") == (length[0]["n"] if length else 0))


def _spread_out(sample: np.ndarray) -> np.ndarray:
    """Pivots from the sample, in its order, none close to an earlier one (unless too few are left)."""
    if len(sample) < 2:
        return sample
    square = (sample**2).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] + square - 2 * sample @ sample.T, 0))
    limit, chosen, others = APART * np.median(apart), [0], []
    for i in range(1, len(sample)):
        (chosen if apart[i, chosen].min() > limit else others).append(i)
    return sample[(chosen + others)[:PIVOTS]]


def _orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivots, nearest first."""
    near = (pivots**2).sum(1) - 2 * x @ pivots.T
    m = min(POSTED, len(pivots))
    return np.argsort(near, axis=1, kind="stable")[:, :m]


class Block:
    """The inverted files of some rows."""

    COLUMNS = {"ids": np.int64, "of": np.int32, "x": np.float64, "file_at": np.int32, "entry": np.uint16, "place": np.uint8}

    def __init__(self, width: int, **columns: np.ndarray):
        """x: an entry per distinct vector; ids and of: rows and their entries; file_at, entry, place: the inverted files."""
        self.width, self.ids, self.of, self.file_at = width, columns["ids"], columns["of"].astype(np.int64), columns["file_at"]
        self.x, self.entry, self.place = columns["x"].reshape(-1, width), columns["entry"].astype(np.int64), columns["place"].astype(np.int64)
        self.first = np.searchsorted(self.of, np.arange(len(self.x) + 1))
        self.m = len(self.entry) // max(len(self.x), 1)
        self.unique = len(np.unique(self.ids)) == len(self.ids)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> "Block":
        entry, first, which = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, which))
        again = np.concatenate([[False], (ids[order[1:]] == ids[order[:-1]]) & (which[order[1:]] == which[order[:-1]])])
        order = order[~again]  # a row that is repeated counts once
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        held = order[place <= k]  # of equal vectors no more than k + 1 can be in an answer
        perm = _orders(x[first], pivots)
        flat, m = perm.ravel(), perm.shape[1]
        by = np.argsort(flat, kind="stable")
        return cls(x.shape[1], ids=ids[held], of=which[held], x=x[first].ravel(), file_at=np.searchsorted(flat[by], np.arange(len(pivots) + 1)), entry=by // m, place=by % m)

    def columns(self) -> dict[str, bytes]:
        return {c: np.ascontiguousarray(getattr(self, c)).astype(t).tobytes() for c, t in self.COLUMNS.items()}

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Up to a constant of the query: for each entry, how far its places differ from the query's."""
        total = np.zeros(len(self.x), np.int64)
        for at, pivot in enumerate(order):
            a, b = self.file_at[pivot], self.file_at[pivot + 1]
            # Both places known: their difference instead of the two distances to the cut.
            place = self.place[a:b]
            total[self.entry[a:b]] += np.abs(place - at) - (self.m - place) - (self.m - at)
        return total

    def search(self, query: np.ndarray, own: int, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        c = min(n, max(k + 1, int(np.ceil(RERANK * n))))
        near = np.arange(n)
        if c < n:
            rule = self.footrule(order) + self.m * (self.m + 1)
            high = int(FAR * n)
            part = np.partition(rule, [c - 1, high])
            near = np.flatnonzero(rule <= max(part[c - 1], CLOSE * part[high]))
        score = np.sqrt(((self.x[near] - query) ** 2).sum(1))
        if self.unique and len(near) > 2 * k + 2:
            cut = np.partition(score, k + 1)[k + 1]  # one more than k, as one entry may be the query's own
            near, score = near[score <= cut], score[score <= cut]
        count = self.first[near + 1] - self.first[near]
        at = np.repeat(self.first[near] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids, score = self.ids[at], np.repeat(score, count)
        other = ids != own
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, score))
        if not self.unique:  # an id with several vectors counts once, at the nearest
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
        return ids[best[:k]], score[best[:k]]


_INDEX = "block int, width int, " + ", ".join(f"{c} binary" for c in Block.COLUMNS)


def _build(pivots: np.ndarray, k: int):
    """Rows (block, vec_id, v), sorted by block -> an index row per block."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = np.asarray(rows.column(1))
        x = np.asarray(rows.column(2).combine_chunks().flatten()).reshape(len(ids), -1)
        row = {"block": np.int32(rows.column(0)[0].as_py()), "width": np.int32(x.shape[1])} | Block.build(ids, x, pivots, k).columns()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if c in ("block", "width") else pa.binary()) for c, v in row.items()], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = np.asarray(batch.column(0))
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
            for x, y in zip(edge[:-1], edge[1:]):
                if held and held[0].column(0)[0].as_py() != block[x]:
                    yield made(held)
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield made(held)

    return run


def _search(pivots: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(queries, pivots)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        for batch in batches:
            for r in range(len(batch)):
                block = Block(batch.column(1)[r].as_py(), **{c: np.frombuffer(batch.column(2 + i)[r].as_buffer(), t) for i, (c, t) in enumerate(Block.COLUMNS.items())})
                for q in range(len(own)):
                    i, s = block.search(queries[q], own[q], orders[q], k)
                    i, s = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], s])
                    o = np.lexsort((i, s))
                    _, firsts = np.unique(i[o], return_index=True)
                    o = o[np.sort(firsts)][:k]
                    best[q] = (i[o], s[o])
        count = np.array([len(i) for i, _ in best])
        if count.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, count)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"])

    return run


def build_index(valid: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, int]:
    """The written index of (vec_id, v) rows, its pivots, and the rows' number."""
    n = valid.count()
    sample = valid.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()
    pivots = _spread_out(np.array([r[0] for r in sample], float))
    blocks = max(1, -(-n // BLOCK))
    dealt = valid.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")).cast("int").alias("block"), "vec_id", "v")
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "vec_id", "v")
    return keep(map_batches(dealt, _build(pivots, k), _INDEX), "ann-index"), pivots, n


def nearest(table: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by `every`."""
    spark = table.sparkSession
    valid = keep(valid_vectors(table, key, vector), "ann-vectors")
    index, pivots, n = build_index(valid, k)
    queries = valid.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    groups = -(-queries.count() // QUERY_BLOCK) if n else 0
    found = []
    if groups:
        queries = keep(queries.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "ann-queries")
    for g in range(groups):
        rows = queries.where(F.col("grp") == g).collect()  # about QUERY_BLOCK rows
        own, x = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)
        if len(own):
            found.append(keep(map_batches(index, _search(pivots, own, x, k), _OUT), "ann-found"))
    out = read_all(found) if found else spark.createDataFrame([], _OUT)
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
