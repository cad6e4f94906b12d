"""Operator 2, MinHash near-dedup: an LSH forest, confirmed on full shingle sets.

1. Texts of equal shingle sets form a class; everything below works on classes, so copies cost nothing more.
2. Each class has a MinHash signature of TREES x OWN values. Each tree is one sorted order of the classes by DEPTH
   values: its OWN ones first, then the next tree's. Candidates are neighbours in that order whose longest common prefix
   has LEAST_DEPTH values or more. A region (the classes of one such prefix) of up to NEIGHBOURS classes is compared
   whole; in a larger one each class is compared with its next one, whose prefix is as deep as the region is dense.
3. A sketch of SKETCH two-bit values and the set sizes drop candidates that cannot reach the similarity (sizes exactly;
   the sketch at five standard deviations). The rest are confirmed on the sets of the whole texts.
4. Regions that are larger, or that a border between range partitions cuts, and that still hold several components are
   closed exactly, all pairs of different components, whatever their number: the texts of a region meet in a task, where
   an index of each set's rarest shingles (those that two sets of the similarity can't both miss) with bounds by size and
   place finds the pairs to compare on full sets. Regions of more than BLOCK shingles are dealt as pairs of blocks. Only
   links that join components leave the task, so a region gives fewer rows than it has members. The first trees' regions
   go first: what they join needs no second look.
5. Links are closed to components.

Misses: a pair at the threshold similarity s shares no region with probability (1 - s**LEAST_DEPTH)**TREES (1e-10 at
0.85, 3e-8 at 0.8), or is in small regions only and the sketch drops it in all of them (below 4e-6 and 2e-6). Sets are
compared by 64-bit hashes of their shingles: two texts of n shingles have a false common one with probability n * n / 2**64.

Defined results: a document without words has an empty set and is linked with nothing; a null text likewise; with fewer
than k words the whole sequence is one shingle; repeated rows and equal sets share a component; a pair exactly at the
threshold is a link; null keys never are a component's smallest key and are not kept unless all of the component's keys
are null; an empty table gives an empty result; texts are taken whole, a text of more than BLOCK shingles is a block of
its own; other columns, whatever their names, are ignored, or kept by near_filter().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import broadcast_below, keep
from .textkernel import Texts, mix, pieces
from .workers import map_batches

TREES, OWN, DEPTH, LEAST_DEPTH, NEIGHBOURS = 24, 4, 8, 3, 8
SKETCH = 64
#: Shingles of a region that meet in one task (some 100 MB with the index); a larger region is dealt as pairs of such blocks.
BLOCK = 1 << 20
#: Trees (numbered from 1) whose regions are closed together; later ones find most components joined already.
CLOSED = ((1, 5), (6, TREES))
#: Candidate classes whose texts are found by a broadcast of their keys (some 16 MB); beyond, by a shuffle.
BROADCAST_CLASSES = 200_000
#: Keys of dropped or repeated documents, likewise (some 16 MB).
BROADCAST_KEYS = 1_000_000
_rng = np.random.default_rng(0xF0357)
_XOR = _rng.integers(0, 1 << 32, TREES * OWN, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, TREES * OWN, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _rng.integers(0, 1 << 31, TREES * OWN, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = _rng.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and each row's first place (and the end).

    texts must be lower-cased.
    """
    starts, ends, row = texts.words()
    word = texts.hashes(starts, ends)
    n_words = np.bincount(row, minlength=texts.n)
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    n = len(word) - k + 1
    if n > 0:
        at = np.flatnonzero(row[:n] == row[k - 1 :])
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = mix(h + word[at + j] * _ODD[j])
    else:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    extra = []
    for r in short:
        x = np.zeros(1, np.uint64)
        for j in range(n_words[r]):
            x = mix(x + word[first[r] + j] * _ODD[j])
        extra.append(mix(x + np.uint64(n_words[r])))
    if extra:
        of, h = np.concatenate([row[at], short]), np.concatenate([h, *extra])
    else:
        of = row[at]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    of, h = of[new], h[new]
    return h, np.searchsorted(of, np.arange(texts.n + 1))


def _digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sixteen bytes a row that depend on its set."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for c, salt in enumerate((1, 0x51ED27)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(salt) * _ODD[0]))])
        out[:, c] = total[first[1:]] - total[first[:-1]]
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)


_SIGNED = "doc_id long, print long, n_shingles long, cls binary, sig binary, sketch binary"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in pieces(batch.column(1), lower=True):
                h, first = shingle_sets(texts, k)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                sig = np.zeros((texts.n, TREES * OWN), np.uint32)
                sketch = np.zeros((texts.n, SKETCH // 4), np.uint8)
                if len(full):
                    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
                    for m in range(TREES * OWN):
                        sig[full, m] = np.minimum.reduceat((low ^ _XOR[m]) * _MUL[m] + high * _HIGH[m], first[full])
                    two = ((sig[:, :SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8).reshape(texts.n, -1, 4)
                    sketch = two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), _fixed(_bytes(_digests(h, first))), _fixed(_bytes(sig.astype(">u4"))), _fixed(sketch)], ["doc_id", "print", "n_shingles", "cls", "sig", "sketch"])

    return run


_FOUND = "kind string, a binary, b binary, n long"


def _least(threshold: int) -> int:
    """Equal sketch values that a pair at the threshold has at five standard deviations below the mean."""
    return int(SKETCH * (0.25 + 0.75 * threshold / 100) - 5 * (SKETCH * (0.25 + 0.75 * threshold / 100) * (0.75 - 0.75 * threshold / 100)) ** 0.5)


def _neighbours(threshold: int):
    """Sorted rows (tree, s, cls, n, sketch) -> candidates (kind p) and the members of regions to close (kind h).

    Of the latter, a is the region's key and b the class: regions of more than NEIGHBOURS classes, and the first and the
    last one of each partition, which may go on in another.
    """
    least = _least(threshold)
    ones = np.array([bin(x).count("1") for x in range(256)], np.uint8)

    def record(kind: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), _fixed(a), _fixed(b), pa.array(n)], ["kind", "a", "b", "n"])

    def pairs(key, cls, n, sketch, big):
        """Within a run of sorted rows: neighbours of the longest prefix, and in small regions all others."""
        size = len(key)
        for o in range(1, min(NEIGHBOURS, size - 1) + 1):
            i = np.flatnonzero((key[o:] == key[:-o]) & ~big[: size - o] if o > 1 else key[o:] == key[:-o])
            if not len(i):
                continue
            small, large = np.minimum(n[i], n[i + o]), np.maximum(n[i], n[i + o])
            i = i[small * 100 >= large * threshold]
            x = sketch[i] ^ sketch[i + o]
            same = SKETCH - ones[(x | x >> 1) & 0x55].sum(1, dtype=np.int64)
            i = i[same >= least]
            if len(i):
                u, v = np.ascontiguousarray(cls[i]), np.ascontiguousarray(cls[i + o])
                x, y = u.view(">u8"), v.view(">u8")
                less = ((x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1])))[:, None]
                yield record("p", np.where(less, u, v), np.where(less, v, u), n[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [_key(np.asarray(batch.column(0)), _matrix(batch.column(1), 4 * DEPTH)), _matrix(batch.column(2), 16), np.asarray(batch.column(3)), _matrix(batch.column(4), SKETCH // 4)]
            open_ = cols[0] == cols[0][0] if held is None else np.zeros(0, bool)
            # The last region may go on in the next batch: its last rows are seen again, which repeats a few pairs.
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            key, cls, n, sketch = cols
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(edge)
            big = np.repeat(sizes > NEIGHBOURS, sizes)
            yield from pairs(key, cls, n, sketch, big)
            if len(open_):
                big |= open_
            if big.any():
                yield record("h", _bytes(key[big]), cls[big], n[big])
            held = [c[-NEIGHBOURS:] for c in cols]
        if held is not None:
            key, cls, n, _ = held
            last = key == key[-1]
            yield record("h", _bytes(key[last]), cls[last], n[last])

    return run


def _closing(k: int, threshold: int):
    """Rows (region, lo, hi, i, root, cls, text), sorted by the first three -> links (a, b) that join different roots.

    Rows of one (region, lo, hi) are two blocks of a region, i = lo and i = hi, or one block where lo = hi.
    """

    def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, root = _matrix(rows.column(5).combine_chunks(), 16), _matrix(rows.column(4).combine_chunks(), 16)
        code = np.unique(np.ascontiguousarray(root).view("V16").ravel(), return_inverse=True)[1].ravel()
        side = np.asarray(rows.column(3)) if rows.column(1)[0].as_py() != rows.column(2)[0].as_py() else None
        sets, first = [], [np.zeros(1, np.int64)]
        for _, _, texts in pieces(rows.column(6), lower=True):
            h, at = shingle_sets(texts, k)
            first.append(at[1:] + first[-1][-1])
            sets.append(h)
        links = joining(np.concatenate(sets), np.concatenate(first), code, side, threshold)
        if links:
            u, v = np.array(links).T
            yield pa.RecordBatch.from_arrays([_fixed(cls[u]), _fixed(cls[v])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.stack([np.asarray(batch.column(c)) for c in (1, 2)], 1).astype(np.int32)
            key = np.concatenate([_matrix(batch.column(0), 1 + 4 * LEAST_DEPTH), _bytes(ends)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
            for x, y in zip(edge[:-1], edge[1:]):
                if held and key[x].tobytes() != own:
                    yield from group(pa.Table.from_batches(held))
                    held = []
                own = key[x].tobytes()
                held.append(batch.slice(x, y - x))
        if held:
            yield from group(pa.Table.from_batches(held))

    return run


def joining(sets: np.ndarray, first: np.ndarray, code: np.ndarray, side: np.ndarray | None, threshold: int) -> list[tuple[int, int]]:
    """Links between members of different components that connect all that links connect: exact, without all pairs.

    Member m has the shingles sets[first[m]:first[m + 1]] and the component code[m]; with sides, only pairs of different
    sides count. Two sets that reach the threshold share one of each one's rarest shingles, so many that what is left is
    too few; from the first one that they share, what follows must suffice for the overlap that the sizes ask for.
    """
    size = np.diff(first)
    member = np.repeat(np.arange(len(size)), size)
    _, token, seen = np.unique(sets, return_inverse=True, return_counts=True)
    order = np.lexsort((token, seen[token], member))
    place = np.arange(len(sets)) - first[:-1][member]
    need = -(-threshold * size // 100)
    rare = (place < (size - need + 1)[member]) & (seen[token[order]] > 1)
    post_token, post_member, post_rest = token[order][rare], member[rare], (size[member] - place)[rare]
    at_member = np.searchsorted(post_member, np.arange(len(size) + 1))  # a member's own postings, in order
    by_token = np.argsort(post_token, kind="stable")
    list_member, list_rest = post_member[by_token], post_rest[by_token]
    at_token = np.searchsorted(post_token[by_token], np.arange(len(seen) + 1))
    label = np.arange(int(code.max(initial=0)) + 1)
    largest = np.bincount(code).argmax()
    asked, links, mark = np.zeros(len(size), bool), [], np.zeros(len(seen), bool)
    for x in np.flatnonzero(code != largest):
        asked[x] = True
        own = slice(at_member[x], at_member[x + 1])
        begin, end = at_token[post_token[own]], at_token[post_token[own] + 1]
        count = end - begin
        if not count.sum() > len(count):  # only its own postings
            continue
        total = np.cumsum(count)
        at = np.repeat(begin - (total - count), count) + np.arange(total[-1])
        other = list_member[at]
        rest = np.minimum(list_rest[at], np.repeat(post_rest[own], count))
        good = (100 + threshold) * rest >= threshold * (size[x] + size[other])
        other = np.unique(other[good])
        other = other[~asked[other]]
        if side is not None:
            other = other[side[other] != side[x]]
        if not len(other):
            continue
        mark[token[first[x] : first[x + 1]]] = True
        while len(other := other[label[code[other]] != label[code[x]]]):
            some, other = other[:256], other[256:]
            width = size[some]
            start = np.cumsum(width) - width
            both = np.add.reduceat(mark[token[np.repeat(first[some] - start, width) + np.arange(width.sum())]].astype(np.int64), start)
            for y in some[100 * both >= threshold * (size[x] + width - both)].tolist():
                a, b = label[code[x]], label[code[y]]
                if a != b:
                    label[label == a] = b
                    links.append((x, y))
        mark[token[first[x] : first[x + 1]]] = False
    return links


def _key(tree: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A region's key: tree and the first LEAST_DEPTH values."""
    out = np.zeros((len(tree), 1 + 4 * LEAST_DEPTH), np.uint8)
    out[:, 0], out[:, 1:] = tree + 1, s[:, : 4 * LEAST_DEPTH]
    return out.view(f"V{out.shape[1]}").ravel()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    where, body = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1], column.buffers()[2]
    return np.frombuffer(body, np.uint8)[where[0] : where[-1]].reshape(len(column), width)


def _matching(k: int):
    """Rows (cls, text) whose text has that class: a key can stand for several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in pieces(batch.column(1), lower=True):
                got = _bytes(_digests(*shingle_sets(texts, k)))
                part = batch.slice(i, j - i)
                yield part.filter(pa.array((got == _matrix(part.column(0), 16)).all(1)))

    return run


def _confirm(k: int, threshold: int):
    """Rows (a, ta, b, tb) -> those of sufficient similarity, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a = batch.column(0)
            for i, j, texts in pieces(batch.column(3), lower=True):
                h, first = shingle_sets(texts, k)
                good = np.zeros(j - i, bool)
                for r in range(j - i):
                    key = a[i + r].as_py()
                    if key != last:
                        last = key
                        own, _ = next(((x, y) for _, _, t in pieces(batch.column(1).slice(i + r, 1), lower=True) for x, y in [shingle_sets(t, k)]))
                    other = h[first[r] : first[r + 1]]
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    good[r] = both > 0 and 100 * both >= threshold * (len(own) + len(other) - both)
                part = batch.slice(i, j - i).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], ["a", "b"])

    return run


def _texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, text) of the wanted classes, one row each."""
    keys = keep(wanted.join(reps, "cls").select("cls", "rep"), "near-wanted")
    n = keys.count()
    found = docs.join(broadcast_below(keys, n, BROADCAST_CLASSES), docs["doc_id"].eqNullSafe(keys["rep"])).select("cls", "text")
    found = map_batches(found, _matching(k), "cls binary, text string")
    return keep(found.groupBy("cls").agg(F.first("text").alias("text")), "near-texts")


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""
    texts = _texts_of(docs, reps, pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct(), k)
    right = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").select("a", "ta", "b", "tb")
    return keep(map_batches(both, _confirm(k, threshold), "a binary, b binary"), "near-links")


def _judged(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, print, n_shingles, root, component_id, n_links): a row per row.

    root is a component's own id; several components may have one smallest key if keys are not unique.
    """
    tasks = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = keep(map_batches(docs.select("doc_id", "text", _print("text").alias("print")), _sign(k), _SIGNED), "near-signed")
    full = signed.where("n_shingles > 0")
    reps = full.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    classes = full.groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    own, width = 4 * OWN, 4 * DEPTH
    longer = F.concat("sig", F.substring("sig", 1, width - own))  # after the last tree's values come the first one's
    trees = classes.select("cls", "n", "sketch", longer.alias("sig"), F.explode(F.array(*(F.lit(t) for t in range(TREES)))).alias("tree"))
    trees = trees.select("tree", F.substring("sig", F.col("tree") * own + 1, F.lit(width)).alias("s"), "cls", "n", "sketch")
    ordered = trees.repartitionByRange(tasks, "tree", "s", "cls").sortWithinPartitions("tree", "s", "cls")
    found = keep(map_batches(ordered, _neighbours(threshold), _FOUND), "near-found")
    pairs = keep(found.where("kind = 'p' and a != b").select("a", "b").distinct(), "near-pairs")
    links = _links(docs, reps, pairs, k, threshold)
    roots = components(links, "near-components")

    regions = keep(found.where("kind = 'h'").select(F.col("a").alias("region"), F.col("b").alias("cls"), "n").distinct(), "near-regions")
    for trees_of in CLOSED:
        new = _close(docs, reps, regions.where(F.conv(F.hex(F.substring("region", 1, 1)), 16, 10).cast("int").between(*trees_of)), roots, k, threshold, tasks)
        if new is not None:
            links = links.unionAll(new)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(new), "near-components")

    degree = links.select(F.col("a").alias("cls")).unionAll(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    tied = keep(reps.join(roots, reps["cls"] == roots["node"], "left").join(degree, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links")), "near-tied")
    smallest = tied.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = tied.where("n_links > 0").join(smallest, "root").select("cls", "root", "component_id", "n_links").unionAll(tied.where("n_links = 0").select("cls", "root", F.col("rep").alias("component_id"), "n_links"))
    narrow = signed.select("doc_id", "print", "n_shingles", "cls")
    out = narrow.where("n_shingles > 0").join(linked, "cls").select("doc_id", "print", "n_shingles", "root", "component_id", "n_links")
    return out.unionAll(narrow.where("n_shingles = 0").select("doc_id", "print", "n_shingles", F.col("cls").alias("root"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def _print(text: str) -> Column:
    """What tells the texts of one document key apart."""
    return F.xxhash64(F.col(text).cast("string"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept, n_links): documents linked at a Jaccard similarity of threshold per cent.

    n_links counts the confirmed links of the document's class, which include enough to connect its component.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _judged(docs, k, threshold).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links")


def _close(docs: DataFrame, reps: DataFrame, regions: DataFrame, roots: DataFrame, k: int, threshold: int, tasks: int) -> DataFrame | None:
    """The links that close all regions of several components; None if there is no such region."""
    members = regions.join(roots, F.col("cls") == F.col("node"), "left").select("region", "cls", "n", F.coalesce("root", "cls").alias("root"))
    members = keep(members, "near-members")
    mixed = members.groupBy("region").agg(F.sum("n").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    placed = members.join(mixed.select("region", F.expr(f"cast((size - 1) div {BLOCK} + 1 as int)").alias("blocks")), "region").withColumn("i", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    placed = keep(placed, "near-placed")
    if not placed.limit(1).count():
        return None
    texts = _texts_of(docs, reps, placed.select("cls").distinct(), k)
    dealt = placed.withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).select("region", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "root", "cls")
    whole = dealt.join(texts, "cls").select("region", "lo", "hi", "i", "root", "cls", "text").repartition(tasks, "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")
    links = keep(map_batches(whole, _closing(k, threshold), "a binary, b binary"), "near-closing")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_filter(docs: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component.

    It is the row of the component's smallest key; of its texts the one whose 64-bit print is smallest; of rows repeated
    with key and text one. Rows without words all stay.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    judged = keep(_judged(narrow, k, threshold).where("n_shingles > 0").select("doc_id", "print", "root", F.expr("doc_id <=> component_id").alias("first")), "near-judged")
    many = judged.where("first").groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("again_id"), F.min("print").alias("least"))
    many = keep(many.where("rows > 1").select("root", "again_id", "least"), "near-many")  # the first key's rows are repeated or near copies of each other
    late = judged.where("first").join(many, "root").where("print != least").select("doc_id", "print")
    gone = keep(judged.where("not first").select("doc_id", "print").unionAll(late).distinct(), "near-gone")
    again = keep(many.select("again_id", "least"), "near-again")
    id_, print_ = _free("gone_id", docs), _free("gone_print", docs)

    def matched(rows: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
        keys = broadcast_below(keys.toDF(id_, print_), n, BROADCAST_KEYS)
        return rows.join(keys, F.col(key).cast("long").eqNullSafe(F.col(id_)) & (_print(text) == F.col(print_)), how)

    left = matched(docs, gone, gone.count(), "left_anti")
    n = again.count()
    if not n:
        return left
    return matched(left, again, n, "left_anti").unionAll(matched(left, again, n, "left_semi").dropDuplicates([key, text]))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
