"""Whole Arrow batches of texts as flat arrays: bytes, words and their hashes, for the operators that work in NumPy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

np.seterr(over="ignore")
_C1, _C2, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5EEDF00DC0FFEE11)
#: Masks that keep the first 0 to 8 bytes of a little-endian number, and the bytes of a slice that are hashed in steps of 8.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEPS = 32
#: ASCII space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


class Texts:
    """Rows of a text column as one byte array with offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._loads = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every word, in order."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~SPACE[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def _eight(self) -> np.ndarray:
        """The eight bytes from every place on, as one number; zeros follow the last byte."""
        if self._loads is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._loads = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        return self._loads

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice: every eight bytes are mixed in, so equal hashes of different slices are chance (2**-64)."""
        eight, size = self._eight(), ends - starts
        out = mix(size.astype(np.uint64) * _C2 + _SEED)
        at = np.arange(len(starts))
        for step in range(_STEPS):
            rest = size[at] - 8 * step
            at = at[rest > 0]
            if not len(at):
                return out
            part = eight[starts[at] + 8 * step] & _MASK[np.minimum(size[at] - 8 * step, 8)]
            out[at] = mix((out[at] ^ part) * _C1 + _SEED)
        for i in at[size[at] > 8 * _STEPS]:
            body = self.data[starts[i] + 8 * _STEPS : ends[i]]
            out[i] ^= np.frombuffer(hashlib.blake2b(body, digest_size=8).digest(), "<u8")[0]
        return out

    def same(self, starts: np.ndarray, ends: np.ndarray, other: "Texts", firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """Whether each slice has the bytes of the other texts' slice."""
        size = ends - starts
        out = size == lasts - firsts
        one, two = self._eight(), other._eight()
        at, step = np.flatnonzero(out & (size > 0)), 0
        while len(at) and step < _STEPS:
            differs = (one[starts[at] + 8 * step] ^ two[firsts[at] + 8 * step]) & _MASK[np.minimum(size[at] - 8 * step, 8)]
            out[at[differs != 0]] = False
            step += 1
            at = at[(differs == 0) & (size[at] > 8 * step)]
        for i in at:
            out[i] = np.array_equal(self.data[starts[i] : ends[i]], other.data[firsts[i] : lasts[i]])
        return out

    def numbers(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each slice; equal numbers exactly where the bytes are equal."""
        order = np.argsort(hashes := self.hashes(starts, ends), kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        twin = np.flatnonzero(~new)
        a, b = order[twin], order[twin - 1]
        if not self.same(starts[a], ends[a], self, starts[b], ends[b]).all():  # different slices of one hash
            known: dict[bytes, int] = {}
            return np.array([known.setdefault(self.data[x:y].tobytes(), len(known)) for x, y in zip(starts, ends)], np.int64)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def pieces(column: pa.Array, limit: int = 1 << 20, lower: bool = False) -> Iterator[tuple[int, int, Texts]]:
    """The column in runs of rows of about `limit` bytes: first row, row after the last, Texts. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, body = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        part = data[offsets[i] : offsets[j]]
        yield i, j, Texts(LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])
        i = j
