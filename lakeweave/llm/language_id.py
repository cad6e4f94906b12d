"""Operator 7, language ID: hyperdimensional profiles.

Each letter (code point, lower-cased) has a random vector of +1 and -1, made from a hash of its number. An n-gram's
vector binds its letters' vectors, each rotated by its place; a text's vector bundles (adds) those of its n-grams; a
language's prototype bundles those of its training texts. The language is the prototype of the largest cosine, the score
that cosine, cut to 0..1.

Learning takes all rows with a language whose crc32(key as text) mod 4 is not 2; prototypes are summed on the
executors, and only languages x DIMENSIONS numbers reach the driver.

Defined results: 'und' with score 0 for a text that is null or has no letter, and for every text if nothing was
learned; a text with letters but without an n-gram (three characters around a letter) scores 0 for all; of equal cosines
the language first in code-point order wins; repeated rows are judged alike; an empty table gives an empty result; other
columns, whatever their names, are ignored, or kept by language_filter(). Long texts are taken whole. Memory is bounded
by the run of texts (256 KB or one text) and CELLS counts at a time, however short or many the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Texts, mix, pieces
from .workers import map_batches, on_release

DIMENSIONS = 1024
#: A document is rejected by the filter if its best cosine is below this: held-out documents of check_s score 0.196 at
#: the least, 150 words of random letters 0.16 at the most, an unlearned language (Finnish) 0.13.
LEAST_SCORE = 0.18
#: Counts (texts x n-grams) that are multiplied at once: some 16 MB.
CELLS = 1 << 22
_made: dict[str, np.ndarray] = {}
on_release(__name__, _made.clear)


def _lower() -> np.ndarray:
    """The lower-case letter of every code point; 0 for what is no letter."""
    if "lower" not in _made:
        out = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                out[c] = ord(chr(c).lower()[0])
        _made["lower"] = out
    return _made["lower"]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0, which parts words, is a letter like any other here."""
    words = DIMENSIONS // 64
    seeds = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(seeds + np.uint64(0x1A9C0DE5EED))).view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def vectors(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundled vector, and whether it has a letter."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=lead[1:])
    if lead[-1] != len(points):  # not UTF-8: row by row
        parts = [texts.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    else:
        at = lead[texts.offsets]
    row = np.repeat(np.arange(texts.n), np.diff(at))
    letter = _lower()[points]
    has = np.bincount(row[letter > 0], minlength=texts.n) > 0
    out = np.zeros((texts.n, DIMENSIONS), np.float32)
    if len(letter) < 3:
        return out, has
    seen = np.zeros(0x110000, bool)
    seen[letter] = True
    alphabet = np.flatnonzero(seen)
    s, size = (np.cumsum(seen) - 1)[letter], len(alphabet)
    good = (letter[1:-1] > 0) & (row[:-2] == row[2:])
    code, of = ((s[:-2] * size + s[1:-1]) * size + s[2:])[good], row[:-2][good]
    if size**3 <= CELLS:
        there = np.zeros(size**3, bool)
        there[code] = True
        grams, place = np.flatnonzero(there), (np.cumsum(there) - 1)[code]
    else:
        grams, place = np.unique(code, return_inverse=True)
    v = letter_vectors(alphabet)
    two, one = np.roll(v, 2, 1), np.roll(v, 1, 1)
    per_row, step = np.searchsorted(of, np.arange(texts.n + 1)), 4096
    for low in range(0, len(grams), step):  # some n-grams at a time, some texts at a time
        g = grams[low : low + step]
        bound = (two[g // size**2] * one[g // size % size] * v[g % size]).astype(np.float32)
        mine = (place >= low) & (place < low + step)
        for first in range(0, texts.n, CELLS // step):
            last = min(first + CELLS // step, texts.n)
            part = slice(per_row[first], per_row[last])
            pick = mine[part]
            if pick.any():
                cells = (of[part][pick] - first) * len(g) + place[part][pick] - low
                out[first:last] += np.bincount(cells, minlength=(last - first) * len(g)).reshape(last - first, len(g)).astype(np.float32) @ bound
    return out, has


def held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for i, j, texts in pieces(batch.column(1), 1 << 18):
            v, _ = vectors(texts)
            langs = np.array(batch.column(0).slice(i, j - i).to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + v[langs == lang].astype(np.int64).sum(0)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], ["lang", "place", "value"])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language, in code-point order of the languages."""
    training = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = map_batches(training, _bundles, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for name, place, value in sums.collect():  # languages x DIMENSIONS rows
        out.setdefault(name, np.zeros(DIMENSIONS))[place] = value
    return {k: out[k] for k in sorted(out) if out[k].any()}


class Judge:
    """Predicts from prototypes; it travels to the executors."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = list(prototypes)
        m = np.array([prototypes[k] for k in self.names]).reshape(len(self.names), DIMENSIONS)
        self.matrix = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: und) and score."""
        v, has = vectors(texts)
        if not self.names:
            return np.full(texts.n, -1), np.zeros(texts.n)
        cosine = (v @ self.matrix.T).astype(float) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        best = cosine.argmax(1)
        return np.where(has, best, -1), np.where(has, np.clip(cosine[np.arange(texts.n), best], 0, 1), 0.0)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score)."""
    judge = Judge(learn(docs, key, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*judge.names, "und"], object)
        for batch in batches:
            for i, j, texts in pieces(batch.column(2), 1 << 18):
                best, score = judge(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text")), run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_filter(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language with at least that score."""
    from .rowfilter import keep_rows

    judge = Judge(learn(docs, key, text, lang))

    def good(texts: Texts) -> np.ndarray:
        best, score = judge(texts)
        return (best >= 0) & (score >= least)

    return keep_rows(docs, text, good)
