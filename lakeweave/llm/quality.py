"""Operator 8, quality rules: suffix arrays over the words of each text.

A suffix array is built by prefix doubling on all texts of a run at once (words of different texts never match); its
longest-common-prefix intervals give the maximal repeated substrings. Their spans are united, and the covered fraction
and the longest repeat are limited.

Defined results: a null or empty text has no words, fails the base rule (fewer than 20 words) and is not kept; repeated
rows are judged alike, each by itself; an empty table gives an empty result; other columns are ignored, or kept by
quality_filter(); texts are taken whole, and a text's arrays are what bounds memory (some 200 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import SPACE, Texts, pieces
from .workers import map_batches

#: Base rules: least words; most words, in per cent, in WINDOW-word windows that occur twice or more.
LEAST_WORDS, WINDOW, BASE_PERCENT = 20, 8, 30
#: The method's: repeats count from so many words; most covered words in per cent; longest repeat in words and per cent.
LEAST_REPEAT, COVERED_PERCENT, LONGEST_WORDS, LONGEST_PERCENT = 5, 35, 40, 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ranks of all suffixes, the ranks by the first 2**k symbols for each k, and the positions still tied at each k.

    The last symbol of each text must be unique. Only tied positions are sorted again.
    """
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    rank = starts[inverse]
    tied = np.flatnonzero(counts[inverse] > 1)
    levels, ties, k = [rank.astype(np.int32)], [tied], 1
    while len(tied):
        first, second = rank[tied], rank[tied + k]
        order = np.lexsort((second, first))
        tied, first, second = tied[order], first[order], second[order]
        n = len(tied)
        new_group = np.ones(n, bool)
        new_group[1:] = first[1:] != first[:-1]
        new_run = new_group.copy()
        new_run[1:] |= second[1:] != second[:-1]
        at = np.arange(n)
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        run_at = np.maximum.accumulate(np.where(new_run, at, 0))
        rank = rank.copy()
        rank[tied] = first + run_at - group_at
        last = np.ones(n, bool)
        last[:-1] = new_run[1:]
        tied = np.sort(tied[~(new_run & last)])
        k *= 2
        levels.append(rank.astype(np.int32))
        ties.append(tied)
    return rank, levels, ties


def longest_matches(rank: np.ndarray, levels: list[np.ndarray], tied: np.ndarray) -> np.ndarray:
    """For each tied position: the longest common prefix of its suffix with any other, from its neighbours in order."""
    at = tied[np.argsort(rank[tied])]  # the part of the suffix array that repeats
    out = np.zeros(len(rank), np.int64)
    if len(at) < 2:
        return out
    a, b = at[:-1], at[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + lcp, len(rank) - 1), np.minimum(b + lcp, len(rank) - 1)
        lcp += np.where(levels[k][x] == levels[k][y], 1 << k, 0) * (x != y)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n positions that a span covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def repeats(texts: Texts):
    """Words' rows, each word's longest repeat from there on, flags by window and by repeat, all in word order."""
    starts, ends, row = texts.words()
    n_words = np.bincount(row, minlength=texts.n)
    total = len(row)
    number = texts.numbers(starts, ends)
    place = np.arange(total) + row  # each text ends with a symbol of its own
    symbols = np.empty(total + texts.n, np.int64)
    symbols[place] = number * texts.n + row  # words of different texts are different symbols
    closing = np.cumsum(n_words + 1) - 1
    symbols[closing] = -1 - np.arange(texts.n)
    rank, levels, ties = suffix_ranks(symbols)
    windows = ties[3] if len(ties) > 3 else np.zeros(0, np.int64)
    by_window = _union(windows, np.full(len(windows), WINDOW), len(symbols))[place]
    match = longest_matches(rank, levels, ties[2] if len(ties) > 2 else np.zeros(0, np.int64))
    match[match < LEAST_REPEAT] = 0
    at = np.flatnonzero(match)
    by_repeat = _union(at, match[at], len(symbols))[place]
    return starts, ends, row, n_words, match[place], by_window, by_repeat


def measure(texts: Texts) -> dict[str, np.ndarray]:
    starts, ends, row, n_words, match, by_window, by_repeat = repeats(texts)
    n, data = texts.n, texts.data
    out = {"n_words": n_words, "word_chars": texts.per_row(((data & 0xC0) != 0x80) & ~SPACE[data]), "n_symbols": texts.per_row(_SYMBOL[data])}
    # Lines with a word: between newlines and text ends.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([texts.offsets[:-1][np.diff(texts.offsets) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    which = np.searchsorted(texts.offsets, begin, "right") - 1
    stop = texts.offsets[which + 1]
    if len(breaks):
        nxt = np.searchsorted(breaks, begin, "left")
        stop = np.minimum(stop, np.where(nxt < len(breaks), breaks[np.minimum(nxt, len(breaks) - 1)], len(data)))
    first_word = np.searchsorted(starts, begin, "left")
    full = (first_word < len(starts)) & (np.append(starts, len(data) + 1)[first_word] < stop)
    begin, stop, which = begin[full], stop[full], which[full]
    key = texts.numbers(begin, stop) * n + which
    _, firsts = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(which, minlength=n) - np.bincount(which[firsts], minlength=n)
    out["n_repeat_words"] = np.bincount(row[by_window], minlength=n)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, match)
    covered = np.bincount(row[by_repeat], minlength=n)
    too_much = (100 * covered > COVERED_PERCENT * n_words) | ((longest > LONGEST_WORDS) & (100 * longest > LONGEST_PERCENT * n_words))
    out |= {"kept": ~(out["base_failed"] | too_much), "covered_words": covered, "longest_repeat": longest}
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, texts in pieces(batch.column(1)):
            got = measure(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(v if v.dtype == bool else v.astype(np.int64)) for v in got.values())], ["doc_id", *got])


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: the base figures, covered_words, longest_repeat, base_failed and kept."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    order = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]
    assert names == order
    return map_batches(docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text"), _measured, _SCHEMA)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, texts in pieces(batch.column(1)):
            _, _, row, n_words, match, _, _ = repeats(texts)
            first = np.cumsum(n_words) - n_words
            before = np.concatenate([[0], match[:-1]]) if len(match) else match
            at = np.flatnonzero((match > 0) & ((before <= match) | (np.arange(len(match)) == first[row])))
            keys = batch.column(0).take(pa.array(row[at] + i))
            yield pa.RecordBatch.from_arrays([keys, pa.array(at - first[row[at]]), pa.array(match[at])], ["doc_id", "first_word", "n_words"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of the maximal repeated substrings within each text: doc_id, first_word, n_words."""
    return map_batches(docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text"), _spans, "doc_id long, first_word long, n_words long")


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    from .rowfilter import keep_rows

    return keep_rows(docs, text, lambda texts: measure(texts)["kept"])
