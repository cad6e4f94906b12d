"""Operator 6, byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

The merges of a rank file say which tokens may stand next to each other: a sequence of tokens is the encoding of its
bytes exactly if every token encodes itself and every adjacent pair is what the merges make of the pair's bytes. That
gives a non-deterministic transducer: read bytes along the tokens' trie, guess each token's end, keep guesses whose
pairs are allowed. As every prefix has one encoding, one guess at most ends a token after each byte. It is determinised
as texts need it: a state is the set of live guesses (the token before, the place in the trie), a transition gives the
next state and the last token of the prefix read so far. A token is emitted when all live guesses agree on it, which
the longest token bounds: after LOOK more bytes at the latest. States and transitions are cached up to a size, then
dropped and built anew; results don't depend on that.

Defined results: a null text encodes as an empty one (no ids); repeated rows alike, each by itself; ties of ranks go to the
left, as the merges say; an empty table gives an empty result; other columns are ignored, whatever their names. Texts are
encoded whole, however long, in runs of whole texts of about half a megabyte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lanes import Lanes
from .textkernel import Texts, pieces
from .workers import map_batches, on_release

#: Cached transitions and cached pieces of a worker (some 60 and 40 MB); bytes of text in a run.
TRANSITIONS, PIECES, RUN = 120_000, 600_000, 1 << 20
#: Bytes of a piece after which what all guesses agree on is emitted.
LOOK = 4096
_NODE = (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        for b, i in ranks.items():
            node = 0
            for x in b:
                key = node << 8 | x
                self.inner[node] = True
                node = self.child.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = i
        self.size = [len(b) for b in self.bytes_of]
        self.longest = max(self.size, default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple | None] = {}
        self.clear()

    def clear(self) -> None:
        """Forget states and transitions. A guess is (token before + 1) << 32 | place in the trie."""
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merge(self, body: bytes, pairs: list | None = None) -> list[int]:
        """What the merges make of a few bytes, by definition; `pairs` gets the merged pairs in order."""
        parts = [body[i : i + 1] for i in range(len(body))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            if pairs is not None:
                pairs.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; () for a byte, None if the merges don't make it."""
        found = self.made.get(token, 0)
        if found == 0:
            body, ends = self.bytes_of[token], []
            if len(body) == 1:
                found = ()
            elif self.merge(body, ends) == [token]:
                found = (self.ranks[ends[-1][0]], self.ranks[ends[-1][1]])
            else:
                found = None
            self.made[token] = found
        return found

    def allowed(self, a: int, b: int) -> bool:
        """Whether b may follow a; a = -1: whether b may come first.

        Going back in time from the finished pair: x and y are the tokens at the seam, taken apart latest merge first.
        A merge across the seam would have happened if its rank comes before the ranks that took in x and y (of equal
        ranks the left place goes first).
        """
        if a < 0:
            return self.parts(b) is not None
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        if len(self.pairs) > 2 * TRANSITIONS:
            self.pairs.clear()
        found = self.parts(b) is not None
        x, y, x_taken, y_taken = a, b, 1 << 60, 1 << 60
        while found:
            across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if across is not None and across < x_taken and across <= y_taken:
                found = False
                break
            px, py = self.parts(x), self.parts(y)
            if px and (not py or x > y):
                x_taken, x = x, px[1]
            elif py:
                y_taken, y = y, py[0]
            else:
                break
        self.pairs[a, b] = found
        return found

    def _advance(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the last token of the prefix that ends there."""
        child, token_at, inner, pairs = self.child, self.token_at, self.inner, self.pairs
        live, last = [], -1
        for guess in self.states[state]:
            node = child.get((guess & _NODE) << 8 | byte)
            if node is None:
                continue
            if last < 0:
                token = token_at[node]
                if token >= 0:
                    before = (guess >> 32) - 1
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.allowed(before, token)
                    if fits:
                        last = token
            if inner[node]:
                live.append(guess >> 32 << 32 | node)
        if last < 0:
            raise ValueError("bytes that no token covers")
        live.append(last + 1 << 32)
        new = tuple(live)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.step[state << 8 | byte] = found = (to, last)
        return found

    def _path(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the prefix that ends there, backwards."""
        out, size = [], self.size
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= size[token]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern; a match that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.step) > TRANSITIONS:
            self.clear()
        out: list[int] = []
        lasts: list[int] = []
        state, step = 0, self.step
        for byte in piece:
            found = step.get(state << 8 | byte)
            state, last = found if found is not None else self._advance(state, byte)
            lasts.append(last)
            if len(lasts) >= LOOK:
                lasts = self._emit(lasts, out)
                if len(step) > 2 * TRANSITIONS:
                    guesses = self.states[state]
                    self.clear()
                    step = self.step
                    state = self.number.setdefault(guesses, 1)
                    self.states.append(guesses)
        out += reversed(self._path(lasts, len(lasts)))
        return out

    def _emit(self, lasts: list[int], out: list[int]) -> list[int]:
        """Emit the tokens that the encodings of all prefixes a live guess may start from share; what is left of lasts."""
        reach = len(lasts)
        shared = self._path(lasts, reach)[::-1]
        for back in range(1, min(self.longest, reach) + 1):
            other = self._path(lasts, reach - back)[::-1]
            n = next((i for i, (a, b) in enumerate(zip(shared, other)) if a != b), min(len(shared), len(other)))
            shared = shared[:n]
        out += shared
        return lasts[sum(self.size[t] for t in shared) :]


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text that is complete; a state machine holds back an open code point."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(body: bytes) -> int:
        """Bytes at the end that begin a code point without ending it."""
        for back in range(1, min(3, len(body)) + 1):
            lead = body[-back]
            if lead & 0xC0 != 0x80:
                need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
                return back if need > back else 0
        return 0

    def feed(self, body: bytes) -> str:
        body = self.held + body
        cut = len(body) - self._open(body)
        self.held = body[cut:]
        return body[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


# The contractions of the split pattern, by first letter, with the letters they take.
_SHORT = {"s": "s", "t": "t", "m": "m", "d": "d", "r": "re", "v": "ve", "l": "ll"}


def _classes() -> np.ndarray:
    """Class of every code point under the split pattern: 0 white space, 1 letter, 2 number, 3 other."""
    import regex

    out = np.full(0x110000, 3, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, points))
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


class Codec:
    """Encode and decode runs of texts. Distinct pieces go through the transducer once while they stay in a cache."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        self.machine = Transducer(load_ranks(path))
        self.lanes = Lanes(self.machine)
        self.pattern = regex.compile(pattern)
        self.classes = _classes() if pattern == public_tokenizers.PATTERN else None
        lengths = np.array([len(b) for b in self.machine.bytes_of], np.int64)
        self.byte_len, self.byte_at = lengths, np.cumsum(lengths) - lengths
        self.all_bytes = np.frombuffer(b"".join(self.machine.bytes_of), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.body, self.first, self.last = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, texts: Texts) -> np.ndarray:
        """First byte of every match of the pattern, in order. Matches leave no gap."""
        data = texts.data
        if self.classes is None:
            out = []
            for a, b in zip(texts.offsets[:-1], texts.offsets[1:]):
                text = data[a:b].tobytes().decode()
                ends = np.cumsum([len(m.encode()) for m in self.pattern.findall(text)], dtype=np.int64)
                out.append(a + np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends)
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(point)
        if not n:
            return np.zeros(0, np.int64)
        first_byte = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[point]
        new_row = np.zeros(n, bool)
        rows = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        new_row[np.searchsorted(first_byte, rows)] = True
        edge = new_row.copy()
        edge[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        what = kind[start]
        follows = np.append(~new_row[start[1:]], False)  # the next run is of the same text
        led = np.concatenate([[False], follows[:-1]])
        blank = np.zeros(len(start), bool)  # a space before it goes with the run
        blank[1:] = led[1:] & (what[:-1] == 0) & (point[start[1:] - 1] == 32)
        cut = np.zeros(n + 1, bool)
        solid = what != 0
        cut[start[solid] - blank[solid]] = True
        cut[start[~solid]] = True
        tail = ~solid & follows & (end - start >= 2)
        cut[end[tail] - 1] = True
        quote = np.flatnonzero((what == 3) & (end - start == 1) & (point[start] == 39) & ~blank & follows)
        quote = quote[what[quote + 1] == 1] if len(quote) else quote
        for q in quote:
            a, b = start[q + 1], end[q + 1]
            tail_of = _SHORT.get(chr(point[a]))
            if tail_of and (len(tail_of) == 1 or (b - a > 1 and chr(point[a + 1]) == tail_of[1])):
                cut[a] = False
                cut[a + len(tail_of)] = True
        return first_byte[np.flatnonzero(cut[:n])]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's first place among them."""
        start = self.split(texts)
        end = np.append(start[1:], len(texts.data))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(texts.n + 1, np.int64)
        keys, firsts, which = np.unique(texts.hashes(start, end), return_index=True, return_inverse=True)
        if len(self.keys) > PIECES:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        raw, encode = texts.data.tobytes(), self.machine.encode_piece
        if not known.all():
            new = firsts[~known]
            size = end[new] - start[new]
            made, count = self._made(texts.data, raw, start[new], size)
            total, body_at = np.concatenate([[0], np.cumsum(size)]), len(self.body)
            self.body = np.concatenate([self.body, texts.data[_spread(start[new], size, total)]])
            at = len(self.flat) + np.cumsum(count) - count
            self.flat = np.concatenate([self.flat, made])
            for name, values in (("keys", keys[~known]), ("at", at), ("count", count), ("first", body_at + total[:-1]), ("last", body_at + total[1:])):
                setattr(self, name, np.insert(getattr(self, name), place[~known], values))
            place = np.searchsorted(self.keys, keys)
        entry = place[which]
        at, count, flat = self.at[entry], self.count[entry], self.flat
        other = np.flatnonzero(~texts.same(start, end, Texts(self.body, np.array([0, len(self.body)])), self.first[entry], self.last[entry]))
        if len(other):  # another piece has the same hash
            made = [encode(raw[start[i] : end[i]]) for i in other]
            count[other] = [len(x) for x in made]
            at[other] = len(flat) + np.cumsum(count[other]) - count[other]
            flat = np.concatenate([flat, np.array([i for x in made for i in x], np.uint32)])
        total = np.concatenate([[0], np.cumsum(count)])
        return flat[_spread(at, count, total)], total[np.searchsorted(start, texts.offsets)]

    def _made(self, data: np.ndarray, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and how many each has: whole tokens, pieces in lanes, then the rest."""
        whole = np.array([self.machine.ranks.get(raw[a : a + n], -1) for a, n in zip(start.tolist(), size.tolist())], np.int64)
        count = (whole >= 0).astype(np.int64)
        open_ = np.flatnonzero(whole < 0)
        ids, n = self.lanes.encode(data, start[open_], size[open_])
        left = open_[n == 0]
        rest = [self.machine.encode_piece(raw[start[i] : start[i] + size[i]]) for i in left]
        count[open_] = n
        count[left] = [len(x) for x in rest]
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        out[first[whole >= 0]] = whole[whole >= 0]
        out[_spread(first[open_], n, np.concatenate([[0], np.cumsum(n)]))] = ids
        for i, x in zip(left, rest):
            out[first[i] : first[i] + len(x)] = x
        return out, count

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, one after another, and each id's first byte (and the end)."""
        count = self.byte_len[ids]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.all_bytes[_spread(self.byte_at[ids], count, total)], total

    def encode_text(self, text: str) -> list[int]:
        body = np.frombuffer(text.encode(), np.uint8)
        return self.encode(Texts(body, np.array([0, len(body)])))[0].tolist()

    def decode_text(self, ids: Iterable[int], step: int = 1 << 12) -> Iterator[str]:
        """The text of a stream of ids, as it comes: only complete code points are given out."""
        stream, held = Utf8Stream(), []
        for i in ids:
            held.append(self.machine.bytes_of[i])
            if len(held) == step:
                yield stream.feed(b"".join(held))
                held = []
        yield stream.feed(b"".join(held)) + stream.close()


def _spread(at: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Places at[k], at[k] + 1, ... count[k] of them, for all k; total is the running sum of counts from 0."""
    return np.repeat(at - total[:-1], count) + np.arange(total[-1])


_codecs: dict[tuple[str, str], Codec] = {}
on_release(__name__, _codecs.clear)


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded): ids and the bytes decoded from them, as binary columns.

    `path` is the rank file's place on the executors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for i, j, texts in pieces(batch.column(1), RUN):
                ids, first = coder.encode(texts)
                decoded, at = coder.decode(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(ids.astype("<u4"), 4 * first), _binary(decoded, at[first])], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, ids binary, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of ids and of decoded bytes."""
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
