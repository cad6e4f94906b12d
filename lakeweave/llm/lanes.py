"""The transducer of operator 6 on many pieces at once: states, transitions and pair checks as arrays.

All pieces advance by one byte a step. Transitions that are not known yet are determinised together, once each. A state
with more than WIDTH guesses, or one whose hash another state has, is left to the transducer that works piece by piece.
"""

from __future__ import annotations

import numpy as np

from .textkernel import mix

#: Guesses of a state; states that are kept (some 60 MB with their transitions); bytes of a piece that goes in a lane.
WIDTH, STATES, LONGEST = 12, 250_000, 48
_TOKEN = 20
_BEFORE = (1 << 32) - 1


class Table:
    """Whole numbers from 0 to whole numbers from 0, by open addressing."""

    def __init__(self, bits: int = 12):
        self.n, self.keys, self.values = 0, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values; -1 for keys that are not there."""
        out, todo, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ and are not there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = 1 << int(4 * len(keys)).bit_length()
            self.n, self.keys, self.values = 0, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.n += len(keys)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several keys for one place, one stays
            mine = self.keys[at] == keys[todo]
            self.values[at[mine]] = values[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & (len(self.keys) - 1)


class Lanes:
    def __init__(self, machine):
        self.machine, n = machine, len(machine.bytes_of)
        if n >= 1 << _TOKEN:
            raise ValueError("too many tokens")
        self.token_at, self.inner = np.array(machine.token_at, np.int64), np.array(machine.inner, bool)
        self.size = np.array([len(b) for b in machine.bytes_of], np.int64)
        self.child = Table()
        self.child.put(np.fromiter(machine.child.keys(), np.int64, len(machine.child)), np.fromiter(machine.child.values(), np.int64, len(machine.child)))
        rank = machine.ranks.get
        joined = [(a << _TOKEN | b, i) for body, i in machine.ranks.items() for cut in range(1, len(body)) if (a := rank(body[:cut])) is not None and (b := rank(body[cut:])) is not None]
        self.joined = Table()
        self.joined.put(np.array([x for x, _ in joined], np.int64), np.array([x for _, x in joined], np.int64))
        # The two tokens whose merge makes a token: -1 for a byte, -2 if the merges don't make it, -3 if not looked up yet.
        self.left, self.right = np.full(n, -3, np.int64), np.full(n, -3, np.int64)
        self.pairs = Table()
        self.clear()

    def clear(self) -> None:
        self.guess = np.full((1 << 12, WIDTH), -1, np.int64)
        self.guess[0, 0] = 0
        self.guess[1, 0] = -1  # state 1 is where pieces go that no lane can hold
        self.n, self.number, self.step = 2, Table(), Table()
        self.number.put(self._hash(self.guess[:1]), np.zeros(1, np.int64))

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in range(rows.shape[1]):
            h = mix(h + rows[:, c].astype(np.uint64) + np.uint64(0x51ED270B))
        return (h >> np.uint64(1)).astype(np.int64)

    def _parts(self, tokens: np.ndarray) -> None:
        for token in np.unique(tokens[self.left[tokens] == -3]):
            made = self.machine.parts(int(token))
            self.left[token], self.right[token] = made if made else (-1, -1) if made is not None else (-2, -2)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a (-1: come first); see Transducer.allowed."""
        keys, back = np.unique((a + 1) << _TOKEN | b, return_inverse=True)
        known = self.pairs.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            if self.pairs.n > 8 * STATES:
                self.pairs = Table()
                new, known = np.arange(len(keys)), np.zeros(len(keys), np.int64)
            a, b = (keys[new] >> _TOKEN) - 1, keys[new] & ((1 << _TOKEN) - 1)
            self._parts(b)
            good = self.left[b] != -2
            at = np.flatnonzero(good & (a >= 0))
            x, y, x_taken, y_taken = a[at], b[at], np.full(len(at), 1 << 60), np.full(len(at), 1 << 60)
            while len(at):
                across = self.joined.get(x << _TOKEN | y)
                bad = (across >= 0) & (across < x_taken) & (across <= y_taken)
                good[at[bad]] = False
                self._parts(x)
                self._parts(y)
                apart_x, apart_y = self.left[x] >= 0, self.left[y] >= 0
                first = apart_x & (~apart_y | (x > y))
                second = ~first & apart_y
                x_taken, y_taken = np.where(first, x, x_taken), np.where(second, y, y_taken)
                x, y = np.where(first, self.right[x], x), np.where(second, self.left[y], y)
                more = ~bad & (first | second)
                at, x, y, x_taken, y_taken = at[more], x[more], y[more], x_taken[more], y_taken[more]
            known[new] = good
            self.pairs.put(keys[new], known[new])
        return known[back].astype(bool)

    def _advance(self, keys: np.ndarray) -> None:
        """Determinise transitions: for (state << 8 | byte), the next state and the last token of the prefix so far."""
        rows = self.guess[keys >> 8]
        row, _ = at = np.nonzero(rows >= 0)
        guess = rows[at]
        node = self.child.get((guess & _BEFORE) << 8 | (keys & 255)[row])
        live = node >= 0
        row, guess, node = row[live], guess[live], node[live]
        ends = np.flatnonzero(self.token_at[node] >= 0)
        ends = ends[self.allowed((guess[ends] >> 32) - 1, self.token_at[node[ends]])]
        last = np.full(len(keys), -1, np.int64)
        last[row[ends]] = self.token_at[node[ends]]
        sink = keys >> 8 == 1
        if (last[~sink] < 0).any():
            raise ValueError("bytes that no token covers")
        on = self.inner[node]
        row, guess = row[on], guess[on] >> 32 << 32 | node[on]
        count = np.bincount(row, minlength=len(keys))
        sink |= count >= WIDTH
        new = np.full((len(keys), WIDTH), -1, np.int64)
        fits = ~sink[row]
        new[row[fits], (np.arange(len(row)) - (np.cumsum(count) - count)[row])[fits]] = guess[fits]
        new[np.flatnonzero(~sink), count[~sink]] = last[~sink] + 1 << 32
        to = self._numbered(new)
        to[sink] = 1
        self.step.put(keys, to << _TOKEN | np.maximum(last, 0))

    def _numbered(self, rows: np.ndarray) -> np.ndarray:
        hashes, firsts, back = np.unique(self._hash(rows), return_index=True, return_inverse=True)
        state = self.number.get(hashes)
        fresh = np.flatnonzero(state < 0)
        state[fresh] = self.n + np.arange(len(fresh))
        while self.n + len(fresh) > len(self.guess):
            self.guess = np.concatenate([self.guess, np.full_like(self.guess, -1)])
        self.guess[state[fresh]] = rows[firsts[fresh]]
        self.number.put(hashes[fresh], state[fresh])
        self.n += len(fresh)
        out = state[back]
        out[(self.guess[out] != rows).any(1)] = 1
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has; 0 for pieces that no lane can hold."""
        if self.n > STATES:
            self.clear()
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONGEST) :]
        begin, long = start[order], size[order]
        state, lasts = np.zeros(len(order), np.int64), np.zeros((len(order), int(long.max(initial=0))), np.int32)
        for place in range(lasts.shape[1]):
            n = int(np.searchsorted(-long, -place))  # pieces that have this byte
            keys = state[:n] << 8 | data[begin[:n] + place]
            found = self.step.get(keys)
            new = found < 0
            if new.any():
                self._advance(np.unique(keys[new]))
                found[new] = self.step.get(keys[new])
            state[:n], lasts[:n, place] = found >> _TOKEN, found & ((1 << _TOKEN) - 1)
        # From each piece's end back to its start, by the sizes of the last tokens.
        held = np.flatnonzero(state != 1)
        count, steps, end = np.zeros(len(order), np.int64), [], long[held]
        while len(held):
            token = lasts[held, end - 1].astype(np.int64)
            steps.append((held, token))
            count[held] += 1
            end = end - self.size[token]
            held, end = held[end > 0], end[end > 0]
        counts = np.zeros(len(size), np.int64)
        counts[order] = count
        first = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for back, (lane, token) in enumerate(steps):
            ids[(first[order] + count - 1 - back)[lane]] = token
        return ids, counts
