"""Words, word hashes and k-gram hashes of many texts at once, by numpy over their UTF-8 bytes.

A span's hash takes its bytes eight at a time, each time mixed into all that went before, so that no pattern inside a
text makes hashes meet; two spans share one by chance alone (2**-64). Hashes only bring candidates together: what
deletes lines, links documents or takes over token ids compares the spans themselves, by same_spans or an Interner.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_SEED = 0x9E3779B97F4A7C15
_GRAM = U(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed and compared one by one; shorter ones eight bytes of all at a time.
LONG = 64
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits: every bit of the input moves every bit of the output, and no two inputs meet."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _eights(raw: np.ndarray, slack: bool = False) -> np.ndarray:
    """For each place the eight bytes from it on; zeros are put beyond the end, unless raw has eight bytes of slack there."""
    whole = raw if slack else np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(whole) - 7, "<u8", whole, 0, (1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end) of some bytes; another seed gives hashes that are independent of these."""
    size = end - start
    key = (_SEED * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF
    out = mix(size.astype(U) ^ U(key))
    short = size <= LONG
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], seed=key)
    live = np.flatnonzero(short & (size > 0))
    at, left, eights = start[live], size[live], _eights(data)
    while len(live):
        out[live] = mix(out[live] ^ (eights[at] & _FIRST_BYTES[np.minimum(left, 8)]))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    return out


def same_spans(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, slack: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Whether spans of some bytes a equal those of b, byte by byte; slack tells whether a and b have eight bytes beyond all spans."""
    size = a_end - a_start
    out = size == b_end - b_start
    for i in np.flatnonzero(out & (size > LONG)).tolist():
        out[i] = np.array_equal(a[a_start[i] : a_end[i]], b[b_start[i] : b_end[i]])
    live = np.flatnonzero(out & (size <= LONG) & (size > 0))
    at, to, left = a_start[live], b_start[live], size[live]
    ours, theirs = _eights(a, slack[0]), _eights(b, slack[1])
    while len(live):
        same = ((ours[at] ^ theirs[to]) & _FIRST_BYTES[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        on = same & (left > 8)
        live, at, to, left = live[on], at[on] + 8, to[on] + 8, left[on] - 8
    return out


class Table:
    """A hash table in numpy arrays, open addressing, from 64-bit hashes to small whole numbers."""

    def __init__(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - self.bits)).astype(np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where there is none."""
        hashes = np.maximum(hashes, U(1))
        out = np.full(len(hashes), -1, np.int64)
        slot, left = self._slots(hashes), np.arange(len(hashes))
        while len(left):
            here = self.keys[slot]
            hit = here == hashes[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Adds hashes that are distinct and not there yet (0 counts as 1)."""
        hashes = np.maximum(hashes, U(1))
        self.n += len(hashes)
        while 2 * self.n > 1 << self.bits:
            self.bits += 1
            had = np.flatnonzero(self.keys)
            hashes, values = np.concatenate([hashes, self.keys[had]]), np.concatenate([values, self.values[had]])
            self.keys, self.values = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int64)
        slot = self._slots(hashes)
        while len(hashes):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = hashes[own], values[own]
            rest = np.ones(len(hashes), bool)
            rest[own] = False
            hashes, values, slot = hashes[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


class Interner:
    """Numbers for spans by their content, from 0 on: equal spans have one number, in every call, and others another."""

    def __init__(self, bits: int = 16) -> None:
        self.table, self.n, self.used = Table(bits), 0, 0
        self.data, self.ends = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)

    def span(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the spans of numbers begin and end in data."""
        return np.where(numbers > 0, self.ends[numbers - 1], 0), self.ends[numbers]

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start
        more = int(size.sum())
        self.data, self.ends = room(self.data, self.used + more + 8), room(self.ends, self.n + len(size))
        self.data[self.used : self.used + more] = data[spread(start, size)]
        self.ends[self.n : self.n + len(size)] = self.used + np.cumsum(size)
        self.n, self.used = self.n + len(size), self.used + more

    def number(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each span, the places of those spans that got new numbers, in the order of these)."""
        out, fresh = np.empty(len(start), np.int64), []
        todo, key = np.arange(len(start)), hashes
        while len(todo):
            found = self.table.get(key)
            missed = np.flatnonzero(found < 0)
            if len(missed):
                new, first, of = np.unique(key[missed], return_index=True, return_inverse=True)
                first = todo[missed[first]]
                self.table.put(new, np.arange(self.n, self.n + len(new)))
                found[missed] = self.n + of
                fresh.append(first)
                self._add(data, start[first], end[first])
            same = same_spans(data, start[todo], end[todo], self.data, *self.span(found), slack=(False, True))
            out[todo[same]] = found[same]
            todo, key = todo[~same], mix(key[~same] ^ U(_SEED))  # spans that share a hash go on to another one
        return out, np.concatenate(fresh) if fresh else np.zeros(0, np.int64)


    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each span, -1 where it has none."""
        out = np.full(len(start), -1, np.int64)
        todo, key = np.arange(len(start)), hashes
        while len(todo):
            found = self.table.get(key)
            todo, key, found = (x[found >= 0] for x in (todo, key, found))
            same = same_spans(data, start[todo], end[todo], self.data, *self.span(found), slack=(False, True))
            out[todo[same]] = found[same]
            todo, key = todo[~same], mix(key[~same] ^ U(_SEED))
        return out


def room(values: np.ndarray, n: int) -> np.ndarray:
    """values, or a copy with room for n that is at least a quarter longer."""
    if n <= len(values):
        return values
    out = np.zeros(max(n, 5 * len(values) // 4), values.dtype)
    out[: len(values)] = values
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)


def byte_table(separators: bytes | set[int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to a word, and the byte that it counts as."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return inside, fold


#: Words [^\x20\x09-\x0D]+, with and without lower-casing A-Z; words of digits, letters and all beyond ASCII, after lower-casing A-Z.
BLANK = {0x20, *range(0x09, 0x0E)}
SPACED = byte_table(BLANK)
SPACED_EXACT = byte_table(BLANK, lower=False)
ALNUM = byte_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


@dataclass
class Words:
    """The words of some texts, in order: where each starts and ends in data, its hash and its text's number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    n_docs: int

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    @property
    def first(self) -> np.ndarray:
        """For each text the number of its first word."""
        return np.concatenate([[0], np.cumsum(self.counts)])[:-1]

    def text(self, start: int, end: int) -> str:
        """Folded words start to end, one space between."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[start:end].tolist(), self.end[start:end].tolist(), strict=True)).decode("utf-8", "replace")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts and the offsets of each; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """The words of texts by a kind of byte table, with hashes of the first seed."""
    inside_table, fold = kind
    raw, at = bytes_of(texts)
    inside = inside_table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(raw):
        edge[0], edge[-1] = inside[0], inside[-1]
    starts = np.concatenate([inside, [False]]) & edge
    ends = np.concatenate([[False], inside]) & edge
    inner = at[1:-1]  # a word does not go on from one text to the next
    joined = inner[(inner > 0) & (inner < len(raw))]
    joined = joined[inside[joined] & inside[joined - 1]] if len(joined) else joined
    starts[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    data = fold[raw]
    doc = np.searchsorted(at[1:], start, side="right")
    return Words(data, start, end, span_hash(data, start, end), doc, len(texts))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive hashes; it has k - 1 fewer entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * _GRAM
        out ^= out >> U(29)
    return mix(out + U(k))


def together(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each word on are of one text."""
    return doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.zeros(0, bool)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def winnowed(values: np.ndarray, inside: np.ndarray, w: int) -> np.ndarray:
    """Which values are the least of a window of w; inside tells which windows count. Ties are all taken."""
    least = sliding_min(values, w)
    chosen = np.zeros(len(values), bool)
    n = len(least)
    for i in range(w if n else 0):
        chosen[i : i + n] |= inside[:n] & (values[i : i + n] == least)
    return chosen
