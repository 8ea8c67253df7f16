"""Weighted acyclic automata over words: count transducers of n-grams in numpy arrays.

A transducer of order k takes n-grams of k symbols to their counts. It is built from sorted n-grams: those that begin
alike share their first arcs, then, from the last arcs back, states from which the same symbols lead on with the same
counts become one, so that it is the least automaton with counts on its last arcs. Symbols are bytes; a symbol's number
is its place in the sorted table of symbols, so numbers sort as the bytes do.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textvec as tv

#: A place in the order of n-grams: the first symbols of those that come from there on.
Bound = tuple[bytes, ...]


def _small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max))


def symbol_table(symbols: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct symbols, sorted, and the number of each given one."""
    coded = symbols.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices)]


def added_up(columns: list[np.ndarray], counts: np.ndarray, n_symbols: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams (a column of numbers for each of their places), sorted, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    key, most = columns[0], n_symbols
    for c in columns[1:]:
        if most * n_symbols >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            most = len(key)
        key, most = key * n_symbols + c, most * n_symbols
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first)


def _merged(first: np.ndarray, label: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The arcs (label, value) of distinct states, and the number of each state's own or equal one. first: where a state's arcs begin."""
    size = np.diff(first)
    place = np.arange(len(label)) - np.repeat(first[:-1], size)
    mixed = tv.mix(tv.mix(tv.mix(label.astype(tv.U)) ^ value.astype(tv.U)) + place.astype(tv.U))
    _, one, of = np.unique(tv.mix(np.add.reduceat(mixed, first[:-1]) ^ size.astype(tv.U)), return_index=True, return_inverse=True)
    same_as = one[of]
    other = np.flatnonzero((same_as != np.arange(len(size))) & (size[same_as] == size))
    good = np.zeros(len(size), bool)
    if len(other):  # equal hashes are only a hint: arcs are compared
        a, b = tv.spread(first[other], size[other]), tv.spread(first[same_as[other]], size[other])
        starts = np.concatenate([[0], np.cumsum(size[other])[:-1]])
        good[other] = np.logical_and.reduceat((label[a] == label[b]) & (value[a] == value[b]), starts)
    kept = np.flatnonzero(~good)
    number = np.empty(len(size), np.int64)
    number[kept] = np.arange(len(kept))
    number[good] = number[same_as[good]]
    arcs = tv.spread(first[kept], size[kept])
    return np.concatenate([[0], np.cumsum(size[kept])]), label[arcs], value[arcs], number


@dataclass
class CountTransducer:
    """Arcs by depth: those of state s at depth d are label[d][first[d][s] : first[d][s + 1]], with the states at the next depth, or counts, that they lead to."""

    symbols: pa.Array
    first: list[np.ndarray]
    label: list[np.ndarray]
    value: list[np.ndarray]

    @property
    def order(self) -> int:
        return len(self.label)

    @staticmethod
    def build(symbols: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> CountTransducer:
        """From sorted, distinct n-grams over sorted, distinct symbols; symbols that they don't use are left out."""
        used = np.zeros(len(symbols), bool)
        for c in columns:
            used[c] = True
        number = np.cumsum(used) - 1
        columns, n = [number[c] for c in columns], len(counts)
        fresh, begins = np.zeros(n, bool), []
        fresh[:1] = True
        for c in columns:
            fresh = fresh.copy()
            fresh[1:] |= c[1:] != c[:-1]
            begins.append(np.flatnonzero(fresh))
        first = [np.array([0, len(begins[0])])] + [np.searchsorted(b, np.append(a, n)) for a, b in zip(begins, begins[1:], strict=False)]
        label = [c[b] for c, b in zip(columns, begins, strict=True)]
        value = [np.arange(len(b)) for b in begins[:-1]] + [counts]
        for d in range(len(columns) - 1, 0, -1) if n else ():
            first[d], label[d], value[d], at = _merged(first[d], label[d], value[d])
            value[d - 1] = at[value[d - 1]]
        return CountTransducer(symbols.filter(pa.array(used)), first, label, value)

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All n-grams, sorted, as columns of symbols' numbers, and their counts."""
        columns: list[np.ndarray] = []
        state = np.zeros(1, np.int64)
        for first, label, value in zip(self.first, self.label, self.value, strict=True):
            size = first[state + 1] - first[state]
            arcs = tv.spread(first[state], size)
            columns = [np.repeat(c, size) for c in columns] + [label[arcs]]
            state = value[arcs]
        return columns, state

    def at_least(self, least: int) -> CountTransducer:
        """Without the n-grams of fewer counts."""
        columns, counts = self.paths()
        keep = counts >= least
        return CountTransducer.build(self.symbols, [c[keep] for c in columns], counts[keep])

    def compose(self, other: CountTransducer) -> np.ndarray:
        """The counts that other has for the n-grams of this one, in the order of its paths; 0 for those that it doesn't have.

        Both are walked at once: a pair of states leads on by the arcs whose symbols both have.
        """
        there = np.asarray(pc.fill_null(pc.index_in(self.symbols, other.symbols), -1)).astype(np.int64)
        n = max(len(other.symbols), 1)
        ours, theirs = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for d in range(self.order):
            size = self.first[d][ours + 1] - self.first[d][ours]
            arcs = tv.spread(self.first[d][ours], size)
            at, symbol = np.repeat(theirs, size), there[self.label[d][arcs]]
            key = np.repeat(np.arange(len(other.first[d]) - 1), np.diff(other.first[d])) * n + other.label[d]
            asked = np.where((at >= 0) & (symbol >= 0), at * n + symbol, -1)
            place = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
            hit = key[place] == asked if len(key) else np.zeros(len(asked), bool)
            last = d == self.order - 1
            theirs = np.where(hit, other.value[d][place] if len(key) else 0, 0 if last else -1)
            ours = self.value[d][arcs]
        return theirs

    def to_bytes(self) -> bytes:
        text = self.symbols.cast(pa.large_binary())
        size = np.asarray(pc.binary_length(text)).astype(np.int64)
        flat = tuple([_small(x) for x in y] for y in ([np.diff(f) for f in self.first], self.label, self.value))
        return pickle.dumps((b"".join(text.to_pylist()), _small(size), *flat), protocol=5)

    @staticmethod
    def from_bytes(data: bytes) -> CountTransducer:
        text, size, first, label, value = pickle.loads(data)
        wide = lambda many: [x.astype(np.int64) for x in many]
        return CountTransducer(symbols_of(text, size), [np.concatenate([[0], np.cumsum(x)]) for x in wide(first)], wide(label), wide(value))


def symbols_of(text: bytes, size: np.ndarray) -> pa.Array:
    """Symbols of given sizes out of their joined bytes."""
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text)]).cast(pa.binary())


def union(many: Iterable[CountTransducer]) -> CountTransducer:
    """The n-grams of all, of one order, with the sums of their counts."""
    many = list(many)
    symbols, number = symbol_table(pa.concat_arrays([t.symbols for t in many]))
    columns: list[list[np.ndarray]] = [[] for _ in range(many[0].order)]
    counts, at = [], 0
    for t in many:
        path, n = t.paths()
        own = number[at : at + len(t.symbols)]
        at += len(t.symbols)
        for c, p in zip(columns, path, strict=True):
            c.append(own[p])
        counts.append(n)
    return CountTransducer.build(symbols, *added_up([np.concatenate(c) for c in columns], np.concatenate(counts), max(len(symbols), 1)))


def cuts(symbols: pa.Array, columns: list[np.ndarray], bounds: list[Bound]) -> np.ndarray:
    """Where sorted n-grams are cut by sorted bounds: the first n-gram that is not before each bound."""
    out, known = np.zeros(len(bounds), np.int64), symbols.to_pylist()
    for i, bound in enumerate(bounds):
        low, high = 0, len(columns[0])
        for depth, symbol in enumerate(bound):
            if depth == len(columns):  # an n-gram comes before those that it begins
                low = high
                break
            k = bisect_left(known, symbol)
            c = columns[depth]
            here = k < len(known) and known[k] == symbol
            left = low + int(np.searchsorted(c[low:high], k, "left"))
            if not here:
                low = left
                break
            low, high = left, low + int(np.searchsorted(c[low:high], k, "right"))
        out[i] = low
    return out
