"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has an edge for each vocabulary piece at each place. A segmentation's probability is that of
its pieces, raised to alpha, over all segmentations. The k segmentations of the largest Gumbel-perturbed log
probabilities are a sample without replacement. They are found from the best down by an A* search whose nodes are
sets of segmentations with a common beginning: a set's bound is the maximum of its members' perturbed values, drawn
from the set's total mass, which backward sums over the lattice give. A path is one set taken down to a single
segmentation; what it passes by at each step stays in the agenda with a bound cut off at the path's own value.

No piece crosses the place before a word's blank, around a character that the vocabulary lacks, or (looked at in long
words only) between two characters that no piece has side by side. So lattices are those of words; a Python worker
keeps the lattices of words that it has met. All draws are hashes of the row's key, the path and the place.

The vocabulary file has merge ranks, not probabilities; Zipf's law makes them log probabilities: -log(rank + 10).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import arrow_map, column, pieces
from .pretokens import byte_places

SAMPLES, ALPHA = 3, 1.0
#: Bytes of text that are sampled at once, and characters of words whose lattices a worker keeps; beyond them it forgets those met once.
LATTICE_BYTES, KEPT = 1_500_000, 1_000_000
#: Words of more characters are taken one by one, in plain Python, where others go side by side; words of more are cut at pairs of characters.
LONG, CUT = 256, 48
BLANK, LITERAL = 0x2581, 0x10FFFF  # the vocabulary's blank; what a blank sign in a text itself is taken for


class Vocabulary:
    """Pieces as a tree of characters, their log probabilities, and the bytes that each id stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of, self.byte_id, found = [b""] * n, np.zeros(256, np.int64), {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {i} has a blank inside: words can't be taken one by one")
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                found[piece] = (i, model.get_score(i))
        ranked = sorted(found.values(), key=lambda x: (-x[1], x[0]))
        self.log_prob = np.zeros(n)
        for rank, (i, _) in enumerate(ranked):
            self.log_prob[i] = -np.log(rank + 10.0)
        self.piece_id = {p: i for p, (i, _) in found.items()}
        nodes, keys = {"": 0}, []
        for p in found:
            for i in range(1, len(p) + 1):
                if p[:i] not in nodes:
                    keys.append(nodes[p[: i - 1]] << 21 | ord(p[i - 1]))
                    nodes[p[:i]] = len(nodes)
        self.first = np.full(0x110000, -1, np.int32)  # the node of each first character
        for p, node in nodes.items():
            if len(p) == 1:
                self.first[ord(p)] = node
        self.next = tv.Table(18)  # from a node and a character, as one number and mixed without loss, to a node
        self.next.put(tv.mix(np.array(keys, tv.U)), np.arange(1, len(nodes)))
        self.piece_at = np.array([self.piece_id.get(p, -1) for p in nodes], np.int64)
        self.known = np.zeros(0x110000, bool)  # characters that have a piece of their own
        self.known[[ord(p) for p in found if len(p) == 1]] = True
        pairs = {ord(a) << 21 | ord(b) for p in found for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a Python worker."""
    return Vocabulary(path)


def _words(points: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop: at a blank after another character, around characters without a piece, at texts' ends."""
    blank, odd = points == BLANK, ~v.known[points]
    begin = np.zeros(len(points), bool)
    begin[0] = True
    begin[ends[ends < len(points)]] = True
    begin[1:] |= (blank[1:] & ~blank[:-1]) | odd[1:] | odd[:-1]
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], len(points))
    long = stop - start > CUT
    if long.any():
        at = tv.spread(start[long] + 1, (stop - start)[long] - 1)
        pair = points[at - 1].astype(np.int64) << 21 | points[at]
        begin[at[v.pairs[np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)] != pair]] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(points))
    return start, stop


def _edges(flat: np.ndarray, last: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each state's edges begin, and state, length and piece of each edge, by state and length. A character without a piece has one edge, its bytes."""
    lone = np.flatnonzero(~v.known[flat])
    code = flat[lone].astype(np.int64)
    found = [(lone, 1, np.where(code < 128, v.byte_id[np.minimum(code, 127)], -2 - code))]  # more bytes are spelled out later
    live, node, k = np.arange(len(flat)), v.first[flat].astype(np.int64), 1
    while len(live):
        there = node >= 0
        live, node = live[there], node[there]
        piece = v.piece_at[node]
        has = piece >= 0
        found.append((live[has], k, piece[has]))
        on = live + k < last[live]
        live, node = live[on], node[on]
        node, k = v.next.get(tv.mix(node.astype(tv.U) << tv.U(21) | flat[live + k].astype(tv.U))), k + 1
    counts = np.zeros(len(flat) + 1, np.int64)
    for state, _, _ in found:
        counts[state + 1] += 1
    offset = np.cumsum(counts)
    out = np.empty((3, offset[-1]), np.int64)
    free = offset[:-1].copy()
    for state, k, piece in found:
        at = free[state]
        out[0, at], out[1, at], out[2, at] = state, k, piece
        free[state] += 1
    return offset, out[0], out[1], out[2]


def _chain(weight: list[float], after: list[int], offset: list[int], mass: list[float]) -> None:
    """Backward sums of one long word, from its end to its beginning; mass has one entry more than there are states."""
    for s in range(len(offset) - 2, -1, -1):
        w = [weight[e] + mass[after[e]] for e in range(offset[s], offset[s + 1])]
        top = max(w)
        mass[s] = top + math.log(sum([math.exp(x - top) for x in w]))


class Lattices:
    """The lattices of the words met so far: each character a state; the edges of state i are offset[i] to offset[i + 1].

    For each edge its characters, piece, log probability, and the probability of the state's edges up to it.
    """

    def __init__(self, v: Vocabulary, alpha: float) -> None:
        self.v, self.alpha = v, alpha
        self.clear()

    def clear(self) -> None:
        self.words, self.states, self.edges, self.hits = tv.Interner(), 0, 0, np.zeros(1 << 12, np.int64)
        self.base, self.offset, self.stop = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.length, self.piece = np.zeros(1 << 15, np.uint8), np.zeros(1 << 15, np.int32)
        self.log_share, self.upto = np.zeros(1 << 15), np.zeros(1 << 15)

    def place(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word of texts its first state, and its text."""
        if self.states > KEPT:
            self._forget()
        marked = "".join([" " + t if t else "" for t in texts])
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        points = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = byte_places(points)
        points = np.where(points == BLANK, LITERAL, np.where(points == 32, BLANK, points))
        start, stop = _words(points, ends, self.v)
        data = np.frombuffer(marked.encode(), np.uint8)
        n = self.words.n
        number, fresh = self.words.number(data, at[start], at[stop], tv.span_hash(data, at[start], at[stop]))
        if len(fresh):
            self._add(points, start[fresh], stop[fresh], n)
        self.hits = tv.room(self.hits, self.words.n)
        self.hits[: self.words.n] += np.bincount(number, minlength=self.words.n)
        return self.base[number], np.searchsorted(ends, start, side="right")

    def _forget(self) -> None:
        """Keeps the words that were met more than once, if they take no more than half of the room."""
        kept = np.flatnonzero(self.hits[: self.words.n] > 1)
        base = self.base[kept]
        size = self.stop[base] - base
        old = self.words, self.offset, self.length, self.piece, self.log_share, self.upto
        self.clear()
        if 2 * size.sum() > KEPT or not len(kept):
            return
        words, offset, length, piece, log_share, upto = old
        start, end = words.span(kept)
        self.words.number(words.data, start, end, tv.span_hash(words.data, start, end))
        order, _ = self.words.number(words.data, start, end, tv.span_hash(words.data, start, end))
        kept_in_order = np.argsort(order)
        base, size = base[kept_in_order], size[kept_in_order].astype(np.int64)
        states = tv.spread(base.astype(np.int64), size)
        edges = tv.spread(offset[base].astype(np.int64), (offset[base + size] - offset[base]).astype(np.int64))
        self.base, first = np.cumsum(size) - size, np.cumsum(size) - size
        self.offset = np.concatenate([[0], np.cumsum(offset[states + 1] - offset[states])]).astype(np.int32)
        self.stop = np.repeat(first + size, size).astype(np.int32)
        self.length, self.piece, self.log_share, self.upto = length[edges], piece[edges], log_share[edges], upto[edges]
        self.states, self.edges, self.hits = len(states), len(edges), np.ones(len(kept), np.int64)

    def _add(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> None:
        """Lattices of new words, which are numbered from n on."""
        size = stop - start
        base = np.cumsum(size) - size
        flat = points[tv.spread(start, size)]
        last = np.repeat(base + size, size)
        offset, state, length, piece = _edges(flat, last, self.v)
        weight = np.where(piece >= 0, self.alpha * self.v.log_prob[np.maximum(piece, 0)], 0.0)
        mass = self._masses(offset, state, length, weight, last, base, size)
        after = state + length
        inside = after < last[state]
        weight[inside] += mass[after[inside]]
        log_share = weight - mass[state]
        upto = np.exp(log_share)
        begin, many = offset[:-1], np.diff(offset)
        for k in range(1, int(many.max())):
            at = begin[many > k] + k
            upto[at] += upto[at - 1]
        upto[offset[1:] - 1] = 1.0
        s, e = self.states, self.edges
        self.base = tv.room(self.base, n + len(size))
        self.base[n : n + len(size)] = s + base
        self.offset, self.stop = tv.room(self.offset, s + len(flat) + 1), tv.room(self.stop, s + len(flat))
        self.offset[s : s + len(flat) + 1], self.stop[s : s + len(flat)] = e + offset, s + last
        for name, values in (("length", length), ("piece", piece), ("log_share", log_share), ("upto", upto)):
            own = tv.room(getattr(self, name), e + len(state))
            own[e : e + len(state)] = values
            setattr(self, name, own)
        self.states, self.edges = s + len(flat), e + len(state)

    @staticmethod
    def _masses(offset: np.ndarray, state: np.ndarray, length: np.ndarray, weight: np.ndarray, last: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The logarithm of what all ways from a state to its word's end weigh."""
        mass = np.zeros(len(last))
        for a, z in zip(base[size > LONG].tolist(), (base + size)[size > LONG].tolist(), strict=True):
            e = slice(offset[a], offset[z])
            own = [0.0] * (z - a + 1)
            _chain(weight[e].tolist(), (state[e] + length[e] - a).tolist(), (offset[a : z + 1] - offset[a]).tolist(), own)
            mass[a:z] = own[:-1]
        left = (last - np.arange(len(last)))[state]
        few = np.flatnonzero(np.repeat(size <= LONG, size)[state])
        order = few[np.argsort(left[few].astype(np.uint16), kind="stable")]  # the states nearest to their words' ends first
        longest = int(left[order[-1]]) if len(order) else 0
        cuts = np.searchsorted(left[order], np.arange(1, longest + 2))
        for r in range(longest):
            e = order[cuts[r] : cuts[r + 1]]
            w, of_state = weight[e].copy(), state[e]
            goes = length[e] <= r
            w[goes] += mass[of_state[goes] + length[e[goes]]]
            at = np.flatnonzero(np.concatenate([[True], of_state[1:] != of_state[:-1]]))
            top = np.maximum.reduceat(w, at)
            mass[of_state[at]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(at, len(w))))), at))
        return mass


@cache
def lattices(path: str, alpha: float) -> Lattices:
    """The lattices that a Python worker keeps."""
    return Lattices(vocabulary(path), alpha)


_PATH, _PLACE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407
_MASK = (1 << 64) - 1


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> tv.U(12)).astype(np.float64) + 0.5) / (1 << 52)


def _key(seed: int, path: int) -> int:
    """What all draws of a row's path start from."""
    x = (seed + path * _PATH) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def draw(key: int, place: int, step: int) -> float:
    """A uniform number in (0, 1) fixed by a row's key and path, a place and a step."""
    return ((_key(key + place * _PLACE + step * _STEP, 0) >> 12) + 0.5) / (1 << 52)


def draws(key: np.ndarray, place: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """draw() for many keys, places or steps."""
    return _uniform(tv.mix(key + np.asarray(place).astype(tv.U) * tv.U(_PLACE) + np.asarray(step).astype(tv.U) * tv.U(_STEP)))


@dataclass
class _Walk:
    """An independent segmentation of every word: the edges taken, by word, where each word's begin, and the word of each."""

    edges: np.ndarray
    first: np.ndarray
    words: np.ndarray


def _long_walk(lat: Lattices, state: int, key: np.ndarray) -> list[int]:
    """The edges of one long word."""
    stop = int(lat.stop[state])
    e = int(lat.offset[state])
    upto, length = lat.upto[e : lat.offset[stop]].tolist(), lat.length[e : lat.offset[stop]].tolist()
    offset, out, at = (lat.offset[state : stop + 1] - e).tolist(), [], 0
    for u in draws(key, 0, np.arange(stop - state)).tolist():
        edge = offset[at]
        while upto[edge] < u:
            edge += 1
        out.append(e + edge)
        at += length[edge]
        if at == stop - state:
            return out
    raise AssertionError("a walk ends with its word")


def _walk(lat: Lattices, keys: np.ndarray, word: np.ndarray, doc: np.ndarray, place: np.ndarray, order: np.ndarray) -> _Walk:
    """order has the words side by side that are equal, which keeps their lattices in a core's cache."""
    base = keys[doc] + place.astype(tv.U) * tv.U(_PLACE)
    long = (lat.stop[word] - word > LONG)[order]
    live = order[~long]
    state, end, own, n, taken = word[live], lat.stop[word[live]], base[live], np.zeros(len(word), np.int64), []
    while len(live):
        u = draws(own, 0, len(taken))
        edge = lat.offset[state].astype(np.int64)
        more = np.flatnonzero(lat.upto[edge] < u)
        while len(more):
            edge[more] += 1
            more = more[lat.upto[edge[more]] < u[more]]
        taken.append((live, edge))
        state = state + lat.length[edge]
        on = np.flatnonzero(state < end)
        n[live] += 1
        live, state, end, own = live[on], state[on], end[on], own[on]
    whole = [(i, _long_walk(lat, int(word[i]), base[i : i + 1])) for i in order[long].tolist()]
    for i, edges in whole:
        n[i] = len(edges)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(first[-1], np.int64)
    for step, (live, edge) in enumerate(taken):
        out[first[live] + step] = edge
    for i, edges in whole:
        out[first[i] : first[i + 1]] = edges
    return _Walk(out, first, np.repeat(np.arange(len(word)), n))


def _cut_gumbel(mass: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables around log masses, given that they are below most."""
    return -np.logaddexp(-most, np.log(-np.log(u)) - mass)


@dataclass
class _Path:
    """A segmentation: its edges and their words, the log probability before each, and the bounds of the sets passed by there."""

    edges: np.ndarray
    words: np.ndarray
    before: np.ndarray
    bound: np.ndarray
    value: float
    log_prob: float
    best: int = 0
    top: float = -math.inf

    def look(self) -> None:
        """Finds the best of the sets passed by."""
        if len(self.bound):
            self.best = int(self.bound.argmax())
            self.top = float(self.bound[self.best])


def _paths(lat: Lattices, edges: list[np.ndarray], words: list[np.ndarray], values: np.ndarray, keys: np.ndarray, skip: np.ndarray) -> list[_Path]:
    """Paths from their edges; what is passed by at the first skip edges of each is held by other paths."""
    size = np.array([len(e) for e in edges])
    flat = np.concatenate(edges)
    stop = np.cumsum(size)
    logs, before, total = np.minimum(lat.log_share[flat], 0.0), np.zeros(len(flat)), []
    for a, z in zip((stop - size).tolist(), stop.tolist(), strict=True):
        sums = np.cumsum(logs[a:z])
        before[a + 1 : z] = sums[:-1]
        total.append(float(sums[-1]) if z > a else 0.0)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - (stop - size)[owner]
    some = np.flatnonzero((logs < 0) & (at >= skip[owner]))
    bound = np.full(len(flat), -np.inf)
    bound[some] = _cut_gumbel(before[some] + np.log(-np.expm1(logs[some])), values[owner[some]], draws(keys[owner[some]], at[some], 1))
    out = [_Path(e, w, before[a:z], bound[a:z], v, t) for e, w, a, z, v, t in zip(edges, words, (stop - size).tolist(), stop.tolist(), values.tolist(), total, strict=True)]
    for p in out:
        p.look()
    return out


def _branch(lat: Lattices, p: _Path, key: int, gone: set[int]) -> tuple[list[int], float]:
    """The edges through its word of the best of the sets that a path passes by, and that set's perturbed value; the set is taken from the path."""
    i, value = p.best, p.top
    gone.add(int(p.edges[i]))
    here = int(np.searchsorted(lat.offset[: lat.states + 1], np.int32(p.edges[i]), side="right")) - 1
    left = [e for e in range(int(lat.offset[here]), int(lat.offset[here + 1])) if e not in gone]
    shares = np.exp(lat.log_share[left]).tolist()
    x, edge = draw(key, 0, 0) * sum(shares), left[-1]
    for e, share in zip(left, shares, strict=True):
        x -= share
        if x <= 0 and share > 0:
            edge = e
            break
    gone.add(edge)
    rest = sum(share for e, share in zip(left, shares, strict=True) if e != edge)
    p.bound[i] = float(_cut_gumbel(np.float64(p.before[i] + math.log(rest)), np.float64(value), np.float64(draw(key, 0, 1)))) if rest else -math.inf
    p.look()
    own, state, stop = [edge], here + int(lat.length[edge]), int(lat.stop[here])
    while state < stop:
        u, e = draw(key, len(own), 2), int(lat.offset[state])
        while lat.upto[e] < u:
            e += 1
        own.append(e)
        state += int(lat.length[e])
    return own, value


def _ids(lat: Lattices, p: _Path) -> np.ndarray:
    ids = lat.piece[p.edges].astype(np.int64)
    odd = np.flatnonzero(ids < -1)
    if not len(odd):
        return ids
    parts, done = [], 0
    for i in odd.tolist():
        point = -2 - int(ids[i])
        raw = ("▁" if point == LITERAL else chr(point)).encode("utf-8", "replace")
        parts += [ids[done:i], lat.v.byte_id[list(raw)]]
        done = i + 1
    return np.concatenate([*parts, ids[done:]])


def log_inclusion(log_prob: float, threshold: float) -> float:
    """The log probability that a segmentation's perturbed value passes a threshold: log(1 - exp(-exp(log_prob - threshold)))."""
    x = log_prob - threshold
    return x if x < -40 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def sample(texts: list[str], seeds: np.ndarray, lat: Lattices, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: ids, log probability, perturbed value, log inclusion score."""
    word, doc = lat.place(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    place, order = np.arange(len(word)) - first[doc], np.argsort(word, kind="stable")
    with np.errstate(over="ignore", divide="ignore"):
        keys = lambda j: tv.mix(seeds + tv.U(j * _PATH & _MASK))
        top = -np.log(-np.log(draws(keys(3 * k), 0, 0)))
        w = _walk(lat, keys(0), word, doc, place, order)
        cut = w.first[first].tolist()
        start = _paths(lat, [w.edges[a:z] for a, z in zip(cut, cut[1:], strict=False)], [w.words[a:z] for a, z in zip(cut, cut[1:], strict=False)], top, keys(k), np.zeros(len(texts), np.int64)) if texts else []
        found = [[p] for p in start]
        taken: list[dict[tuple[int, int], set[int]]] = [{} for _ in texts]  # edges that are gone at a step of a path
        for n in range(1, k):
            w, key, end = _walk(lat, keys(n), word, doc, place, order), keys(2 * k + n).tolist(), first[1:].tolist()
            whose, edges, words, values, skip = [], [], [], [], []
            for d, paths in enumerate(found):
                j = max(range(len(paths)), key=lambda x: paths[x].top)
                p = paths[j]
                if len(paths) < n or p.top == -math.inf:
                    continue
                i = p.best
                own, value = _branch(lat, p, key[d], taken[d].setdefault((j, i), set()))
                at = int(p.words[i])
                rest = slice(int(w.first[at + 1]), int(w.first[end[d]]))
                edges.append(np.concatenate([p.edges[:i], own, w.edges[rest]]))
                words.append(np.concatenate([p.words[:i], np.full(len(own), at), w.words[rest]]))
                whose.append(d)
                values.append(value)
                skip.append(i + 1)
            if not whose:
                break
            for d, p in zip(whose, _paths(lat, edges, words, np.array(values), keys(k + n)[whose], np.array(skip)), strict=True):
                found[d].append(p)
    out = []
    for paths in found:
        threshold = max(p.top for p in paths)
        out.append([(_ids(lat, p), p.log_prob, p.value, log_inclusion(p.log_prob, threshold)) for p in paths])
    return out


def _sampled(batch: pa.RecordBatch, path: str, k: int, alpha: float) -> Iterator[pa.RecordBatch]:
    lat = lattices(path, alpha)
    for part in pieces(batch, "text", LATTICE_BYTES):
        texts = pc.fill_null(column(part, "text"), "").to_pylist()
        found = sample(texts, column(part, "seed").to_numpy().view(tv.U), lat, k)
        row = pa.array([d for d, f in enumerate(found) for _ in f], pa.int64())
        flat = [x for f in found for x in f]
        ids = pa.array([x[0].astype("<u4").tobytes() for x in flat], pa.binary())
        rank = pa.array([j for f in found for j in range(len(f))], pa.int32())
        yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(row), column(part, "text_crc").take(row), rank, ids, *(pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3))], ["doc_id", "text_crc", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])


def _seeded(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("doc_id").alias("seed"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc"))


def encode(documents: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """doc_id, text_crc, sample (0 the best), ids (little-endian unsigned 32-bit), log_prob, perturbed, log_inclusion.

    Up to k distinct segmentations for each row of documents (doc_id, text; other columns are ignored): fewer where
    the lattice has fewer. The key is the doc_id's hash, so rows that share an id and a text have the same sample,
    whatever the partitions. A null text is empty: one segmentation without ids. log_inclusion is the log
    probability that a segmentation's perturbed value passes the (k+1)-th. path names a SentencePiece file.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(_seeded(documents), lambda b: _sampled(b, path, k, alpha), f"doc_id {kind}, text_crc bigint, sample int, ids binary, log_prob double, perturbed double, log_inclusion double")


def _decoded(batch: pa.RecordBatch, path: str, carried: list[str]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for part in pieces(batch, "ids", 4 * LATTICE_BYTES):
        texts = [None if x is None else v.decode(np.frombuffer(x, "<u4")) for x in column(part, "ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(column(part, c) for c in carried), pa.array(texts, pa.string())], [*carried, "decoded"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with decoded: the text that ids stand for. Null ids give null. A column named decoded is replaced."""
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    carried = rows.columns
    return arrow_map(rows, lambda b: _decoded(b, path, carried), f"{schema}, decoded string")


def _digested(batch: pa.RecordBatch, path: str, k: int, alpha: float) -> Iterator[pa.RecordBatch]:
    """The samples of a batch, decoded again by the same worker, with checksums in place of their ids."""
    v = vocabulary(path)
    for rows in _sampled(batch, path, k, alpha):
        ids = column(rows, "ids").to_pylist()
        back = [zlib.crc32(v.decode(np.frombuffer(x, "<u4")).encode()) for x in ids]
        same = pa.array(np.array(back, np.int64) == column(rows, "text_crc").to_numpy())
        kept = [column(rows, c) for c in ("doc_id", "sample")]
        digests = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
        names = ["log_prob", "perturbed", "log_inclusion"]
        yield pa.RecordBatch.from_arrays([*kept, *digests, *(column(rows, c) for c in names), same], ["doc_id", "sample", "n_tokens", "ids_crc32", *names, "round_trip"])


def sample_digest(documents: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """doc_id, sample, n_tokens, ids_crc32, log_prob, perturbed, log_inclusion, and whether decoding gives the text back."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, sample int, n_tokens bigint, ids_crc32 bigint, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return arrow_map(_seeded(documents), lambda b: _digested(b, path, k, alpha), schema)
