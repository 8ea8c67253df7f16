"""Byte-level BPE by backtracking over longest matches, and its inverse.

Bytes are mapped to the characters of Latin-1, so that an Aho-Corasick automaton over characters finds all tokens of a
text in one pass. From the left, the longest token at a place is taken if it fits the token before it; else the next
shorter one; if none fits, the place is dead and the token before it is shortened. Two tokens fit if encoding their
bytes gives just these two: no merge crosses the border between them. As merges go by least rank, then leftmost, a row
of tokens is the exact encoding if and only if all adjacent ones fit. What was found for a pair is remembered, each
place dies once and the automaton reads each byte once: the work is linear in the bytes.

Pre-tokens are encoded once a worker and remembered by content. Texts that are null or empty have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import pretokens as pt
from . import textvec as tv
from .common import arrow_map, column, pieces

#: Pairs and pre-tokens that a worker remembers before it forgets them all, and bytes that the automaton reads in one go, one longer pre-token aside.
MOST_PAIRS, MOST_PRETOKENS, CHUNK = 400_000, 500_000, 1_000_000
#: A character that is no byte: no token goes across it.
_WALL = "Ā"


class Merges:
    """The tokens of a rank file, how each is merged, and which of them may follow each other."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as f:
            ranked = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.rank = dict(ranked)
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"{path}: bytes {missing[:5]} are no tokens")
        self.n = max(self.rank.values()) + 1
        self.text = [b""] * self.n
        for token, i in ranked:
            self.text[i] = token
        self.size = [len(t) for t in self.text]
        self.halves, self.whole, self.shorter = [(i, i) for i in range(self.n)], {}, [-1] * self.n
        self.memo: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        merged = []
        for token, i in ranked:
            last = self._merged(token)
            if last is None:  # no row of merges makes it: only a pre-token that equals it has it
                continue
            merged.append(token)
            self.automaton.add_word(token.decode("latin-1"), i)
            if len(token) > 1:
                a, b = (self.rank[x] for x in last)
                if max(a, b) >= i:
                    raise ValueError(f"{path}: token {i} has a lower rank than its halves")
                self.halves[i], self.whole[a * self.n + b] = (a, b), i
        self.automaton.make_automaton()
        known = set(merged)
        for token in merged:
            self.shorter[self.rank[token]] = next((self.rank[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in known), -1)

    def _merged(self, token: bytes) -> tuple[bytes, ...] | None:
        """The two halves of which the merges make a token, itself if it is one byte, None if they don't make it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, self.n) for a, b in zip(parts, parts[1:], strict=False)]
            i = ranks.index(min(ranks))
            if ranks[i] == self.n:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(parts)

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between the tokens a and b: their merges are undone, the latest first."""
        key = a * self.n + b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MOST_PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        whole, halves, n, limit = self.whole, self.halves, self.n, self.n
        while True:
            if whole.get(a * n + b, n) < limit:
                return False
            left = a > b
            for _ in range(2):  # the other side's turn if this one is a single byte
                x = a if left else b
                y = halves[x][1] if left else halves[x][0]
                if y != x:
                    break
                left = not left
            else:
                return True
            # A merge across the border comes before an equal one on its right, after an equal one on its left.
            limit = x if left else x + 1
            a, b = (y, b) if left else (a, y)

    def _walk(self, best: array, at: int, stop: int) -> list[int]:
        """Tokens of the bytes from at to stop; best has the longest token from each place on."""
        tokens: list[int] = []
        dead, size, shorter, fits = set(), self.size, self.shorter, self.fits
        token = best[at]
        while True:
            last = tokens[-1] if tokens else -1
            while token >= 0 and (at + size[token] in dead or last >= 0 and not fits(last, token)):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += size[token]
                if at == stop:
                    return tokens
                token = best[at]
            else:
                dead.add(at)
                token = tokens.pop()
                at -= size[token]

    def encode(self, parts: list[bytes]) -> list[list[int]]:
        """Token ids of pre-tokens; one that is a token is that token."""
        out: list[list[int]] = [[] for _ in parts]
        held, total = [], 0
        for i, part in enumerate(parts):
            token = self.rank.get(part)
            if token is not None:
                out[i] = [token]
            elif part:
                held.append(i)
                total += len(part)
            if total > CHUNK:
                self._encode(parts, held, out)
                held, total = [], 0
        self._encode(parts, held, out)
        return out

    def _encode(self, parts: list[bytes], held: list[int], out: list[list[int]]) -> None:
        text = _WALL.join(parts[i].decode("latin-1") for i in held)
        best, size = array("i", [-1]) * len(text), self.size
        for end, token in self.automaton.iter(text):  # of tokens with one beginning the longest comes last
            best[end + 1 - size[token]] = token
        at = 0
        for i in held:
            out[i] = self._walk(best, at, at + len(parts[i]))
            at += len(parts[i]) + 1


class Codec:
    """Encodes pre-tokens, remembered by content, and decodes ids, for many texts at once."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.bytes = np.frombuffer(b"".join(self.merges.text), np.uint8)
        self.size = np.array(self.merges.size, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        self.known, self.pool, self.used = tv.Interner(18), np.zeros(1 << 18, np.uint32), 0
        self.offset, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def ids(self, pre: pt.PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each pre-token."""
        if self.known.n > MOST_PRETOKENS or self.known.used > 32 * MOST_PRETOKENS:
            self.forget()
        a = self.known.n
        found, fresh = self.known.number(pre.data, pre.start, pre.end, pre.hash)
        if len(fresh):
            ids = self.merges.encode([pre.data[i:j].tobytes() for i, j in zip(pre.start[fresh].tolist(), pre.end[fresh].tolist(), strict=True)])
            n = np.array([len(x) for x in ids], np.int64)
            more = int(n.sum())
            self.pool, self.offset, self.count = tv.room(self.pool, self.used + more), tv.room(self.offset, a + len(n)), tv.room(self.count, a + len(n))
            self.pool[self.used : self.used + more] = np.fromiter((x for one in ids for x in one), np.uint32, more)
            self.count[a : a + len(n)] = n
            self.offset[a : a + len(n)] = self.used + np.cumsum(n) - n
            self.used += more
        counts = self.count[found]
        return self.pool[tv.spread(self.offset[found], counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's ids begin and the last ones end."""
        pre = pt.split(texts)
        ids, counts = self.ids(pre)
        n = np.bincount(pre.doc, weights=counts, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self.bytes[tv.spread(self.start[ids], self.size[ids])].tobytes()


@cache
def codec(path: str) -> Codec:
    """One codec a Python worker."""
    return Codec(path)


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, a list of longs, for each row of documents (doc_id, text; other columns are ignored).

    path names a rank file (base64 of a token's bytes, blank, rank), whose tokens are merged within each match of the
    pattern in pretokens. No special tokens: their strings are ordinary text. Rows come back one for one, repeated ones
    as often; null and empty texts have no ids.
    """

    def encoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text"):
            ids, at = codec(path).encode(pc.fill_null(column(part, "text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), _lists(ids, at)], ["doc_id", "ids"])

    return arrow_map(documents.select("doc_id", "text"), encoded, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<bigint>")


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and data, the bytes of ids, for each row of encoded (doc_id, ids). Null lists give null."""

    def decoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        data = [None if x is None else coder.decode(np.array(x, np.int64)) for x in column(batch, "ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return arrow_map(encoded.select("doc_id", "ids"), decoded, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def bpe_digest(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (over ids as little-endian 32-bit integers), decoded_sha256 (over the decoded bytes).

    As encode_documents and decode_documents, text by text within one worker, so that no ids are handed on.
    """

    def digests(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text"):
            coder = codec(path)
            ids, at = coder.encode(pc.fill_null(column(part, "text"), "").to_pylist())
            each = [ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            shut = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]
            opened = [hashlib.sha256(coder.decode(x)).hexdigest() for x in each]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(at)), pa.array(shut, pa.string()), pa.array(opened, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
