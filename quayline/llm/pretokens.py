r"""Pre-tokens of the byte-level BPE pattern, of many texts at once, and their token ids, remembered by content.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+. A token starts where
the class of characters changes, with three additions: the last blank before a visible character leaves its run of
blanks; that blank joins what follows if it is U+0020; an apostrophe at a token's start takes a contraction's letters.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np

from . import textvec as tv

@cache
def classes() -> np.ndarray:
    """0 for blanks, 1 for letters, 2 for numbers, 3 for all else, by code point, as the tokenizer libraries' own Unicode tables have them.

    Python's tables may be of an older Unicode version than those of the pattern engine that the libraries share.
    """
    import tiktoken

    plain = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 3, np.uint8)
    for kind, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=plain, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@dataclass
class PreTokens:
    """Pre-tokens of some texts, in order: spans of UTF-8 bytes, hashes, the text's number of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def byte_places(points: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and where the last one ends."""
    size = np.ones(len(points), np.int64)
    if len(points) and points.max() >= 0x80:
        size += points >= 0x80
        size += points >= 0x800
        size += points >= 0x10000
    return np.concatenate([[0], np.cumsum(size)])


def split(texts: list[str]) -> PreTokens:
    whole = "".join(texts)
    points, data = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.frombuffer(whole.encode(), np.uint8)
    n = len(points)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    if not n:
        none = np.zeros(0, np.int64)
        return PreTokens(data, none, none, np.zeros(0, tv.U), none)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)  # the first character of a text
    opens[0] = True
    opens[ends] = True
    start = opens.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0) & ~opens[1:n]) + 1  # visible after a blank
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & start[:n])
    if len(quote):
        ahead = np.concatenate([points, np.zeros(2, np.uint32)])
        shut = np.concatenate([opens, [True]])
        one, two = ahead[quote + 1], ahead[quote + 2]
        near = ~shut[quote + 1]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        long = near & ~shut[quote + 2] & (pair("r", "e") | pair("v", "e") | pair("l", "l"))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 2] = False
        start[quote[long] + 3] = True
    start[n] = False
    at = np.flatnonzero(start)
    edge = byte_places(points)[np.append(at, n)]
    return PreTokens(data, edge[:-1], edge[1:], tv.span_hash(data, edge[:-1], edge[1:]), np.searchsorted(ends, at, side="right"))


@cache
def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is visible Latin-1, else from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


def _fits(path: str) -> None:
    """Refuses tokenizer files that cut or rewrite texts in another way than this module."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    parts = [file.get("pre_tokenizer") or {}]
    parts = [x for p in parts for x in (p.get("pretokenizers", [p]))]
    byte_level = [p for p in parts if p.get("type") == "ByteLevel"]
    if file.get("normalizer") or file.get("model", {}).get("type") != "BPE" or len(byte_level) != 1 or len(parts) != 1 or byte_level[0].get("add_prefix_space") or not byte_level[0].get("use_regex", True):
        raise ValueError(f"{path}: only byte-level BPE with its own pattern, no prefix space and no normalizer is understood")
    if odd := [t["content"] for t in file.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"{path}: options of added tokens {odd} are not understood")


class Encoder:
    """Token ids of pre-tokens by the tokenizers library, remembered by content up to most pre-tokens, then forgotten."""

    def __init__(self, path: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _fits(path)
        self.model, self.most = tokenizer.model, most
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.width = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.known, self.pool, self.used = tv.Interner(20), np.zeros(1 << 20, self.width), 0
        self.offset, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    @property
    def full(self) -> bool:
        """Whether the next look-up starts anew."""
        return self.known.n > self.most

    def entries(self, pre: PreTokens, which: np.ndarray) -> np.ndarray:
        """For the chosen pre-tokens their numbers in offset and count; new ones are encoded."""
        if self.full:
            self.forget()
        a = self.known.n
        found, fresh = self.known.number(pre.data, pre.start[which], pre.end[which], pre.hash[which])
        if len(fresh):
            letters = _byte_letters()
            ids = [[t.id for t in self.model.tokenize(pre.data[i:j].tobytes().decode("latin-1").translate(letters))] for i, j in zip(pre.start[which[fresh]].tolist(), pre.end[which[fresh]].tolist(), strict=True)]
            flat = np.array([x for one in ids for x in one], self.width)
            n = np.array([len(x) for x in ids], np.int64)
            self.pool, self.offset, self.count = tv.room(self.pool, self.used + len(flat)), tv.room(self.offset, a + len(n)), tv.room(self.count, a + len(n))
            self.pool[self.used : self.used + len(flat)] = flat
            self.count[a : a + len(n)] = n
            self.offset[a : a + len(n)] = self.used + np.cumsum(n) - n
            self.used += len(flat)
        return found

    def sections(self, texts: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
        """Texts cut at the strings of special tokens; for each section its text's number and the special id after it, or -1."""
        if not self.special or not any(s in t for t in texts for s in self.special):
            return texts, [(i, -1) for i in range(len(texts))]
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        out, of = [], []
        for i, t in enumerate(texts):
            cut = pattern.split(t)
            out += cut[::2]
            of += [(i, self.special[s]) for s in cut[1::2]] + [(i, -1)]
        return out, of

    def ids(self, pre: PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each pre-token."""
        found = self.entries(pre, np.arange(len(pre.hash)))
        counts = self.count[found]
        return self.pool[tv.spread(self.offset[found], counts)], counts


@cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
