r"""Spelling variants: words that differ by one edit, found by blocked Gram matrices of letter counts.

A word's vector has the count of each of its letters. One replaced letter moves it by a squared distance of 2, one
inserted or deleted letter by 1, so only words of one length or of adjacent lengths whose vectors are at most 2 apart
can be near. The product of two blocks' count matrices gives all their squared distances at once; the pairs it keeps
are verified letter by letter.

Blocks are made by length and by the numbers of letters from each of a few groups, into which all letters are dealt
evenly. One edit takes a letter from one group and puts one into another, or does one of both: a block meets itself and
the blocks which that leads to, no others. There are more groups as there are more words, so blocks stay small;
those beyond TILE words are cut into tiles. Inside a block numpy goes on to part the words in the same way by single
letters until a product is small. Nothing but each word's number of near words and its best one leaves a block.

Words are of Latin letters (A-Z, a-z, U+00C0 to U+00FF), one byte each in Latin-1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import column, cut, pieces, small_side, written

#: Words that a worker counts before it hands them on, words of a block or tile, and pairs of one product.
MOST_WORDS, TILE, LEAF = 400_000, 16_384, 1 << 18
#: Bytes of a word beyond which its checksum is taken alone.
LONG = 64


@cache
def _crc_table() -> np.ndarray:
    """What each byte does to a CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes, each following on what has the CRC-32 before."""
    table, state, out = _crc_table(), ~before.astype(np.uint32), np.zeros(len(start), np.uint32)
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(before[i]))
    live = np.flatnonzero(end - start <= LONG)
    at, stop, state = start[live], end[live], state[live]
    while len(live):
        done = at >= stop
        if done.any():
            out[live[done]] = ~state[done]
            live, at, stop, state = live[~done], at[~done], stop[~done], state[~done]
        state = table[(state ^ data[at]) & np.uint32(255)] ^ (state >> np.uint32(8))
        at = at + 1
    return out


def latin_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts with A-Z in lower case; start, end, number of characters and text of each run of Latin letters."""
    raw, at = tv.bytes_of(texts)
    two = raw == 0xC3  # with the byte after it a letter from U+00C0 to U+00FF
    after = np.concatenate([[False], two[:-1]]) if len(raw) else two
    low = raw | np.uint8(0x20)
    inside = ((low >= 97) & (low <= 122) & (raw < 128)) | two | after
    edge = np.concatenate([[False], inside, [False]])
    opens = inside & ~edge[:-2]
    ends = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    joined = ends[inside[ends] & inside[ends - 1]]
    opens[joined] = True
    shuts = inside & ~edge[2:]
    shuts[joined - 1] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    first = np.concatenate([[0], np.cumsum(~after)])
    data = np.where((raw >= 65) & (raw <= 90), low, raw)
    return data, start, end, first[end] - first[start], np.searchsorted(at[1:], start, side="right")


def _counted(batches: Iterator[pa.RecordBatch], min_length: int, drop_in: int | None) -> Iterator[pa.RecordBatch]:
    known, n = tv.Interner(18), np.zeros(0, np.int64)

    def handed() -> pa.RecordBatch:
        ends = np.concatenate([[0], known.ends[: known.n]])
        data = pa.Array.from_buffers(pa.large_string(), known.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(known.data[: known.used].tobytes())])
        return pa.RecordBatch.from_arrays([data.cast(pa.string()), pa.array(n)], ["word", "n"])

    for batch in batches:
        for part in pieces(batch, "text"):
            data, start, end, size, doc = latin_runs(column(part, "text"))
            whole = size >= min_length
            start, end, size, doc = start[whole], end[whole], size[whole], doc[whole]
            if drop_in and len(start):
                names = ["" if i is None else str(i) for i in column(part, "doc_id").to_pylist()]
                before = np.array([zlib.crc32(f"{i}:".encode()) for i in names], np.uint32)
                h = crc32(data, start, end, before[doc])
                hit = h % np.uint32(drop_in) == 0
                short = []
                for a, z, k in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist(), strict=True):
                    word = data[a:z].tobytes().decode()
                    k %= len(word)
                    if len(word) > min_length:
                        short.append((word[:k] + word[k + 1 :]).encode())
                start, end = start[~hit], end[~hit]
                if short:
                    ends = len(data) + np.cumsum([len(w) for w in short])
                    start, end = np.concatenate([start, ends - [len(w) for w in short]]), np.concatenate([end, ends])
                    data = np.concatenate([data, np.frombuffer(b"".join(short), np.uint8)])
            if known.n > MOST_WORDS:
                yield handed()
                known, n = tv.Interner(18), n[:0]
            number, _ = known.number(data, start, end, tv.span_hash(data, start, end))
            found = np.bincount(number, minlength=len(n))
            found[: len(n)] += n
            n = found
    if known.n:
        yield handed()


def latin_word_counts(documents: DataFrame, min_length: int = 6, min_count: int = 5, drop_in: int | None = None) -> DataFrame:
    """word, n: runs of Latin letters with A-Z in lower case, of at least min_length characters and min_count occurrences in all.

    With drop_in, spelling errors are put in: where drop_in divides the CRC-32 h of `doc_id:word`, the word's letter
    h % length is left out before words are counted. Texts that are null or empty have no words, a null doc_id is written as nothing,
    other columns are ignored, repeated rows count as often.
    """
    each = documents.select("doc_id", "text").mapInArrow(lambda it: _counted(it, min_length, drop_in), "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: DataFrame) -> list[str]:
    """All letters of words, the most frequent first; there are at most 256."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            data = "".join(column(batch, "word").to_pylist()).encode("latin-1")
            n += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["letter", "n"])

    found = words.select("word").mapInArrow(counted, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    return [chr(r.letter) for r in sorted(found, key=lambda r: (-r.n, r.letter))]


def _groups(letters: list[str], n: int) -> list[str]:
    """Letters, the most frequent first, dealt to n groups back and forth."""
    out = [""] * n
    for i, c in enumerate(letters):
        k = i % (2 * n)
        out[k if k < n else 2 * n - 1 - k] += c
    return out


def _block(length: Column, counts: list[Column]) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in (length, *counts)))


def dealt(words: DataFrame, groups: list[str]) -> DataFrame:
    """word, n, block, side: each word in its own block (side 0), and where it meets another block's words as a word of
    as many letters (1) or of one more (2)."""
    length, g = F.length("word"), range(len(groups))
    own = [F.length("word") - F.length(F.translate("word", x, "")) for x in groups]
    base = words.select("word", "n", length.alias("_l"), *(c.alias(f"_{i}") for i, c in enumerate(own)))
    c = [F.col(f"_{i}") for i in g]
    moved = lambda less, more: [c[i] - int(i == less) + int(i == more) for i in g]
    to = lambda key, side: F.struct(key.alias("block"), F.lit(side).alias("side"))
    places = [to(_block(F.col("_l"), c), 0)]
    places += [F.when(c[i] > 0, to(_block(F.col("_l"), moved(i, j)), 1)) for i in g for j in range(i + 1, len(groups))]
    places += [F.when(c[i] > 0, to(_block(F.col("_l") - 1, moved(i, -1)), 2)) for i in g]
    return base.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("_p")).select("word", "n", "_p.block", "_p.side")


def tiled(rows: DataFrame) -> DataFrame:
    """Rows of dealt with a tile: blocks of more than TILE words of their own are cut, and all others are copied to each tile."""
    large = cut(rows.where("side = 0").groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > TILE).select("block", F.ceil(F.col("_n") / TILE).cast("int").alias("_tiles")))
    n = large.count()
    if not n:
        return rows.withColumn("tile", F.lit(0))
    rows = rows.join(small_side(large, n), "block", "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    home = F.pmod(F.xxhash64("word"), F.col("_tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("_tiles") - 1)
    # A word of a cut block is at home in one tile and meets the words of earlier tiles as one of another block.
    tiles = F.when(F.col("side") == 0, F.slice(every, F.lit(1), home + 1)).otherwise(every)
    out = rows.select("word", "n", "block", "side", home.alias("_home"), F.explode(tiles).alias("tile"))
    return out.select("word", "n", "block", F.when((F.col("side") == 0) & (F.col("tile") < F.col("_home")), 1).otherwise(F.col("side")).alias("side"), "tile")


class Spelled:
    """Words of one length: characters, counts of letters, which letters these are."""

    def __init__(self, words: list[str], letters: np.ndarray | None = None) -> None:
        self.n, self.length = len(words), len(words[0])
        self.chars = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(self.n, self.length)
        self.letters = np.unique(self.chars) if letters is None else letters


def counts(of: Spelled, letters: np.ndarray) -> np.ndarray:
    """How often each word has each of some letters."""
    column_of = np.full(256, len(letters), np.int64)
    column_of[letters] = np.arange(len(letters))
    out, rows = np.zeros((of.n, len(letters) + 1), np.uint8 if of.length < 256 else np.int32), np.arange(of.n)
    for j in range(of.length):
        out[rows, column_of[of.chars[:, j]]] += 1
    return out[:, :-1]


def _parts(a: np.ndarray, b: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the counts a and b that an edit may lead from a to b, in pairs of small sets.

    Words are parted by their number of one letter after the other; from a to b one letter may come in and, unless b's
    words are longer, one may go.
    """
    todo = [(np.arange(len(a)), np.arange(len(b)), 0, 1, 0 if longer else 1)]
    while todo:
        x, y, level, come, go = todo.pop()
        if len(x) * len(y) <= LEAF or level == a.shape[1]:
            yield x, y
            continue
        cx, cy = a[x, level], b[y, level]
        sides = {int(v): y[cy == v] for v in np.unique(cy)}
        for v in np.unique(cx).tolist():
            xs = x[cx == v]
            for step in range(-go, come + 1):
                if v + step in sides:
                    todo.append((xs, sides[v + step], level + 1, come - (step > 0), go - (step < 0)))


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of characters a and b, b as long or longer by one, are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same = lambda x, y: np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
    return same(a, b[:, :-1]) + same(a[:, ::-1], b[:, :0:-1]) >= a.shape[1]


def near(a: Spelled, b: Spelled) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b, as long or longer by one, that are one edit apart."""
    letters = np.union1d(a.letters, b.letters)
    ca, cb = counts(a, letters), counts(b, letters)
    common = np.argsort(-(ca != 0).sum(axis=0), kind="stable")
    ca, cb = ca[:, common], cb[:, common]
    kind = np.float32 if b.length < 2000 else np.float64  # whole numbers up to the square of the length are exact
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in _parts(ca, cb, b.length > a.length):
        fy = cb[y].astype(kind)
        for i in range(0, len(x), max(LEAF // len(y), 1)):
            rows = x[i : i + max(LEAF // len(y), 1)]
            fx = ca[rows].astype(kind)
            distance = (fx * fx).sum(axis=1)[:, None] + (fy * fy).sum(axis=1)[None, :] - 2 * (fx @ fy.T)
            p, q = np.nonzero(distance <= 2)
            p, q = rows[p], y[q]
            step = max((1 << 22) // b.length, 1)  # pairs that are spelled out at once
            for k in range(0, len(p), step):
                good = _one_edit(a.chars[p[k : k + step]], b.chars[q[k : k + step]])
                left.append(p[k : k + step][good])
                right.append(q[k : k + step][good])
    return np.concatenate(left), np.concatenate(right)


def _best(words: list[str], n: np.ndarray, of: np.ndarray, other: np.ndarray, others: list[str], n_others: np.ndarray) -> dict[str, list]:
    """For each word with pairs (of, other): their number, and the most frequent other word, the least of several."""
    if not len(of):
        return {"word": [], "n_near": [], "best_n": [], "best": []}
    order = np.argsort(np.array(others, object), kind="stable")
    rank = np.empty(len(others), np.int64)
    rank[order] = np.arange(len(others))
    by = np.lexsort((rank[other], -n_others[other], of))
    of, other = of[by], other[by]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    size = np.diff(np.append(first, len(of)))
    return {"word": [words[i] for i in of[first].tolist()], "n_near": size.tolist(), "best_n": n_others[other[first]].tolist(), "best": [others[i] for i in other[first].tolist()]}


def _block_pairs(block: pa.Table) -> pa.Table:
    """What the near pairs of one block tell of each word."""
    side = np.asarray(block.column("side"))
    of = [block.filter(pa.array(side == s)) for s in range(3)]
    words = [t.column("word").to_pylist() for t in of]
    n = [np.asarray(t.column("n")).astype(np.int64) for t in of]
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}

    def tell(found: dict[str, list]) -> None:
        for k, v in found.items():
            out[k] += v

    if words[0]:
        home = Spelled(words[0])
        p, q = near(home, home)
        tell(_best(words[0], n[0], p, q, words[0], n[0]))  # both ways round are in it
        for s in (1, 2):
            if words[s]:
                p, q = near(home, Spelled(words[s]))
                tell(_best(words[0], n[0], p, q, words[s], n[s]))
                tell(_best(words[s], n[s], q, p, words[0], n[0]))
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()), "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best_n, best for each of words (word, n; distinct): the number of its near words and the most frequent of them.

    Near words differ by one inserted, deleted or replaced letter; of several as frequent ones the least in code point
    order is the best, and none gives 0 and nulls.
    """
    total = words.count()
    letters = _letters(words) or ["a"]
    n_groups = 3
    while total > 20_000 * 3 ** (n_groups - 1) and n_groups < len(letters):
        n_groups += 1
    rows = tiled(dealt(words, _groups(letters, min(n_groups, len(letters)))))
    told = rows.groupBy("block", "tile").applyInArrow(_block_pairs, "word string, n_near bigint, best_n bigint, best string")
    own = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = own.unionByName(told.withColumn("n", F.lit(None).cast("bigint")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of (word, form) lead in the end. Each round doubles the steps that are looked through.

    A form is several times as frequent as its word, so there are no circles and few rounds. No root has more words than
    can be spelled by as many edits, so its rows need no salting.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        there = roots.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        ahead = cut(roots.join(there, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")))
        roots = ahead.select("word", "root")
        if ahead.where("_moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n; distinct).

    form is the most frequent near word (the least of several), if it is at least factor times as frequent as the word;
    root is where forms lead in the end, the word itself if it has none. An empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("a form has to be more frequent than its word")
    words = words.select("word", "n")
    found = written(near_words(words), "spelling")
    is_form = F.col("best_n") >= F.lit(factor) * F.col("n")
    forms = found.where(is_form).select("word", F.col("best").alias("form"))
    out = found.join(_roots(forms), "word", "left")
    return out.select("word", F.when(is_form, F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))


def variants_of_documents(documents: DataFrame, drop_in: int | None = None) -> DataFrame:
    """spelling_variants of the words of documents (doc_id, text); see latin_word_counts for drop_in."""
    return spelling_variants(written(latin_word_counts(documents, drop_in=drop_in), "words"))
