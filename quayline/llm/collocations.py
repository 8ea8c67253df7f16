r"""Phrases whose words keep together, by language, from exact counts in weighted acyclic automata.

Texts with A-Z in lower case are cut at `[.,;:!?\x0A-\x0D]` into pieces and those at blanks and tabs into words. A phrase
can only be as frequent as its parts, so phrases are counted by length: n-grams of frequent words, then those whose
both parts without an end word are frequent. A filter of fixed size (bits by hash; it lets some others pass, which only
adds work) tells tasks what is frequent.

Each task sorts its n-grams, language first, builds a count transducer from them whenever it has SHARD of them, cut at
the bounds of prefix ranges, and hands on the cuts. The cuts of a range are united, their counts summed. Bounds are
weighted quantiles of the frequent words; a word with the share of several ranges is cut at its second words, and beyond
MOST_RANGES prefix ranges each is cut by hash into slices, so that a part of the work stays as large as RANGE_WORDS
words make it, whatever the input. Counts of a phrase's parts are looked up by composition: ranges ask each other with
automata of the parts that they need, and get them back with counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .automata import Bound, CountTransducer, added_up, cuts, symbol_table, union
from .common import column, pieces, written

#: N-grams and words that a task holds before it hands on a transducer; words of a range; ranges, beyond which they are sliced.
SHARD, SHARD_WORDS, RANGE_WORDS, MOST_RANGES = 1_000_000, 400_000, 600_000, 16_384
#: Bits of the filter of frequent n-grams, 8 MB; frequent words that bounds are taken from, for each range.
BITS, SAMPLE = 1 << 26, 32
_CUTS = {*b".,;:!?", *range(0x0A, 0x0E)}
_KIND = tv.byte_table({0x20, 0x09} | _CUTS)
_LANG = np.uint64(0xD1B54A32D192ED03)


class Pieces:
    """The words of some texts, the language's number of each, and which words are followed by the next one in their piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.words = w = tv.words(column(batch, "text"), _KIND)
        langs = pc.fill_null(column(batch, "lang"), "und").dictionary_encode()
        self.langs = langs.dictionary.cast(pa.binary())
        self.lang = np.asarray(langs.indices).astype(np.int64)[w.doc]
        cut = np.zeros(256, bool)
        cut[list(_CUTS)] = True
        before = np.concatenate([[0], np.cumsum(cut[w.data])])
        self.linked = (before[w.start[1:]] == before[w.end[:-1]]) & (w.doc[1:] == w.doc[:-1]) if len(w.doc) else np.zeros(0, bool)

    def language_hash(self) -> np.ndarray:
        return _hashes(self.langs)[self.lang] if len(self.lang) else np.zeros(0, tv.U)


def _hashes(symbols: pa.Array) -> np.ndarray:
    data, at = tv.bytes_of(symbols.cast(pa.string()))
    return tv.span_hash(data, at[:-1], at[1:])


def _gram_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    out = lang * _LANG
    for w in words:
        out = tv.mix(out ^ w) * _LANG
    return tv.mix(out)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (hashes % np.uint64(BITS)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _places(hashes)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, langs, n = tv.Interner(18), {}, {}

    def handed() -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([[0], known.ends[: known.n]])
        for lang, counts in n.items():
            some = np.flatnonzero(counts)
            data = pa.Array.from_buffers(pa.large_string(), known.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(known.data[: known.used].tobytes())])
            words = data.take(pa.array(some)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), words, pa.array(counts[some])], ["lang", "word", "f"])

    for batch in batches:
        for part in pieces(batch, "text"):
            found = Pieces(part)
            w = found.words
            number, _ = known.number(w.data, w.start, w.end, w.hash)
            for i, lang in enumerate(found.langs.cast(pa.string()).to_pylist()):
                here = np.bincount(number[found.lang == i], minlength=known.n)
                if here.any():
                    had = n.get(lang, here[:0])
                    here[: len(had)] += had
                    n[lang] = here
            if known.n > SHARD_WORDS or sum(map(len, n.values())) > 10 * SHARD_WORDS:
                yield from handed()
                known, n = tv.Interner(18), {}
    yield from handed()


def word_counts(documents: DataFrame) -> DataFrame:
    """lang, word, f: all occurrences of each word in documents (text, lang) by language."""
    each = documents.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, f bigint")
    return each.groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Ranges:
    """Parts that n-grams belong to: a range by their order, and a slice of it by their hash."""

    def __init__(self, frequent: DataFrame, n_words: int) -> None:
        n = max(-(-n_words // RANGE_WORDS), 1)
        self.slices = -(-n // MOST_RANGES)
        n = -(-n // self.slices)
        chance = (F.pmod(F.xxhash64("lang", "word"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
        found = frequent.select("lang", "word", "f", (F.col("f") / chance).alias("p")).orderBy(F.desc("p"), "lang", "word").limit(SAMPLE * n + 1).collect() if n > 1 else []
        least = found[-1].p if len(found) > SAMPLE * n else 0.0
        sample = sorted((r.lang.encode(), r.word.encode(), max(r.f, least)) for r in found[: SAMPLE * n])
        self.bounds: list[Bound] = []
        total, so_far, k = sum(x[2] for x in sample), 0.0, 1
        for lang, word, f in sample:
            mine = 0
            while k < n and total * k / n < so_far + f:
                mine, k = mine + 1, k + 1
            so_far += f
            if mine:
                self.bounds.append((lang, word))
            if mine > 1:
                self.bounds += [(lang, word, x) for x in _quantiles([s for s in sample if s[0] == lang], mine)]
        self.bounds = sorted(set(self.bounds))

    def split(self, symbols: pa.Array, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """The parts of sorted n-grams and which n-grams are theirs."""
        at = [0, *cuts(symbols, columns, self.bounds).tolist(), len(columns[0])]
        hashes = _hashes(symbols) if self.slices > 1 else None
        for r, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a == z:
                continue
            if hashes is None:
                yield r, np.arange(a, z)
                continue
            slice_of = _gram_hash(hashes[columns[0][a:z]], [hashes[c[a:z]] for c in columns[1:]]) % np.uint64(self.slices)
            for s in np.unique(slice_of).tolist():
                yield r * self.slices + s, a + np.flatnonzero(slice_of == s)


def _quantiles(sample: list[tuple[bytes, bytes, float]], n: int) -> list[bytes]:
    """n - 1 words that part a language's words evenly."""
    total, so_far, out = sum(s[2] for s in sample), 0.0, []
    for _, word, f in sample:
        so_far += f
        while len(out) < n - 1 and so_far > total * (len(out) + 1) / n:
            out.append(word)
    return sorted(set(out))


def _shards(symbols: pa.Array, columns: list[np.ndarray], counts: np.ndarray, ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Transducers of sorted n-grams by part."""
    for part, rows in ranges.split(symbols, columns):
        built = CountTransducer.build(symbols, [c[rows] for c in columns], counts[rows])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(columns) - 1], pa.int32()), pa.array([built.to_bytes()], pa.binary())], ["part", "size", "data"])


class _Shard:
    """N-grams that a task has met."""

    def __init__(self, size: int, ranges: Ranges) -> None:
        self.size, self.ranges = size, ranges
        self.clear()

    def clear(self) -> None:
        self.known, self.langs, self.held, self.rows = tv.Interner(16), {}, [], 0

    def add(self, found: Pieces, at: np.ndarray) -> None:
        """The n-grams that begin with the words at some places."""
        w = found.words
        need = np.unique((at[:, None] + np.arange(self.size)).ravel())
        number = np.zeros(len(w.start), np.int64)
        number[need], _ = self.known.number(w.data, w.start[need], w.end[need], w.hash[need])
        langs = np.array([self.langs.setdefault(x, len(self.langs)) for x in found.langs.to_pylist()], np.int64)
        self.held.append(([langs[found.lang[at]], *(number[at + i] for i in range(self.size))], np.ones(len(at), np.int64)))
        self.rows += len(at)

    def pack(self) -> None:
        """Adds up what is held."""
        columns = [np.concatenate(c) for c in zip(*(h[0] for h in self.held), strict=True)]
        columns, counts = added_up(columns, np.concatenate([h[1] for h in self.held]), max(self.known.n, len(self.langs)))
        self.held, self.rows = [(columns, counts)], len(counts)

    def handed(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.pack()
        (columns, counts), k = self.held[0], self.known
        ends = np.concatenate([[0], k.ends[: k.n]])
        words = pa.Array.from_buffers(pa.large_binary(), k.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(k.data[: k.used].tobytes())]).cast(pa.binary())
        symbols, number = symbol_table(pa.concat_arrays([words, pa.array(list(self.langs), pa.binary())]))
        columns = [number[columns[0] + k.n], *(number[c] for c in columns[1:])]
        columns, counts = added_up(columns, counts, len(symbols))
        yield from _shards(symbols, columns, counts, self.ranges)
        self.clear()


def _counted(batches: Iterator[pa.RecordBatch], size: int, bits: np.ndarray, ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Shard transducers of n-grams of some words, both of whose parts of one word less pass the filter."""
    shard = _Shard(size, ranges)
    for batch in batches:
        for part in pieces(batch, "text"):
            found = Pieces(part)
            w, n = found.words, len(found.words.start) - size + 1
            if n < 1:
                continue
            linked = np.ones(n, bool)
            for i in range(size - 1):
                linked &= found.linked[i : i + n]
            short = len(w.hash) - size + 2
            good = _passes(bits, _gram_hash(found.language_hash()[:short], [w.hash[i : i + short] for i in range(size - 1)]))
            at = np.flatnonzero(linked & good[:n] & good[1 : n + 1])
            if len(at):
                shard.add(found, at)
            if shard.rows > 2 * SHARD or shard.known.n > SHARD_WORDS:
                shard.pack()
                if shard.rows > SHARD or shard.known.n > SHARD_WORDS:
                    yield from shard.handed()
    yield from shard.handed()


def _united(table: pa.Table, least: int) -> pa.Table:
    found = union(CountTransducer.from_bytes(x) for x in table.column("data").to_pylist()).at_least(least)
    return pa.table({"part": table.column("part")[:1], "size": table.column("size")[:1], "data": pa.array([found.to_bytes()], pa.binary())})


def _unite(shards: DataFrame, least: int) -> DataFrame:
    """One transducer a part, without n-grams of fewer than least counts."""
    return written(shards.groupBy("part", "size").applyInArrow(lambda t: _united(t, least), shards.schema), "phrases")


def _of_words(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words = (column(batch, c).cast(pa.binary()) for c in ("lang", "word"))
        symbols, number = symbol_table(pa.concat_arrays([langs, words]))
        columns, counts = added_up([number[: len(langs)], number[len(langs) :]], np.asarray(column(batch, "f")), max(len(symbols), 1))
        if len(counts):
            yield from _shards(symbols, columns, counts, ranges)


def _bit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in column(batch, "data").to_pylist():
            t = CountTransducer.from_bytes(data)
            columns, _ = t.paths()
            hashes = _hashes(t.symbols)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(_gram_hash(hashes[columns[0]], [hashes[c] for c in columns[1:]]))) if len(columns[0]) else np.zeros(0, np.int64))], ["place"])


def _filter(counted: DataFrame) -> np.ndarray:
    """Bits of the n-grams of transducers; BITS of them come to the driver."""
    places = counted.select("data").mapInArrow(_bit_places, "place bigint")
    one = F.col("place") + 1  # bitmaps count from 1 on
    rows = places.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out, width = np.zeros(BITS // 8 + 4096, np.uint8), 4096
    for r in rows.collect():
        begin = (r.bucket - 1) * width
        out[begin : begin + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _asks(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """For each transducer of phrases an automaton of the parts that it needs from each part of the counts."""
    for batch in batches:
        for part, size, data in zip(*(column(batch, c).to_pylist() for c in ("part", "size", "data")), strict=True):
            t = CountTransducer.from_bytes(data)
            columns, _ = t.paths()
            if not len(columns[0]):
                continue
            for k in range(1, size):
                found = [[columns[0], *columns[i : i + k]] for i in (1, size - k + 1)]  # first parts and rests of k words
                both, _ = added_up([np.concatenate(c) for c in zip(*found, strict=True)], np.ones(2 * len(columns[0]), np.int64), len(t.symbols))
                for other, rows in ranges.split(t.symbols, both):
                    query = CountTransducer.build(t.symbols, [c[rows] for c in both], np.ones(len(rows), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([other], pa.int64()), pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([size], pa.int32()), pa.array([query.to_bytes()], pa.binary())], ["part", "size", "asker", "asker_size", "data"])


def _answers(table: pa.Table) -> pa.Table:
    """A part's answers to those that ask it: their automata with counts."""
    asker, data = table.column("asker").to_pylist(), table.column("data").to_pylist()
    counts = next(CountTransducer.from_bytes(d) for a, d in zip(asker, data, strict=True) if a is None)
    out = []
    for a, d in zip(asker, data, strict=True):
        if a is not None:
            query = CountTransducer.from_bytes(d)
            columns, _ = query.paths()
            out.append(CountTransducer.build(query.symbols, columns, query.compose(counts)).to_bytes())
    keep = pc.is_valid(table.column("asker"))
    found = table.filter(keep)
    return pa.table({"part": found.column("asker"), "size": found.column("asker_size"), "part_size": found.column("size"), "data": pa.array(out, pa.binary())})


def _scored(table: pa.Table) -> pa.Table:
    """The phrases of a part with the counts of their parts at the cut of the lowest score."""
    sizes, data = table.column("part_size").to_pylist(), table.column("data").to_pylist()
    t = next(CountTransducer.from_bytes(d) for s, d in zip(sizes, data, strict=True) if s is None)
    columns, counts = t.paths()
    n, size = len(counts), t.order - 1
    text, whole = pa.string(), pa.int64()
    if not n:
        return pa.table({"lang": pa.array([], text), "words": pa.array([], pa.list_(text)), **{c: pa.array([], whole) for c in ("a", "l", "r", "score")}})
    answers = {k: union(CountTransducer.from_bytes(d) for s, d in zip(sizes, data, strict=True) if s == k) for k in range(1, size)}

    def count_of(first: int, k: int) -> np.ndarray:
        """Counts of the phrases' words from first on, k of them."""
        own = [columns[0], *columns[first + 1 : first + 1 + k]]
        asked, _ = added_up(own, np.ones(n, np.int64), len(t.symbols))
        found = CountTransducer.build(t.symbols, asked, np.ones(len(asked[0]), np.int64)).compose(answers[k])
        return found[_place_of(own, asked, len(t.symbols))]

    a = counts.tolist()
    best: list[tuple[int, int, int]] = []
    for k in range(1, size):
        left, right = count_of(0, k).tolist(), count_of(k, size - k).tolist()
        here = [(1_000_000 * x * x // (y * z), y, z) for x, y, z in zip(a, left, right, strict=True)]
        best = [min(old, new, key=lambda s: s[0]) for old, new in zip(best, here, strict=True)] if best else here
    known = [s.decode() for s in t.symbols.to_pylist()]
    words = list(zip(*([known[i] for i in c.tolist()] for c in columns[1:]), strict=True))
    return pa.table({
        "lang": pa.array([known[i] for i in columns[0].tolist()], text), "words": pa.array(list(map(list, words)), pa.list_(text)), "a": pa.array(a, whole),
        "l": pa.array([b[1] for b in best], whole), "r": pa.array([b[2] for b in best], whole), "score": pa.array([b[0] for b in best], whole),
    })


def _place_of(rows: list[np.ndarray], table: list[np.ndarray], n_symbols: int) -> np.ndarray:
    """The place of each n-gram in a sorted table that has them all."""
    n = len(table[0])
    _, of = np.unique(np.concatenate([table[0], rows[0]]), return_inverse=True)
    for a, b in zip(table[1:], rows[1:], strict=True):
        _, of = np.unique(of * n_symbols + np.concatenate([a, b]), return_inverse=True)
    return of[n:]  # the table's own numbers are 0, 1, 2 ...


_SHARDS = "part bigint, size int, data binary"


def phrase_scores(documents: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a, l, r, score of all phrases of 2 to longest words that occur least times or more; lang, n of all words).

    documents has text and lang (null: und). l and r are the occurrences of the first words and of the rest at the cut
    with the lowest score floor(1000000 * a * a / (l * r)), the first of several.
    """
    every = written(word_counts(documents), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = every.where(F.col("f") >= least)
    n_words = every.agg(F.sum("f")).first()[0] or 0
    sc = documents.sparkSession.sparkContext
    ranges = sc.broadcast(Ranges(frequent, n_words))
    counted = [_unite(frequent.mapInArrow(lambda it: _of_words(it, ranges.value), _SHARDS), least)]
    for size in range(2, longest + 1):
        bits = sc.broadcast(_filter(counted[-1]))
        shards = documents.select("text", "lang").mapInArrow(partial(_counted_in, size=size, bits=bits, ranges=ranges), _SHARDS)
        counted.append(_unite(shards, least))
    phrases = counted[1]
    for more in counted[2:]:
        phrases = phrases.unionByName(more)
    tables = counted[0]
    for more in counted[1:-1]:
        tables = tables.unionByName(more)
    nobody = F.lit(None).cast("bigint")
    asks = phrases.mapInArrow(lambda it: _asks(it, ranges.value), "part bigint, size int, asker bigint, asker_size int, data binary")
    asked = tables.select("part", "size", nobody.alias("asker"), F.lit(None).cast("int").alias("asker_size"), "data").unionByName(asks)
    answers = asked.groupBy("part", "size").applyInArrow(_answers, "part bigint, size int, part_size int, data binary")
    whole = phrases.select("part", "size", F.lit(None).cast("int").alias("part_size"), "data").unionByName(answers)
    scored = whole.groupBy("part", "size").applyInArrow(_scored, "lang string, words array<string>, a bigint, l bigint, r bigint, score bigint")
    return written(scored, "scored"), totals


def _counted_in(batches: Iterator[pa.RecordBatch], size: int, bits, ranges) -> Iterator[pa.RecordBatch]:
    return _counted(batches, size, bits.value, ranges.value)


def collocations(documents: DataFrame, top: int = 2000, longest: int = 3, least: int = 10, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language by score, a and phrase.

    A phrase whose words lie together inside a longer one that has share percent of its occurrences or more is left out.
    documents has text and lang; null texts are empty, other columns are ignored, repeated rows count as often, an empty
    table gives none.
    """
    scored, totals = phrase_scores(documents, longest, least)
    phrase = F.concat_ws(" ", "words").alias("phrase")
    inner = []
    for size in range(3, longest + 1):
        for k in range(2, size):
            inner += [F.when(F.size("words") == size, F.slice("words", i + 1, k)) for i in range(size - k + 1)]
    kept = scored.select("lang", phrase, "a", "l", "r", "score")
    if inner:
        covers = scored.where(F.size("words") > 2).select("lang", "a", F.explode(F.array_compact(F.array(*inner))).alias("w"))
        covers = covers.groupBy("lang", F.concat_ws(" ", "w").alias("phrase")).agg(F.max("a").alias("longer"))
        kept = kept.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = (F.desc("score"), F.desc("a"), "phrase")
    salts = max(math.isqrt(scored.count() // top), 1)  # a language's first ones of each of so many parts, then of all of these
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
