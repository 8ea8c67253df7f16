"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of each window of w k-grams, so that every shared span of k + w - 1 words
has a fingerprint that both sides keep. Fingerprints are joined, and each hit is extended word by word to both
sides within the words that travel with it; runs of at least k + w - 1 words count. Any run of that length has
a kept fingerprint within each of its windows, so the joined runs cover every word of every shared span.

Before the join, document fingerprints pass a bitmap of the benchmark's fingerprints. It has a fixed size
(2**BITS bits), lets some others through and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import arrow_map, column, cut, keyed, pieces, salted_join, same_row, small_side

#: Words of a window, words of a k-gram, and the bitmap's size as a power of two.
WINDOW, GRAM, BITS = 10, 5, 22

_CAND = "array<struct<fp:bigint,pos:int,len:int,mid:string,left:array<string>,right:array<string>>>"
_CAND_TYPE = pa.list_(pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("len", pa.int32()), ("mid", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def _fingerprints(w: tv.Words, window: int, gram: int, short: list[int], whole_items: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Hashes, positions, words and words to each side of the fingerprints: winnowed k-grams, then all spans of each short length."""
    k = min(gram, window)
    inside = tv.together(w.doc, window)
    hashes = tv.grams(w.hash, k)
    chosen = np.flatnonzero(tv.winnowed(hashes, inside, window - k + 1))
    yield hashes[chosen], chosen, k, window - k
    counts = w.counts
    for n in short:  # an item of n < window words is one window: its only span of n words
        at = np.flatnonzero(tv.together(w.doc, n))
        if whole_items:
            at = at[counts[w.doc[at]] == n]
        yield tv.mix(tv.grams(w.hash, n)[at] ^ tv.U(n)), at, n, 0


def _candidates(batch: pa.RecordBatch, keys: list[str], window: int, gram: int, short: list[int], bitmap: np.ndarray | None, whole_items: bool) -> Iterator[pa.RecordBatch]:
    """For each row its keys, its number of words and its fingerprints with up to window - gram words on each side."""
    for part in pieces(batch, "text"):
        w = tv.words(column(part, "text"), tv.ALNUM)
        found: list[list[dict]] = [[] for _ in range(part.num_rows)]
        counts, first = w.counts, w.first
        for hashes, at, n, far in _fingerprints(w, window, gram, short, whole_items):
            if bitmap is not None:
                keep = np.flatnonzero(bitmap[hashes >> tv.U(64 - BITS)])
                hashes, at = hashes[keep], at[keep]
            for fp, i, d in zip(hashes.view(np.int64).tolist(), at.tolist(), w.doc[at].tolist(), strict=True):
                a, b = first[d], first[d] + counts[d]
                found[d].append({"fp": fp, "pos": int(i - a), "len": n, "mid": w.text(i, i + n), "left": [w.text(j, j + 1) for j in range(max(a, i - far), i)], "right": [w.text(j, j + 1) for j in range(i + n, min(b, i + n + far))]})
        yield pa.RecordBatch.from_arrays([*(column(part, k) for k in keys), pa.array(counts, pa.int64()), pa.array(found, _CAND_TYPE)], [*keys, "n_words", "cand"])


def _lengths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in pieces(batch, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(tv.words(column(part, "text"), tv.ALNUM).counts, pa.int64())], ["n"])


def _agreeing(ours: Column, theirs: Column, back: bool, most: int) -> Column:
    """How many words agree from the fingerprint outwards."""
    at = (lambda c, i: F.get(c, F.size(c) - i)) if back else (lambda c, i: F.get(c, i - 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(most, 1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= most) & F.coalesce(at(ours, i) == at(theirs, i), F.lit(False)), i).otherwise(n))


def find_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per row: doc_id, _h, n_words; per run found: doc_id, _h, class, start, stop in words; class, item_id).

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts have no
    words and no runs; items without words have no windows; items of fewer than window words are one window; an item
    without id is an item, whose id is empty text. Rows with the same id and text share their runs; repeated items count once. Empty tables give empty runs.
    Places of items with the same words around the same fingerprint are one class, so that a passage of many items is
    met once; a fingerprint of many documents is dealt to several tasks.
    """
    spark = documents.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    short = sorted(r.n for r in arrow_map(items.select("text"), _lengths, "n bigint").where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())
    fps = arrow_map(items, lambda b: _candidates(b, ["item_id"], window, gram, short, None, True), f"item_id {items.schema['item_id'].dataType.simpleString()}, n_words bigint, cand {_CAND}").select("item_id", F.explode("cand").alias("c")).select("item_id", "c.fp", "c.len", "c.mid", F.col("c.left").alias("i_left"), F.col("c.right").alias("i_right"))
    words = ["fp", "len", "mid", "i_left", "i_right"]
    fps = cut(fps.distinct())
    classes = cut(fps.select(*words).distinct().withColumn("class", F.monotonically_increasing_id()))
    of_class = cut(salted_join(fps, classes, *words).select("class", "item_id"))
    bitmap = spark.sparkContext.broadcast(_bitmap(classes))
    docs = keyed(documents.select("doc_id", "text"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = cut(arrow_map(docs, lambda b: _candidates(b, ["doc_id", "_h"], window, gram, short, bitmap.value, False), f"doc_id {kind}, _h bigint, n_words bigint, cand {_CAND}"))
    ours = rows.select("doc_id", "_h", F.explode("cand").alias("c")).select("doc_id", "_h", "c.*")
    reach = window - min(gram, window)
    hits = salted_join(ours, classes, "fp", "len", "mid").withColumn("before", _agreeing(F.col("left"), F.col("i_left"), True, reach)).withColumn("after", _agreeing(F.col("right"), F.col("i_right"), False, reach))
    whole = (F.size("i_left") == 0) & (F.size("i_right") == 0) & (F.col("len") < window)
    runs = hits.where(whole | (F.col("before") + F.col("len") + F.col("after") >= window)).select("doc_id", "_h", "class", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("len") + F.col("after")).alias("stop"))
    return rows.select("doc_id", "_h", "n_words"), runs.distinct(), of_class


def _bitmap(fps: DataFrame) -> np.ndarray:
    """The bits that the benchmark's fingerprints set: at most 2**BITS / 64 rows come to the driver."""
    word = F.shiftrightunsigned("fp", 64 - BITS + 6)
    bit = F.shiftrightunsigned("fp", 64 - BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = fps.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).collect()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    for r in rows:
        bits[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents; see find_overlaps.

    n_hit counts words inside any run; items are those with runs; their ids, sorted as text and joined by commas,
    give items_sha256 (of the empty text if there are none).
    """
    rows, runs, of_class = find_overlaps(documents, benchmark, window, gram)
    runs = cut(runs)
    words = runs.select("doc_id", "_h", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).distinct().groupBy("doc_id", "_h").agg(F.count("*").alias("n_hit"))
    met = cut(runs.select("doc_id", "_h", "class").distinct().groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list("class")).alias("classes")))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    each = met.select("classes").distinct().select("classes", F.explode("classes").alias("class"))  # documents with the same classes have the same items
    lists = each.join(of_class, "class").select("classes", item).distinct().groupBy("classes").agg(F.array_sort(F.collect_list("item")).alias("items"))
    lists = cut(lists.select("classes", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    items = salted_join(met, lists, "classes").select("doc_id", "_h", "n_items", "items_sha256")
    out = rows.alias("r").join(words.alias("w"), same_row("r", "w"), "left").join(items.alias("i"), same_row("r", "i"), "left")
    n = F.coalesce("w.n_hit", F.lit(0).cast("bigint"))
    return out.select("r.doc_id", "r.n_words", n.alias("n_hit"), F.coalesce("i.n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("i.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of documents without any run, with all their columns; rows are told apart by doc_id, null or not, and text."""
    _, runs, _ = find_overlaps(documents, benchmark, window, gram)
    found = cut(runs.select("doc_id", "_h").distinct())
    rows = keyed(documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"), "doc_id", "text"), "text")
    return rows.alias("d").join(small_side(found, found.count(), 32).alias("o"), same_row("d", "o"), "left_anti").select("_row.*")
