r"""Line deduplication by winnowing over line hashes.

Lines are the parts of a text between \n that hold a word; blank lines are passed over. A run of consecutive lines
qualifies if it has LINES lines or WORDS words. Every line inside any qualifying run that occurred earlier (by doc_id,
then place) is deleted.

Each line has a 128-bit BLAKE2 digest of its bytes; the first half is its hash. Fingerprints are the minima of all
windows of two line hashes, and every line of WORDS words: each qualifying run holds one. Fingerprints that occur once
are done with. Around each position of the others the text is extended both ways, line by line, to the shortest
qualifying runs that hold the fingerprint, from each line on and up to each line. Positions of equal runs, told by the
digests of their lines, are joined with the first of them. Joined positions that go on from one another are one
repeated run; all its lines go. Whatever qualifying run occurred earlier is covered: runs from a line on cover it from
its left end, runs up to a line what is left at its right end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import textvec as tv
from .common import arrow_map, column, keyed, pieces, ragged, salted_join, same_row, small_side, written

LINES, WORDS = 3, 50
DIGEST = 16


def _lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each text the digests (one after the other), numbers of words and places of its lines with words."""
    for part in pieces(batch, "text"):
        texts = column(part, "text")
        w = tv.words(texts, tv.SPACED_EXACT)
        _, at = tv.bytes_of(texts)
        breaks = np.flatnonzero(w.data == 10)
        start, end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
        per = 1 + np.diff(np.searchsorted(breaks, at))
        place = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
        n = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
        full = np.flatnonzero(n)
        counts = np.bincount(np.repeat(np.arange(len(per)), per)[full], minlength=len(per))
        data = w.data.tobytes()
        digests = [hashlib.blake2b(data[a:z], digest_size=DIGEST).digest() for a, z in zip(start[full].tolist(), end[full].tolist(), strict=True)]
        stop = np.cumsum(counts)
        joined = [b"".join(digests[a:z]) for a, z in zip((stop - counts).tolist(), stop.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "_h"), pa.array(joined, pa.binary()), ragged(n[full].astype(np.int32), counts, pa.int32()), ragged(place[full].astype(np.int32), counts, pa.int32())], ["doc_id", "_h", "digests", "words", "places"])


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False)


def _owners(batch: pa.RecordBatch, name: str = "words") -> np.ndarray:
    """For each entry of a list column its row."""
    sizes = column(batch, name).value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(batch.num_rows), sizes)


def _fingerprints(batch: pa.RecordBatch, words: int) -> Iterator[pa.RecordBatch]:
    hashes = np.frombuffer(b"".join(column(batch, "digests").to_pylist()), "<u8")[:: DIGEST // 8].astype(tv.U)
    n, doc = _flat(batch, "words"), _owners(batch)
    chosen = tv.winnowed(hashes, tv.together(doc, 2), 2) | (n >= words)
    at = np.flatnonzero(chosen)
    first = np.searchsorted(doc, np.arange(batch.num_rows))
    of = pa.array(doc[at])
    yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), column(batch, "doc_id").take(of), column(batch, "_h").take(of), pa.array((at - first[doc[at]]).astype(np.int32))], ["fp", "doc_id", "_h", "line"])


def _runs(batch: pa.RecordBatch, lines: int, words: int) -> Iterator[pa.RecordBatch]:
    """The shortest qualifying runs from each line on and up to each line that hold a line of hits."""
    data = b"".join(column(batch, "digests").to_pylist())
    n, doc, places = _flat(batch, "words").astype(np.int64), _owners(batch), _flat(batch, "places")
    m = len(n)
    first = np.searchsorted(doc, np.arange(batch.num_rows))
    hit = np.zeros(m, np.int64)
    hit[first[_owners(batch, "hits")] + _flat(batch, "hits")] = 1
    upto, hits = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(hit)])
    begun, ended, found = np.zeros(m, bool), np.zeros(m, bool), [np.zeros((0, 2), np.int64)]
    for size in range(1, min(lines, m) + 1):
        i = np.arange(m - size + 1)
        enough = tv.together(doc, size) & ((upto[i + size] - upto[i] >= words) | (size == lines))
        got = np.flatnonzero(enough & ~(begun[i] & ended[i + size - 1]))
        found.append(np.stack([got, np.full(len(got), size)], axis=1))
        begun[i] |= enough
        ended[i + size - 1] |= enough
    at, length = np.concatenate(found).T
    near = hits[at + length] > hits[at]
    at, length = at[near], length[near]
    key = [data[DIGEST * a : DIGEST * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
    of = pa.array(doc[at])
    covered = ragged(places[tv.spread(at, length)], length, pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), column(batch, "doc_id").take(of), column(batch, "_h").take(of), pa.array((at - first[doc[at]]).astype(np.int32)), covered], ["key", "doc_id", "_h", "line", "covered"])


def _repeats(documents: DataFrame, lines: int, words: int) -> DataFrame:
    """doc_id, _h, line, covered of each shortest qualifying run that occurred earlier, with first: where it did so first."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = keyed(documents.select("doc_id", "text"), "text")
    rows = written(arrow_map(docs, _lines, f"doc_id {kind}, _h bigint, digests binary, words array<int>, places array<int>"), "lines")
    prints = written(arrow_map(rows.where(F.size("words") > 0), lambda b: _fingerprints(b, words), f"fp bigint, doc_id {kind}, _h bigint, line int").distinct(), "prints")
    again = prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    hits = salted_join(prints, again, "fp").groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set("line")).alias("hits"))
    near = rows.alias("r").join(hits.alias("x"), same_row("r", "x")).select("r.*", "x.hits").dropDuplicates(["doc_id", "_h"])
    runs = written(arrow_map(near, lambda b: _runs(b, lines, words), f"key binary, doc_id {kind}, _h bigint, line int, covered array<int>"), "runs")
    where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h", "line")
    first = runs.groupBy("key").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return salted_join(runs, first, "key").where(where != F.col("first"))


def repeated_lines(documents: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """doc_id, _h (of the text), gone: the places of the lines to delete, for each text that has any.

    Null texts and texts without words have no lines. Rows with the same doc_id and text are one document. Null ids
    come after all others. Runs are equal if the 128-bit digests of all their lines are.
    """
    return _repeats(documents, lines, words).select("doc_id", "_h", F.explode("covered").alias("place")).distinct().groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list("place")).alias("gone"))


def repeated_runs(documents: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """doc_id, _h, start, stop (places of lines, stop not included), from_doc, from_line: the repeated runs and where they are from.

    Joined positions on one diagonal (the same two texts, the same distance) that touch or overlap make one run, as long as
    both texts agree. from_line counts lines with words. A run that is from several texts is told once for each of them.
    """
    found = _repeats(documents, lines, words).select("doc_id", "_h", F.col("first.doc_id").alias("from_doc"), F.col("first._h").alias("from_h"), (F.col("line") - F.col("first.line")).alias("shift"), "line", F.size("covered").alias("n"), F.element_at("covered", 1).alias("start"), (F.element_at("covered", -1) + 1).alias("stop"))
    diagonal = found.distinct().groupBy("doc_id", "_h", "from_doc", "from_h", "shift").agg(F.array_sort(F.collect_list(F.struct("line", "n", "start", "stop"))).alias("parts"))
    empty = F.array().cast("array<struct<line:int,end:int,start:int,stop:int>>")

    def add(runs: Column, p: Column) -> Column:
        last = F.element_at(runs, -1)
        new = F.struct(p["line"].alias("line"), (p["line"] + p["n"]).alias("end"), p["start"].alias("start"), p["stop"].alias("stop"))
        longer = F.struct(last["line"].alias("line"), F.greatest(last["end"], p["line"] + p["n"]).alias("end"), last["start"].alias("start"), F.greatest(last["stop"], p["stop"]).alias("stop"))
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["end"] >= p["line"]), F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(new)))

    runs = diagonal.select("doc_id", "_h", "from_doc", "shift", F.explode(F.aggregate("parts", empty, add)).alias("r"))
    return runs.select("doc_id", "_h", "r.start", "r.stop", "from_doc", (F.col("r.line") - F.col("shift")).alias("from_line"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(text: str | None, places: np.ndarray | None) -> str | None:
        if text is None or places is None:
            return text
        out = set(places.tolist())
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)

    return pd.Series([cut(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def shortened(documents: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """row, n_lines, n_removed: all columns of documents in a struct, with text without later repeated runs, and its lines' numbers.

    Every row stays, with an empty text if all its lines went; a null text stays null, with no lines. An n_chars
    column, if there is one, follows the new text. Columns may have any names. An empty table stays empty. See
    repeated_lines.
    """
    gone = written(repeated_lines(documents, lines, words), "repeated")
    rows = keyed(documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"), "doc_id", "text"), "text").alias("d")
    size = gone.agg(F.count("*").alias("n"), F.avg(F.size("gone")).alias("w")).head()
    out = rows.join(small_side(gone, size.n, 64 + int(4 * (size.w or 0))).alias("g"), same_row("d", "g"), "left")
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(_without(F.when(F.col("g.gone").isNotNull(), F.col("d.text")), F.col("g.gone")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    columns = [new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in documents.columns]
    counts = out.select("_row", text.alias("_text"), F.coalesce(F.size(F.split("d.text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("g.gone"), F.lit(0)).cast("bigint").alias("n_removed"))
    return counts.select(F.struct(*columns).alias("row"), "n_lines", "n_removed")


def dedup_lines(documents: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """documents with all their columns, as shortened has them, and _n_lines and _n_removed in place of any columns of these names."""
    out = shortened(documents, lines, words)
    kept = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in ("_n_lines", "_n_removed")]
    return out.select(*kept, F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))
