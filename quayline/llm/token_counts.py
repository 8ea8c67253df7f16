"""Token counts by a two-tier look-up on the map side, without a shuffle of pre-tokens.

Tier one is a compact hash table, broadcast once, of frequent pre-tokens and their numbers of tokens. All documents
are counted for it: each task keeps the counts of its pre-tokens in its worker and hands on those of its TASK_TOP most
frequent ones, of which the FREQUENT most frequent ones in all make the table. What it misses goes through a cache in
each Python worker, which encodes a pre-token with the tokenizers library when it first sees it. Both compare the
pre-tokens' bytes, so no hash decides a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as pt
from . import textvec as tv
from .common import arrow_map, column, pieces

#: Pre-tokens that a task hands on, and that tier one holds, at most; both only save time.
TASK_TOP, FREQUENT = 4096, 65_536


def _texts(part: pa.RecordBatch) -> list[str]:
    return pc.fill_null(column(part, "text"), "").to_pylist()


def _top(enc: pt.Encoder, n: np.ndarray) -> pa.RecordBatch:
    """The most frequent pre-tokens of a worker's numbers n of them."""
    some = np.flatnonzero(n > 1)
    if len(some) > TASK_TOP:
        some = some[np.argpartition(-n[some], TASK_TOP)[:TASK_TOP]]
    start, end = enc.known.span(some)
    data = [enc.known.data[a:z].tobytes() for a, z in zip(start.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(enc.count[some]), pa.array(n[some])], ["word", "tokens", "n"])


def _fit(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc, n = pt.encoder(path), np.zeros(0, np.int64)
    for batch in batches:
        for part in pieces(batch, "text"):
            if enc.full:
                yield _top(enc, n)
                n = n[:0]
            pre = pt.split(enc.sections(_texts(part))[0])
            found = np.bincount(enc.entries(pre, np.arange(len(pre.hash))), minlength=len(n))
            found[: len(n)] += n
            n = found
    yield _top(enc, n)


@dataclass
class Tier:
    """Numbers of tokens by pre-token."""

    known: tv.Interner
    tokens: np.ndarray


def frequent(documents: DataFrame, path: str) -> Tier:
    """Tier one; at most FREQUENT rows come to the driver."""
    found = documents.select("text").mapInArrow(lambda it: _fit(it, path), "word binary, tokens bigint, n bigint").groupBy("word").agg(F.first("tokens").alias("tokens"), F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    data = np.frombuffer(b"".join(r.word for r in found), np.uint8)
    size = np.array([len(r.word) for r in found], np.int64)
    end = np.cumsum(size)
    known = tv.Interner(18)
    order, _ = known.number(data, end - size, end, tv.span_hash(data, end - size, end))
    tokens = np.zeros(len(found), np.int64)
    tokens[order] = [r.tokens for r in found]
    return Tier(known, tokens)


def _counted(batch: pa.RecordBatch, path: str, tier: Tier, limit: int) -> Iterator[pa.RecordBatch]:
    for part in pieces(batch, "text"):
        enc, texts = pt.encoder(path), _texts(part)
        sections, of = enc.sections(texts)
        pre = pt.split(sections)
        found = tier.known.find(pre.data, pre.start, pre.end, pre.hash)
        tokens = tier.tokens[found] if len(tier.tokens) else np.zeros(len(found), np.int64)
        missed = np.flatnonzero(found < 0)
        own = enc.entries(pre, missed)  # before enc.count is looked at: new entries may move it
        tokens[missed] = enc.count[own]
        doc = np.array([i for i, _ in of], np.int64)
        n = np.bincount(doc[pre.doc], weights=tokens, minlength=len(texts)).astype(np.int64)
        n += np.bincount(doc, weights=[s >= 0 for _, s in of], minlength=len(texts)).astype(np.int64)
        size = pc.fill_null(pc.binary_length(column(part, "text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents (doc_id, text; other columns are ignored).

    path names a byte-level BPE file of the tokenizers library with the pattern of pretokens. Strings of its special
    tokens inside a text count as those tokens. Null counts as empty, with no tokens. Rows come back one for one.
    """
    tier = documents.sparkSession.sparkContext.broadcast(frequent(documents, path))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), lambda b: _counted(b, path, tier.value, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
