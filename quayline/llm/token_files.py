"""Token ids in files: frequency-ranked, in whole bytes, with separate control bytes.

Ids are replaced by their rank in the corpus, most frequent first. A rank takes 1 to 4 bytes, little-endian; the
two-bit codes of four ranks' sizes share a control byte. A block holds the documents of one batch: their ids
(of documents), numbers of tokens, the control bytes and the data bytes. Blocks lie in Parquet files, written by
Spark's committer, so that a lost executor leaves no half shard; shards and blocks are in ascending doc_id order.
Beside them lies the table of ids by rank. Decoding looks up four sizes by control byte and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens as pt
from .common import arrow_map, column, new_folder, pieces, written

#: The id put after each document, and ids that a block holds at most, but for a longer document.
END_ID, BLOCK_IDS = 0, 1 << 20
_SIZES = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    wide = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    wide[: len(code)] = code
    control = (wide.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() was given."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[pa.RecordBatch]:
    """doc_id and the ids of its text, with the end id, as bytes."""
    for part in pieces(batch, "text"):
        enc, texts = pt.encoder(path), pc.fill_null(column(part, "text"), "").to_pylist()
        sections, of = enc.sections(texts)
        pre = pt.split(sections)
        ids, counts = enc.ids(pre)
        stop = np.cumsum(np.bincount(pre.doc, weights=counts, minlength=len(sections)).astype(np.int64))
        parts: list[list[bytes]] = [[] for _ in texts]
        for (doc, special), a, b in zip(of, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            parts[doc].append(ids[a:b].tobytes())
            if special >= 0:
                parts[doc].append(np.array([special], ids.dtype).tobytes())
        end = np.array([END_ID], ids.dtype).tobytes()
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([b"".join([*x, end]) for x in parts], pa.binary())], ["doc_id", "ids"])


def _frequencies(batch: pa.RecordBatch, width: str) -> Iterator[pa.RecordBatch]:
    n = np.bincount(np.frombuffer(b"".join(column(batch, "ids").to_pylist()), width))
    ids = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], ["id", "n"])


def _blocks(rank: np.ndarray, width: str):
    """Blocks of one sorted partition; first counts the ids of the partition before a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = block = 0
        for batch in batches:
            for part in pieces(batch, "ids", BLOCK_IDS * np.dtype(width).itemsize):
                raw = column(part, "ids").to_pylist()
                counts = np.array([len(x) // np.dtype(width).itemsize for x in raw], np.int64)
                ranks = rank[np.frombuffer(b"".join(raw), width)]
                control, data = pack(ranks)
                docs = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), column(part, "doc_id"))
                yield pa.RecordBatch.from_arrays([column(part, "shard")[:1], pa.array([block], pa.int64()), pa.array([first], pa.int64()), docs, pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "block", "first", "doc_ids", "counts", "control", "data"])
                first, block = first + int(counts.sum()), block + 1

    return run


def write_token_files(documents: DataFrame, path: str, to: str) -> None:
    """Writes documents (doc_id, text; others are ignored) as token files in the folder to, in ascending doc_id order.

    A null text is empty and has the end id alone. Null ids come first; rows that share an id lie side by side, in
    an order fixed by their ids' hash. An empty table gives a folder with an empty set of blocks. path names a byte-
    level BPE file of the tokenizers library; strings of its special tokens inside a text become those tokens.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    width = pt.Encoder(path, 1).width.str
    rows = written(arrow_map(documents.select("doc_id", "text"), lambda b: _encoded(b, path), f"doc_id {kind}, ids binary"), "token-ids")
    counted = arrow_map(rows.select("ids"), lambda b: _frequencies(b, width), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id of the vocabulary
    order = np.array([r.id for r in sorted(counted, key=lambda r: (-r.n, r.id))], np.int64)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)
    spark.createDataFrame([(order.tolist(), width)], "ids array<bigint>, width string").coalesce(1).write.parquet(f"{to}/ranks")
    placed = rows.repartitionByRange("doc_id", F.xxhash64("ids").alias("h")).sortWithinPartitions("doc_id", F.xxhash64("ids")).withColumn("shard", F.spark_partition_id())
    placed.mapInArrow(lambda it: _blocks(ranks.value, width)(it), f"shard int, block bigint, first bigint, doc_ids array<{kind}>, counts array<bigint>, control binary, data binary").write.option("compression", "zstd").parquet(f"{to}/blocks")


def _decoded(batch: pa.RecordBatch, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        docs, counts = column(row, "doc_ids").flatten(), column(row, "counts").flatten().to_numpy()
        ids = order[unpack(column(row, "control")[0].as_py(), column(row, "data")[0].as_py(), int(counts.sum()))]
        stop = np.cumsum(counts)
        out = [ids[a:b].tobytes() for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True)]
        shard = pa.array(np.full(len(counts), column(row, "shard")[0].as_py(), np.int32))
        first = pa.array(stop - counts + column(row, "first")[0].as_py())
        yield pa.RecordBatch.from_arrays([docs, shard, first, pa.array(counts), pa.array(out, pa.binary())], ["doc_id", "shard", "first", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (bytes of little-endian unsigned 32-bit) of each document."""
    head = spark.read.parquet(f"{folder}/ranks").head()
    order = spark.sparkContext.broadcast(np.array(head.ids, "<u4"))
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = sorted((r.shard, r.n) for r in blocks.select("shard", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row a shard
    before, base = [], 0
    for shard, n in totals:
        before.append((shard, base))
        base += n
    bases = spark.createDataFrame(before, "s int, base bigint")
    docs = blocks.mapInArrow(lambda it: (x for b in it for x in _decoded(b, order.value)), f"doc_id {kind}, shard int, first bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(bases), F.col("shard") == F.col("s")).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def token_digest(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from token files in the shared folder."""
    spark = documents.sparkSession
    folder = new_folder(spark, "token-files")
    write_token_files(documents, path, folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
