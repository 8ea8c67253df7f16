"""Reading tables, the shared folder and Arrow batches, for all operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy code handles at once. Spark bounds the Arrow batches themselves (spark.sql.execution.arrow.maxBytesPerBatch).
CHUNK_BYTES = 2_000_000
#: Bytes up to which a side of a join, its rows counted first, is broadcast; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 8_000_000
#: A join key is heavy if it has more than one part in so many of a shuffle partition's rows.
HEAVY = 4

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was given as checkpoint folder.

    Where neither is set, a local master (tests) gets a folder of its own; on a cluster there is none to fall back to.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    own = sc._jsc.sc().getCheckpointDir()
    if conf is None and own.isDefined():
        return own.get().rstrip("/")
    if conf is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if own.isEmpty():
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-"))
    return (conf or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, so that they are computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; release() removes it, of a session all by release(spark, written_since(0))."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The same rows after a round through Parquet files in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_since(n: int) -> list[str]:
    """The folders written after the first n."""
    return _written[n:]


def n_written() -> int:
    return len(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that were written for a query's own use. Frames that still read them can't be used any more."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [p for p in _written if p not in set(paths)]


def small_side(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """df with a broadcast hint if its counted rows, of about width bytes each, are within the bound; as it is otherwise."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def salted_join(rows: DataFrame, side: DataFrame, *keys: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with side on keys, where some keys may have a large share of all rows.

    A key is heavy if it has more than a HEAVY-th of a shuffle partition's even share of rows: there are at most HEAVY
    times the partitions of them, so they are broadcast. Their rows are dealt to several tasks by a salt, and side's rows
    of these keys go to each; all other rows are joined as they are. Null keys meet nothing. counted is a cheaper frame,
    with some of rows' columns, that has its keys as often.
    """
    spark, counted = rows.sparkSession, rows if counted is None else counted
    share = max(counted.count() // (HEAVY * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    heavy = cut(counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > share).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
    if heavy.isEmpty():
        return rows.join(side, list(keys))
    same = lambda: reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)])
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(F.col(c) for c in counted.columns)), F.col("_salts")).cast("int"))
    ours = rows.join(F.broadcast(heavy), same(), "left").select(*rows.columns, salt.alias("_salt"))
    theirs = side.join(F.broadcast(heavy), same(), "left").select(*side.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    return ours.join(theirs, [*keys, "_salt"]).drop("_salt")


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """df with _h, a hash of its columns: with doc_id it tells apart rows that share an id."""
    return df.withColumn("_h", F.xxhash64(*columns))


def same_row(a: str, b: str) -> Column:
    """Null-safe equality of two keyed frames' rows, by their aliases."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
            batch = None
        tidy()

    return df.mapInArrow(mapped, schema)


def tidy() -> None:
    """Gives memory that a worker has freed back to the machine: workers live on, idle or with another operator's task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most bytes of text each; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column(batch, text)), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of consecutive runs of values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def unsigned(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed longs that Spark has."""
    return values.view(np.int64)
