"""Rows of a stream told apart: kept, replays of earlier ones, and late ones, which otherwise vanish behind a watermark.

For each value of a column (a port, a type) the state holds the greatest time of the batches before, and the keys of
rows that may still come again, with their times. A row is late if its time is more than lateness before that greatest
time; a replay if its key is known, or was in the same batch already; kept if not. Kept rows before the greatest time are
out of order. Keys are forgotten once rows of their time would be late, so a value's state is what came within lateness.
The rows of a value are dealt to BUCKETS by their keys, so a stream of few values is not told apart by as few tasks. Each
bucket has the greatest time for itself: every task that reads a batch sends the greatest time it saw of a value to all
buckets of that value. Known keys lie in CHUNKS a bucket, read and written whole, not one by one.
Neither Spark's own watermark is used, which would drop the late rows, nor timers by the clock, with which a run over all
there is now would never end: a value for which nothing comes any more keeps its last keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICTS = ("kept", "replay", "late")
BUCKETS, CHUNKS = 32, 64


def _told_to_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, and after them for each value a row for every bucket (a copy of some row, marked) with its greatest time."""
    top: dict[str, tuple[int, pa.RecordBatch]] = {}
    for batch in batches:
        for by, us in zip(*pa.table({"b": batch["_by"], "u": batch["_us"]}).group_by("b").aggregate([("u", "max")]).to_pydict().values(), strict=True):
            if by not in top or us > top[by][0]:
                top[by] = (us, top[by][1] if by in top else batch.slice(pc.index(batch["_by"], by).as_py(), 1))
        yield batch
    for us, row in top.values():
        new = {"_us": pa.array([us] * BUCKETS, pa.int64()), "_part": pa.array(range(BUCKETS), pa.int32()), "_marker": pa.array([True] * BUCKETS)}
        copies = row.take(pa.array([0] * BUCKETS))
        yield pa.RecordBatch.from_arrays([new.get(n, copies[n]) for n in copies.schema.names], schema=copies.schema)


class _Sorter(StatefulProcessor):
    """Times are whole microseconds here: _us of rows."""

    def __init__(self, lateness: timedelta, columns: list[str]) -> None:
        self.lateness, self.columns = int(lateness.total_seconds() * 1_000_000), columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.greatest = handle.getValueState("greatest", StructType([StructField("us", LongType())]))
        self.known = handle.getMapState("known", StructType([StructField("chunk", IntegerType())]), StructType([StructField("keys", BinaryType()), StructField("us", BinaryType())]))

    @staticmethod
    def _read(value: tuple[bytes, bytes]) -> dict[bytes, int]:
        keys = bytes(value[0])
        return dict(zip((keys[i : i + 16] for i in range(0, len(keys), 16)), np.frombuffer(value[1], "<i8").tolist(), strict=True))

    def _write(self, chunk: int, held: dict[bytes, int]) -> None:
        if held:
            self.known.updateValue((chunk,), (b"".join(held), np.array(list(held.values()), "<i8").tobytes()))
        elif self.known.containsKey((chunk,)):
            self.known.removeKey((chunk,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self.greatest.get()[0] if self.greatest.exists() else None
        new, chunks, changed = top, {}, set()
        n = len(self.columns)  # Spark doesn't keep all names
        for part in rows:
            verdicts, order = [], []
            new = max([int(part.iloc[:, n + 1].max()), *([] if new is None else [new])])
            part = part[~part.iloc[:, n + 4].astype(bool)]
            for event, us in zip(part.iloc[:, n].tolist(), part.iloc[:, n + 1].tolist(), strict=True):
                late = top is not None and us < top - self.lateness
                again = False
                if not late:
                    event = bytes(event)
                    c = event[0] % CHUNKS
                    if c not in chunks:
                        chunks[c] = self._read(self.known.getValue((c,))) if self.known.containsKey((c,)) else {}
                    again = event in chunks[c]
                    if not again:
                        chunks[c][event] = us
                        changed.add(c)
                verdicts.append("late" if late else "replay" if again else "kept")
                order.append(top is not None and us < top)
            if len(part):
                yield part.iloc[:, :n].set_axis(self.columns, axis=1).assign(verdict=verdicts, out_of_order=order)
        if new is None:
            return
        self.greatest.update((new,))
        if top is not None and new > top:  # forget keys whose time would be late
            for c in range(CHUNKS):
                if c not in chunks and self.known.containsKey((c,)):
                    chunks[c] = self._read(self.known.getValue((c,)))
                old = [k for k, us in chunks.get(c, {}).items() if us < new - self.lateness]
                for k in old:
                    del chunks[c][k]
                if old:
                    changed.add(c)
        for c in changed:
            self._write(c, chunks[c])

    def close(self) -> None:
        pass


def sorted_out(events: DataFrame, by: str, content: tuple[str, ...], time: str = "ts", lateness: timedelta = timedelta(days=1)) -> DataFrame:
    """The rows of a stream with verdict (kept, replay or late) and out_of_order; each delivered row comes back once.

    content names the columns by whose values a row is known again. A null time is never late; a null value of by is one
    more value. Rows of one batch are held against the batches before it, whatever their order.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    key = F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in content))))
    rows = events.withColumns({"_key": key, "_us": F.coalesce(F.unix_micros(time), F.lit(0)), "_by": F.coalesce(F.col(by).cast("string"), F.lit("\\N"))})
    rows = rows.withColumns({"_part": F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int"), "_marker": F.lit(False)})
    rows = rows.mapInArrow(_told_to_all, StructType([*events.schema.fields, StructField("_key", BinaryType()), StructField("_us", LongType()), StructField("_by", StringType()), StructField("_part", IntegerType()), StructField("_marker", BooleanType())]))
    kind = StructType([*events.schema.fields, StructField("verdict", StringType()), *StructType.fromDDL("out_of_order boolean").fields])
    return rows.groupBy("_by", "_part").transformWithStateInPandas(statefulProcessor=_Sorter(lateness, events.columns), outputStructType=kind, outputMode="Append", timeMode="None")


def sides(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows to folders by verdict and batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("verdict").parquet(f"{folder}/batch={number}")

    return write


def read_sides(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that sides wrote, with batch and verdict."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
