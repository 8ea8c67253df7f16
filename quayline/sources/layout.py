"""Sorted tables whose files say what they hold, so that a look-up, a range or a page opens only the files it needs.

Rows are dealt to files by ranges of the keys and sorted inside; ids that are looked up also get Parquet bloom filters. A
list of files, with the least and greatest first key and the rows of each, lies beside them (in _files, which Spark passes
over). Equal first keys may be cut by the further ones, so no key needs a file of its own size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file.
FILE_ROWS = 1_000_000


def write_sorted(df: DataFrame, folder: str, keys: list[str], file_rows: int = FILE_ROWS, bloom: tuple[str, ...] = (), rows: int | None = None) -> None:
    """Writes df sorted by keys into a new folder; rows is its number of rows, if known. An empty table is one file."""
    n = df.count() if rows is None else rows
    files = max(-(-n // file_rows), 1)
    out = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys) if files > 1 else df.coalesce(1).sortWithinPartitions(*keys)
    writer = out.write
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(file_rows))
    writer.parquet(folder)
    spark, first = df.sparkSession, F.col(f"`{keys[0]}`")
    held = spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"))
    listed = held.agg(F.min(first).alias("low"), F.max(first).alias("high"), F.count("*").alias("rows"), F.count_if(first.isNull()).alias("nulls"), F.min(F.struct(*keys)).alias("begin"))
    listed.coalesce(1).write.parquet(f"{folder}/_files")


@dataclass
class SortedTable:
    """A table that write_sorted wrote. Its list of files is read when it is first needed."""

    spark: SparkSession
    folder: str

    @cached_property
    def files(self) -> DataFrame:
        """file, low, high, rows, nulls, begin (its first keys)."""
        return self.spark.read.parquet(f"{self.folder}/_files")

    @cached_property
    def whole(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    @cached_property
    def keys(self) -> list[str]:
        return self.files.schema["begin"].dataType.names

    def _of(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.whole.schema).parquet(*paths) if paths else self.whole.limit(0)

    def where_key(self, *values: object) -> DataFrame:
        """The rows whose first key is one of some values (none of them null)."""
        key = F.col(f"`{self.keys[0]}`")
        near = [F.lit(v).between(F.col("low"), F.col("high")) for v in values]
        hit = near[0]
        for c in near[1:]:
            hit |= c
        return self._of([r.file for r in self.files.where(hit).select("file").collect()]).where(key.isin(list(values)))

    def between(self, low: object = None, high: object = None) -> DataFrame:
        """The rows whose first key is from low up to high; an open end is None. Null keys are in no range."""
        key = F.col(f"`{self.keys[0]}`")
        keep = lambda lo, hi: (F.lit(True) if low is None else hi >= F.lit(low)) & (F.lit(True) if high is None else lo <= F.lit(high))
        paths = [r.file for r in self.files.where(keep(F.col("low"), F.col("high"))).select("file").collect()]
        return self._of(paths).where(keep(key, key) & key.isNotNull())

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page, in key order: the counts of files tell which of them have it, however far on it is."""
        start, before, paths, skip = (number - 1) * size, 0, [], 0
        for r in self.files.orderBy("begin").select("file", "rows").toLocalIterator():
            if before + r.rows > start and before < start + size:
                if not paths:
                    skip = start - before
                paths.append(r.file)
            before += r.rows
            if before >= start + size:
                break
        return self._of(paths).orderBy(*self.keys).offset(skip).limit(size)


def after(order: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Whether a row comes after a cursor, the last row's values, in an order of (column, descending) with nulls last."""
    out = F.lit(False)
    for (c, down), value in reversed(list(zip(order, cursor, strict=True))):
        at, is_null = F.col(f"`{c}`"), F.col(f"`{c}`").isNull()
        if value is None:  # nulls are last: nothing but equal ones comes after
            out = is_null & out
        else:
            v = F.lit(value)
            out = F.coalesce(at < v if down else at > v, F.lit(True)) | (F.coalesce(at == v, F.lit(False)) & out)
    return out
