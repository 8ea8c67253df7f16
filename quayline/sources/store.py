"""Small files in any store that Spark reads: texts that are replaced in one step, folders that are listed or removed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    where, files = _place(spark, path)
    files.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    where, files = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory())


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file was last changed, in milliseconds; None if it is missing."""
    where, files = _place(spark, path)
    return files.getFileStatus(where).getModificationTime() if files.exists(where) else None


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; raises FileNotFoundError if it is missing."""
    where, files = _place(spark, path)
    if not files.exists(where):
        raise FileNotFoundError(str(path))
    return spark.read.text(where.toString(), wholetext=True).head().value


def _write(files, where, text: str, over: bool) -> None:
    out = files.create(where, over)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _moved(spark: SparkSession, where, files, text: str, over: bool) -> None:
    """Writes a small file beside its place and moves it there in one step; whether over what was there, Hadoop sees to."""
    jvm = spark._jvm
    new = jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{where.getName()}.{uuid.uuid4().hex}")
    _write(files, new, text, True)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if over else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    full = files.makeQualified(where)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(new), full, how)
    finally:
        files.delete(new, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there in one step, over what was there."""
    _moved(spark, *_place(spark, path), text, True)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small report, with sorted keys, replaced in one step."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str))


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


#: File systems on which a file appears when it is opened, not when it is whole, but is renamed in one step.
_RENAMED = ("file", "hdfs", "viewfs")


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not be there yet and that appears whole; of several writers at once one gets True.

    By a rename that replaces nothing on HDFS and local disks, by a put that replaces nothing on object stores that have it.
    """
    from py4j.protocol import Py4JJavaError

    where, files = _place(spark, path)
    if files.exists(where):
        return False
    try:
        if files.getUri().getScheme() in _RENAMED:
            files.mkdirs(where.getParent())
            _moved(spark, where, files, text, False)
        else:
            _write(files, where, text, False)
        return True
    except Py4JJavaError:
        if files.exists(where):
            return False
        raise


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of a file, or of all files in a folder and below, in text order."""
    where, files = _place(spark, path)
    out, found = [], files.listFiles(where, True)
    while found.hasNext():
        one = found.next()
        out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(out)
