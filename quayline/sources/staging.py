"""Staged tables that queries share: written once for the same inputs and code, reused, and removed when inputs change.

A staged set of tables is a folder below the shared one. Its key is a hash of the input files (paths, sizes, times of
change) and of the code that makes the tables. Each writer writes a folder of its own and then makes a small file under
the key, which only one of several can: that names the folder that all readers use. Folders of other keys for the same
inputs are stale and go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import store
from .scratch import shared_folder


def inputs_key(spark: SparkSession, inputs: list[str]) -> str:
    """A hash of the input files as they are now: of their paths, sizes and times of change."""
    return hashlib.sha256(repr([store.files_below(spark, p) for p in inputs]).encode()).hexdigest()


def code_key(*modules: object) -> str:
    """A hash of modules' source files."""
    return hashlib.sha256(b"\0".join(Path(m.__file__).read_bytes() for m in modules)).hexdigest()


def staged(spark: SparkSession, name: str, inputs: list[str], code: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that make() returns, from files: written if nobody has done so for these inputs and this code."""
    key = hashlib.sha256(f"{inputs_key(spark, inputs)} {code}".encode()).hexdigest()[:32]
    home = f"{shared_folder(spark)}/staged/{name}-{hashlib.sha256(repr(inputs).encode()).hexdigest()[:16]}"
    mark = f"{home}/{key}.txt"
    if store.exists(spark, mark) and not store.exists(spark, store.read_text(spark, mark)):  # somebody cleared the folder
        store.remove(spark, mark)
    if not store.exists(spark, mark):
        place = f"{home}/{key}-{uuid.uuid4().hex}"
        for table, df in make().items():
            df.write.parquet(f"{place}/{table}")
        if store.create(spark, mark, place):
            _remove_stale(spark, home, key)
        else:
            store.remove(spark, place)
    place = store.read_text(spark, mark)
    return {t: spark.read.parquet(f"{place}/{t}") for t in store.folders(spark, place)}


def _remove_stale(spark: SparkSession, home: str, key: str) -> None:
    """Removes what was staged for other states of the same inputs. Frames that still read it can't be used any more."""
    for path, _, _ in store.files_below(spark, home):
        if path.endswith(".txt") and not path.endswith(f"/{key}.txt"):
            old = store.read_text(spark, path)
            store.remove(spark, path)
            store.remove(spark, old)
