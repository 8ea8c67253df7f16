"""Reading raw CSV files as text with lineage, runs that become current all at once, and logs of interactions."""

from __future__ import annotations

import fcntl
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import domain as D
from ..operators.curation import Raw
from ..operators.fingerprint import fingerprint
from . import store

FILES = {"shipments": D.SHIPMENT_COLUMNS, "port_events": D.EVENT_COLUMNS, "ports": D.PORT_COLUMNS}


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text (empty is null) with _row_number from 1 on, by file, then place.

    A split of a file is read by one task, so a row's place in it is its number less the split's least; the rows of all
    earlier splits come from a table of one row a split.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    rows = rows.select("*", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_least", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(splits, ["_file", "_block"]).select(*columns, (F.col("_start") + F.col("_id") - F.col("_least") + 1).alias("_row_number"))


def read_raw(spark: SparkSession, folder: str | Path) -> tuple[Raw, dict[str, str]]:
    """The three raw tables of a folder with lineage columns, and the fingerprints of their rows; missing files stop it first."""
    paths = {n: f"{str(folder).rstrip('/')}/{n}.csv" for n in FILES}
    if missing := [p for p in paths.values() if not store.exists(spark, p)]:
        raise FileNotFoundError(f"missing inputs: {missing}")
    now = datetime.now(UTC).replace(tzinfo=None)
    texts = {n: read_csv(spark, p, FILES[n]) for n, p in paths.items()}
    sums = {f"{n}.csv": fingerprint(df) for n, df in texts.items()}
    tables = {n: df.withColumns({"_source_file": F.lit(f"{n}.csv"), "_source_sha256": F.lit(sums[f"{n}.csv"]), "_ingested_at": F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")}) for n, df in texts.items()}
    return Raw(**tables), sums


def new_run(root: str | Path) -> tuple[str, str]:
    """The name and folder of a run; nothing points at it yet."""
    run = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    return run, f"{str(root).rstrip('/')}/run={run}"


class PublishConflict(RuntimeError):
    """Another run was published since the version that this one builds on."""


def versions(spark: SparkSession, root: str | Path) -> list[int]:
    """The numbers of published versions, in order."""
    folder = f"{root}/versions"
    names = [p.rsplit("/", 1)[1] for p, _, _ in store.files_below(spark, folder)] if store.exists(spark, folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def publish(spark: SparkSession, root: str | Path, run: str, after: int | None = None) -> int:
    """Makes a run the current one: a small file under the next version's number, which only one publisher can make.

    With after, the version that the publisher builds on (0 for none), it raises PublishConflict if there is a newer one;
    else it takes the next free number. Readers see the run before or this one, on any store that store.create works on.
    """
    while True:
        number = (versions(spark, root) or [0])[-1] + 1
        if after is not None and number != after + 1:
            raise PublishConflict(f"version {number - 1} was published after {after}")
        if store.create(spark, f"{root}/versions/{number:08d}", run):
            return number


def current_run(spark: SparkSession, root: str | Path) -> str:
    """The run of the last version; raises FileNotFoundError if none was published."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing is published in {root}")
    return store.read_text(spark, f"{root}/versions/{known[-1]:08d}").strip()


def current(spark: SparkSession, root: str | Path) -> dict[str, DataFrame]:
    """The tables of the current run."""
    folder = f"{root}/run={current_run(spark, root)}"
    return {name: spark.read.parquet(f"{folder}/{name}") for name in store.folders(spark, folder) if not name.startswith("_")}


class Reports:
    """Reads a report, and reads it again only when its file has changed; a missing or broken one is None."""

    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        self.spark, self.path, self._at, self._value = spark, str(path), None, None

    def get(self) -> dict | None:
        at = store.modified(self.spark, self.path)
        if at is None or at != self._at:
            try:
                self._value = None if at is None else store.read_json(self.spark, self.path)
            except ValueError:
                self._value = None
            self._at = at
        return self._value


def append_jsonl(record: dict, folder: str | Path) -> Path:
    """Appends a record to the local log of the current UTC day, one writer at a time."""
    path = Path(folder) / f"{datetime.now(UTC):%Y-%m-%d}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(json.dumps(record | {"ts": datetime.now(UTC).isoformat()}, sort_keys=True) + "\n")
    return path


def read_log(spark: SparkSession, folder: str | Path) -> DataFrame:
    """All records of a log's folder."""
    return spark.read.json(f"{folder}/*.jsonl")
