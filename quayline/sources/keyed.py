"""Tables that are merged by key: only the buckets that a batch touches are written again.

Rows are dealt to buckets by a hash of their keys. A version is a small file that lists, for each bucket, the folder that
holds it; it is made under its number, which only one of several writers can do (see store.create), so a reader sees
whole versions only and of two writers one wins. A merge writes the touched buckets into folders of its own and keeps the
others' entries. A batch that was merged is not merged again, so a repeated one changes nothing; what a crash leaves
behind is in no version. Old versions can be read until vacuum() removes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass
class KeyedTable:
    """A table in a folder. The number of buckets is fixed by its first merge; choose it so that a bucket fits into a task."""

    spark: SparkSession
    folder: str
    keys: list[str]
    buckets: int = 16

    def versions(self) -> list[int]:
        if not store.exists(self.spark, f"{self.folder}/versions"):
            return []
        return [int(p.rsplit("/", 1)[1].removesuffix(".json")) for p, _, _ in store.files_below(self.spark, f"{self.folder}/versions") if p.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version, or the last one, is made of; None without any."""
        known = self.versions()
        if not known:
            return None
        number = max(known) if version is None else version
        return json.loads(store.read_text(self.spark, f"{self.folder}/versions/{number:08d}.json")) | {"version": number}

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version, or of the last one; without any version an empty table of the schema."""
        m = self.manifest(version)
        if m is None:
            return self.spark.createDataFrame([], schema)
        return self._rows(m, list(m["folders"]))

    def _rows(self, m: dict, buckets: list[str]) -> DataFrame:
        kind, paths = StructType.fromJson(m["schema"]), [m["folders"][b] for b in buckets if b in m["folders"]]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def merge(self, rows: DataFrame, batch: int) -> dict:
        """Puts rows, one for each key, in place of those of the same keys; returns the manifest of the new version.

        Batches have rising numbers: one that is not above the last merged one was merged before. Null keys are keys.
        """
        m = self.manifest()
        if m is not None and batch <= m["batch"]:
            return m
        n = m["buckets"] if m else self.buckets
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # as many as buckets at most
            new = dealt
            if m:
                old = self._rows(m, [str(b) for b in touched])
                same = None
                for k in self.keys:
                    one = F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
                    same = one if same is None else same & one
                kept = old.alias("o").join(dealt.select(*self.keys).alias("n"), same, "left_anti")
                new = dealt.unionByName(kept.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")))
            place = f"{self.folder}/data/{batch:08d}-{uuid.uuid4().hex}"
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(place)
        finally:
            dealt.unpersist()
        folders = (m["folders"] if m else {}) | {str(b): f"{place}/_bucket={b}" for b in touched}
        out = {"batch": batch, "buckets": n, "folders": folders, "schema": rows.schema.jsonValue()}
        number = m["version"] + 1 if m else 1
        if not store.create(self.spark, f"{self.folder}/versions/{number:08d}.json", json.dumps(out)):
            store.remove(self.spark, place)
            raise Conflict(f"version {number} of {self.folder} was made by another writer")
        return out | {"version": number}

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last versions, and the data that none of these has."""
        known = sorted(self.versions())
        for v in known[:-keep]:
            store.remove(self.spark, f"{self.folder}/versions/{v:08d}.json")
        used = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for batch in store.folders(self.spark, f"{self.folder}/data"):
            for bucket in store.folders(self.spark, f"{self.folder}/data/{batch}"):
                if f"{self.folder}/data/{batch}/{bucket}" not in used:
                    store.remove(self.spark, f"{self.folder}/data/{batch}/{bucket}")
