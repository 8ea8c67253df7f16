"""The event feed as a stream: replays dropped, daily activity by port or type, checks and quarantine on the side, upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import truth
from ..sources.keyed import KeyedTable
from ..sources.scratch import shared_folder

CONTENT = ("event_id", "ts", "user_id", "event_type", "value", "props")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its time becomes a timestamp, since watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def with_replays(events: DataFrame, every: int = 7) -> DataFrame:
    """A feed that delivers at least once: rows whose event_id is a multiple of every come twice, of its square three times."""
    copies = F.when(F.col("event_id") % (every * every) == 0, 3).when(F.col("event_id") % every == 0, 2).otherwise(1)
    return events.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def once(events: DataFrame, content: tuple[str, ...] = CONTENT, lateness: str = "1 day") -> DataFrame:
    """Events without replays: a key is the hash of a row's content, never its id; keys are forgotten after lateness."""
    key = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in content)))
    return events.withColumn("event_key", key).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_key"])


def daily(events: DataFrame, by: str = "event_type", lateness: str = "1 day", content: tuple[str, ...] = CONTENT) -> DataFrame:
    """Events by day and type (or port, with by), without replays."""
    return once(events, content, lateness).groupBy(F.window("ts", "1 day").alias("w"), by).agg(F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "error").alias("error_count"))


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a stream that appends its finished windows to a folder as Parquet, over all there is now.

    A window is written once the watermark has passed its end, and its state is dropped then; those still open stay in the
    checkpoint, for the next run to go on with.
    """
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over all there is now and returns all its windows, open ones too: each batch upserts its changes into a folder by key.

    The folders lie in spark.checkpoint.dir, or in the machine's own temp folder for a local master without it.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    keys = [c for c in stream.columns if not c.endswith("_count")]
    query = stream.writeStream.outputMode("update").foreachBatch(upsert_batch(f"{folder}/table", keys)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark, f"{folder}/table", stream)


def upsert_batch(folder: str, keys: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into a KeyedTable: the newest version of a key replaces older ones.

    Only buckets that the batch touches are written; a batch that is repeated after a failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, folder, keys, buckets)
        table.merge(batch, number)
        table.vacuum()

    return write


def latest(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The last version of an upserted table; without any, no rows."""
    return KeyedTable(spark, folder, []).read(schema=like.schema)


def split_batch(valid_to: str, quarantine_to: str, reason: Column, checks: dict[str, Column] | None = None, counts_to: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows without a reason go to one folder, the others to another, and what checks hit to a third.

    Folders are by batch, so that a repeated batch replaces itself. checks are masks by name; each batch adds one row for
    each: batch, check, rows_total, rows_affected.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("quarantine_reason", reason).persist()
        try:
            batch.where("quarantine_reason IS NULL").drop("quarantine_reason").write.mode("overwrite").parquet(f"{valid_to}/batch={number}")
            batch.where("quarantine_reason IS NOT NULL").write.mode("overwrite").parquet(f"{quarantine_to}/batch={number}")
            if checks and counts_to:
                one = batch.agg(F.count("*").alias("n"), *(F.count_if(truth(c)).alias(f"c{i}") for i, c in enumerate(checks.values())))
                each = [one.select(F.lit(name).alias("check"), F.col("n").alias("rows_total"), F.col(f"c{i}").alias("rows_affected")) for i, name in enumerate(checks)]
                reduce(DataFrame.unionByName, each).coalesce(1).write.mode("overwrite").parquet(f"{counts_to}/batch={number}")
        finally:
            batch.unpersist()

    return write
