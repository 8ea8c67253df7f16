"""What a query writes for its own use: frames cut off from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that the context was given; a local folder only where the master is local and nothing is set."""
    sc = spark.sparkContext
    conf, own = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if conf is None and own.isEmpty() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if own.isEmpty():
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-"))
    return (conf or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and checkpointed, so that lost executors lose none of them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written as compressed columns: for many rows, of which kept() writes each whole."""
    folder = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
