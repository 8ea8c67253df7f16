"""The event feed as a stream: replays, late rows, side outputs, checks and upserts."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quayline.streaming import activity as A

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder to which batches of events are put, and a stream over it."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    return put, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def event(i, day, kind="view", value=1.0):
    return (i, datetime(2031, 1, day, 12), i % 3, kind, value, None)


def test_replays_are_dropped_and_collisions_kept(spark, feed):
    put, stream = feed
    put(event(1, 1), event(1, 1), event(1, 1, value=2.0), event(2, 1, "error"))
    put(event(1, 1), event(2, 1, "error"), event(3, 2))
    got = {(r.w.start.day, r.event_type): (r.event_count, r.error_count) for r in A.run_to_table(A.daily(stream()), spark).collect()}
    assert got == {(1, "view"): (2, 0), (1, "error"): (1, 1), (2, "view"): (1, 0)}
    by_user = {(r.w.start.day, r.user_id): r.event_count for r in A.run_to_table(A.daily(stream(), "user_id"), spark).collect()}
    assert by_user == {(1, 1): 2, (1, 2): 1, (2, 0): 1}


def test_finished_windows_are_appended(spark, feed, tmp_path):
    put, stream = feed
    put(event(1, 1), event(2, 1))
    put(event(3, 5))
    out, point = str(tmp_path / "out"), str(tmp_path / "point")
    A.append_to(A.daily(stream()), out, point).awaitTermination()
    rows = lambda: {(r.w.start.day, r.event_count) for r in spark.read.parquet(out).collect()}
    assert rows() == {(1, 2)}
    put(event(4, 1))  # too late: its window is written already
    put(event(5, 9))
    A.append_to(A.daily(stream()), out, point).awaitTermination()
    assert rows() == {(1, 2), (5, 1)}


def test_side_outputs_and_checks(spark, feed, tmp_path):
    put, stream = feed
    put(event(1, 1), event(2, 1, "lost"), event(3, 1, value=-1.0))
    good, bad, counts = (str(tmp_path / x) for x in ("good", "bad", "counts"))
    write = A.split_batch(good, bad, F.when(F.col("event_type") == "lost", "invalid_event_type"), {"negative": F.col("value") < 0, "no_props": F.col("props").isNull()}, counts)
    for _ in range(2):  # a batch that is repeated replaces itself
        write(spark.createDataFrame([event(1, 1), event(2, 1, "lost"), event(3, 1, value=-1.0)], SCHEMA), 0)
    assert spark.read.parquet(good).count() == 2 and [r.quarantine_reason for r in spark.read.parquet(bad).collect()] == ["invalid_event_type"]
    assert {(r.check, r.rows_total, r.rows_affected) for r in spark.read.parquet(counts).collect()} == {("negative", 3, 1), ("no_props", 3, 3)}


def test_upserts(spark, tmp_path):
    folder = str(tmp_path / "table")
    write = A.upsert_batch(folder, ["id"])
    frame = lambda *rows: spark.createDataFrame(list(rows), "id int, v string")
    assert A.latest(spark, folder, frame((1, "a"))).count() == 0
    write(frame((1, "a"), (2, "b")), 0)
    write(frame((2, "c"), (3, "d")), 1)
    write(frame((2, "c"), (3, "d")), 1)
    write(frame((3, "e")), 2)
    assert {(r.id, r.v) for r in A.latest(spark, folder, frame((1, "a"))).collect()} == {(1, "a"), (2, "c"), (3, "e")}
