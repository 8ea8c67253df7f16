"""Sorted tables, merges by key, staged tables, late rows, rare categories."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quayline.operators.categories import RareCategories, RareCategoriesModel
from quayline.operators.serving import next_page
from quayline.sources import files, layout, staging, store
from quayline.sources.keyed import Conflict, KeyedTable
from quayline.streaming import late


def test_look_ups_open_few_files(spark, tmp_path):
    folder, r = str(tmp_path / "t"), random.Random(1)
    rows = [(f"K{i:05}", i % 7, "clash") for i in range(2000)] + [(None, 1, None)] * 3
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, v int, low string")
    layout.write_sorted(df, folder, ["id", "v"], file_rows=100, bloom=("id",))
    t = layout.SortedTable(spark, folder)
    assert t.files.count() > 10 and t.whole.count() == 2003
    one = t.where_key("K00123")
    assert [x.id for x in one.collect()] == ["K00123"] and len(one.inputFiles()) == 1
    assert t.where_key("none", "K01999").count() == 1
    some = t.between("K00100", "K00300")
    assert some.count() == 201 and len(some.inputFiles()) <= 5
    assert t.between().count() == 2000
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1]))
    for number, size in ((1, 10), (7, 50), (40, 50), (41, 50), (50, 50)):
        page = t.page(number, size)
        assert [tuple(x) for x in page.collect()] == want[(number - 1) * size : number * size]
        assert not page.inputFiles() or len(page.inputFiles()) <= 3
    layout.write_sorted(df.limit(0), str(tmp_path / "none"), ["id"])
    none = layout.SortedTable(spark, str(tmp_path / "none"))
    assert none.where_key("x").count() == none.page(1, 5).count() == 0


def test_pages_by_cursor_are_those_by_number(spark):
    rows = [(f"S{i:03}", None if i % 5 == 0 else datetime(2031, 1, 1 + i % 9), "DELAYED") for i in range(60)]
    df = spark.createDataFrame(rows, "shipment_id string, booking_date timestamp_ntz, status string")
    for down in (True, False):
        order = F.col("booking_date").desc_nulls_last() if down else F.col("booking_date").asc_nulls_last()
        want = [x.shipment_id for x in df.orderBy(order, "shipment_id").collect()]
        cursor, got = None, []
        while found := next_page(df, cursor, {"status": "DELAYED"}, descending=down, page_size=16).collect():
            got += [x.shipment_id for x in found]
            cursor = (found[-1].booking_date, found[-1].shipment_id)
        assert got == want
    with pytest.raises(ValueError, match="unsupported sort"):
        next_page(df, None, sort="nothing")


def test_merges_touch_only_their_buckets(spark, tmp_path):
    folder = str(tmp_path / "t")
    t = KeyedTable(spark, folder, ["id"], 8)
    frame = lambda rows: spark.createDataFrame(rows, "id int, v string")
    assert t.read(schema=frame([(1, "")]).schema).count() == 0
    want = {i: "a" for i in range(50)} | {None: "a"}
    one = t.merge(frame(list(want.items())), 0)
    two = t.merge(frame([(3, "b"), (99, "b"), (None, "b")]), 1)
    want |= {3: "b", 99: "b", None: "b"}
    changed = {k for k in two["folders"] if two["folders"][k] != one["folders"].get(k)}
    assert 0 < len(changed) <= 3 and {x.id: x.v for x in t.read().collect()} == want
    assert t.merge(frame([(3, "again")]), 1) == two and {x.id: x.v for x in t.read().collect()} == want  # a repeated batch
    assert {x.v for x in t.read(1).collect()} == {"a"}
    t.merge(frame([(7, "c")]), 2)
    os.makedirs(f"{folder}/data/00000003-left/_bucket=0")  # what a crash leaves
    t.vacuum(keep=1)
    assert t.versions() == [3] and {x.id: x.v for x in t.read().collect()} == want | {7: "c"}
    assert sum(len(store.folders(spark, f"{folder}/data/{b}")) for b in store.folders(spark, f"{folder}/data")) == len(t.manifest()["folders"])
    late_writer = KeyedTable(spark, folder, ["id"])
    late_writer.manifest = lambda version=None: t.__class__.manifest(t, version) | {"version": 2}
    with pytest.raises(Conflict):
        late_writer.merge(frame([(1, "lost")]), 9)
    assert {x.id: x.v for x in t.read().collect()} == want | {7: "c"}


def test_staged_tables_are_reused_until_inputs_change(spark, tmp_path):
    source, made = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)

    def make():
        made.append(1)
        return {"double": spark.read.parquet(source).select((F.col("id") * 2).alias("x"))}

    get = lambda code="1": staging.staged(spark, "test", [source], code, make)["double"]
    assert get().count() == get().count() == 5 and len(made) == 1
    spark.range(3).write.mode("append").parquet(source)
    assert get().count() == 8 and len(made) == 2 and get().count() == 8 and len(made) == 2
    assert get("2").count() == 8 and len(made) == 3
    store.remove(spark, get("2").inputFiles()[0].rsplit("/", 2)[0])
    assert get("2").count() == 8 and len(made) == 4


def test_late_rows_are_told(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "id int, ts timestamp, port string"
    row = lambda i, day, port="P": (i, datetime(2031, 1, day, 12), port)
    batches = [[row(1, 10), row(1, 10), row(2, 5), (9, None, "P")], [row(1, 10), row(3, 7), row(4, 9), row(5, 12), row(6, 1, "Q"), row(6, 1, None)], [row(3, 9), row(4, 9), row(4, 11), row(5, 12)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = late.sorted_out(stream, "port", ("id", "ts"), lateness=timedelta(days=2))
    out.writeStream.foreachBatch(late.sides(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.batch, x.id, x.verdict, x.out_of_order) for x in late.read_sides(spark, str(tmp_path / "out")).collect())
    assert len(got) == sum(map(len, batches))
    assert got == sorted([
        (0, 1, "kept", False), (0, 1, "replay", False), (0, 2, "kept", False), (0, 9, "kept", False),
        (1, 1, "replay", False), (1, 3, "late", True), (1, 4, "kept", True), (1, 5, "kept", False), (1, 6, "kept", False), (1, 6, "kept", False),
        (2, 3, "late", True), (2, 4, "late", True), (2, 4, "kept", True), (2, 5, "replay", False),
    ])


def test_rare_categories_are_saved_with_their_names(spark, tmp_path):
    names = [f"n{i}" for i in range(30_000)] + ["often", "o'dd\\", None] * 12
    rows = spark.createDataFrame([(n, n if i % 2 else "same") for i, n in enumerate(names)], "a string, b string")
    model = RareCategories(inputCols=["a", "b"], outputCols=["x", "y"], minRows=10).fit(rows)
    count = lambda df, c: {r[c]: r.n for r in df.groupBy(c).agg(F.count("*").alias("n")).collect()}
    assert count(model.transform(rows), "x") == {"infrequent": 30_000, "often": 12, "o'dd\\": 12, None: 12}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = RareCategoriesModel.load(str(tmp_path / "m"))
    new = spark.createDataFrame([("often", "never"), ("n1", None)], "a string, b string")
    assert [tuple(r) for r in again.transform(new).select("x", "y").orderBy("x").collect()] == [("infrequent", None), ("often", "infrequent")]


def test_of_two_publishers_one_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    with pytest.raises(FileNotFoundError):
        files.current_run(spark, root)
    assert files.publish(spark, root, "a") == 1 and files.current_run(spark, root) == "a"
    assert files.publish(spark, root, "b", after=1) == 2
    with pytest.raises(files.PublishConflict):
        files.publish(spark, root, "late", after=1)
    real = files.versions
    seen = iter([[1], real(spark, root)])  # both publishers have read the versions before either made one
    monkeypatch.setattr(files, "versions", lambda *a: next(seen))
    assert files.publish(spark, root, "c") == 3
    monkeypatch.setattr(files, "versions", real)
    assert files.current_run(spark, root) == "c" and real(spark, root) == [1, 2, 3]
    monkeypatch.setattr(store, "create", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        files.publish(spark, root, "lost")
    assert files.current_run(spark, root) == "c"
    monkeypatch.undo()
    assert not store.create(spark, f"{root}/versions/00000003", "other") and store.read_text(spark, f"{root}/versions/00000003") == "c"
    assert [p for p, _, _ in store.files_below(spark, root) if "/_" in p] == []
