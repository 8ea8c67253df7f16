"""What must not grow faster than its input: shuffles of whole rows, rows of a file, rows of a task, keys of a stream's state."""

from __future__ import annotations

from builders import SHIPMENT, raw
from pyspark.sql import functions as F

from quayline import domain as D
from quayline.operators import contract
from quayline.operators import curation as C
from quayline.operators import quality_checks as Q
from quayline.plans import queries
from quayline.sources import layout


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def exchanges(df) -> list[str]:
    return [x for x in plan(df) if "Exchange hashpartitioning" in x]


def test_whole_shipments_are_shuffled_once(spark):
    """Versions and copies used to be brought together by a shuffle each."""
    r = raw(spark, [{}, {}, {"weight_tons": ""}, {"shipment_id": " SHP-70001", "status": ""}, {"shipment_id": "SHP-2"}])
    staged = C.stage_shipments(r.shipments, C.curate_ports(r.ports), 3 * C.PARTITION_ROWS)
    assert len([x for x in exchanges(staged) if "(_id#" in x]) == 1 and not [x for x in exchanges(staged) if "weight_tons" in x]
    assert sorted((x._row_number, x.quarantine_reason) for x in staged.collect()) == [(1, None), (3, "conflicting_duplicate_id"), (4, "conflicting_duplicate_id"), (5, None)]


def test_tasks_hold_as_many_rows_however_many_there_are(spark):
    rows = spark.range(10)
    assert C.dealt(rows, 10 * C.PARTITION_ROWS, "id").rdd.getNumPartitions() == 10
    assert C.dealt(rows, 10, "id").rdd.getNumPartitions() == 1


def test_texts_are_told_apart_by_their_lengths(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("1:a", "bc"), (None, "bc"), ("", "bc"), ("-", "bc"), ("a", "bc")], "x string, y string")
    assert rows.select(queries.content_key("x", "y")).distinct().count() == 6


def test_masks_of_rows_need_no_shuffle_of_texts(spark):
    rows = [{}, {}, {"weight_tons": "-1"}, {"shipment_id": "SHP-00002", "cargo_type": ""}]
    frames = Q.prepare(raw(spark, rows, [{}, {}, {"event_id": "EVT-2"}, {"notes": ""}]))
    assert not [x for x in exchanges(frames["shipments"].drop("_route_rows", "_route_median")) if "weight_tons" in x]
    assert len(exchanges(frames["shipment_ids"])) == 2 and not [x for x in exchanges(frames["shipment_ids"]) if "weight_tons" in x]
    ids = {x.shipment_id: (x._n, x._versions) for x in frames["shipment_ids"].collect()}
    assert ids == {SHIPMENT["shipment_id"]: (3, 2), "SHP-00002": (1, 1)}
    assert {x.event_id: (x._n, x._versions) for x in frames["event_ids"].collect()} == {"EVT-510001": (3, 2), "EVT-2": (1, 1)}


def test_contract_counts_ids_apart_from_its_rules(spark):
    """Each id used to carry the counts of all rules through a shuffle."""
    ids = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "shipment_id string")
    assert contract._repeated_ids(ids).head().pk_shipments_unique == 6 - 2 + 2 and contract._repeated_ids(ids.limit(0)).head().pk_shipments_unique == 0
    shipments = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ((c, "timestamp_ntz" if c.startswith(("booking_date", "planned", "actual_dep", "actual_arr")) else "boolean" if c == "on_time_flag" else "double" if c.startswith(("weight", "transit", "actual_delay")) else "int" if c == "container_count" else "string") for c in D.CURATED_SHIPMENT_COLUMNS)))
    assert not exchanges(contract._shipment_counts(shipments))


def test_files_of_a_sorted_table_grow_in_number(spark, monkeypatch):
    """Their number was 20, whatever the number of rows."""
    made = []
    monkeypatch.setattr(C, "PARTITION_ROWS", 50)
    monkeypatch.setattr(queries, "write_sorted", lambda df, folder, keys, rows, *a: (made.append(rows), layout.write_sorted(df, folder, keys, rows, *a)))
    queries.QUERIES["sorted_lookup"](spark, "/root/testdata/sf0.001").collect()
    assert made == [50]


def test_equal_moments_are_asked_once(spark):
    """Every row that asked used to go through all shuffles and frames by itself."""
    from quayline.operators import point_in_time as P

    many = spark.range(50).select(F.lit("k").alias("key"), F.lit("2031-01-05 00:00:00").cast("timestamp_ntz").alias("ts"))
    facts = spark.createDataFrame([("k", "2031-01-01 00:00:00", 3), ("k", "2031-01-04 00:00:00", 4)], "key string, at string, v int").select("key", F.col("at").cast("timestamp_ntz").alias("ts"), "v")
    known = P._known_at(many, facts, {"n": ("count", "v", 2), "s": ("total", "v", None)}, None, 100).collect()
    assert [(x.key, x.n, x.s) for x in known] == [("k", 1, 7)]
    out = P.as_of(many.withColumn("id", F.lit(1)), facts, {"n": ("count", "v", 2)}, number=100)
    assert out.count() == 50 and {x.n for x in out.collect()} == {1}


def test_all_buckets_of_a_value_learn_its_greatest_time():
    """A value was one key of state, so five values were five tasks."""
    import pyarrow as pa

    from quayline.streaming import late

    rows = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "_us": [5, 9, 7], "_by": ["a", "a", "b"], "_part": pa.array([3, 4, 5], pa.int32()), "_marker": [False] * 3})
    first, *told = late._told_to_all(iter([rows]))
    assert first.num_rows == 3 and {(r["_by"], r["_us"], r["_part"]) for b in told for r in b.to_pylist() if r["_marker"]} == {(v, us, i) for v, us in (("a", 9), ("b", 7)) for i in range(late.BUCKETS)}
