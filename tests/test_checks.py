"""Each check fires on its own defect alone; reports, baselines, the gate and profiles."""

from __future__ import annotations

import pytest
from builders import PORTS, at, raw
from pyspark.sql import functions as F

from quayline import domain as D
from quayline.operators import quality_checks as Q
from quayline.plans.queries import QUERIES

SHIPMENTS = {
    "exact_duplicate_rows": ([{}, {}, {}], 2), "conflicting_duplicate_ids": ([{}, {"weight_tons": "3"}, {"weight_tons": "3"}], 2), "invalid_id_format": ([{"customer_id": "C-2200"}], 1),
    "unknown_port_code": ([{"destination_port": "ZZTOP"}], 1), "same_origin_destination": ([{"origin_port": "BBTWO "}], 1), "unparseable_timestamp": ([{"actual_departure": "04/03/2031"}], 1),
    "missing_planned_timestamp": ([{"planned_departure": " "}], 1), "planned_arrival_not_after_departure": ([{"planned_departure": at(25)}, {"planned_departure": at(-3), "shipment_id": "SHP-70002"}], 2),
    "actual_departure_before_booking": ([{"actual_departure": at(-0.5)}], 1), "actual_arrival_before_departure": ([{"actual_arrival": at(5)}], 1),
    "planned_transit_outlier_for_route": ([{"shipment_id": f"SHP-7000{i}"} for i in range(4)] + [{"shipment_id": "SHP-70009", "planned_arrival": at(90)}], 1),
    "status_non_canonical": ([{"status": "Delivered"}], 1), "status_missing_or_placeholder": ([{"status": " n/a"}, {"status": "", "shipment_id": "SHP-70002"}], 2),
    "status_actuals_mismatch": ([{"status": "canceled"}, {"actual_arrival": "", "shipment_id": "SHP-70002"}], 2), "status_delay_contradiction": ([{"status": "DELAYED"}, {"actual_arrival": at(27), "shipment_id": "SHP-70002"}], 2),
    "cargo_type_non_canonical": ([{"cargo_type": "furniture"}], 1), "cargo_type_missing": ([{"cargo_type": "\t"}], 1), "weight_missing": ([{"weight_tons": ""}], 1),
    "weight_non_positive": ([{"weight_tons": "-0.5"}], 1), "container_count_zero": ([{"container_count": "0"}], 1), "container_count_outlier": ([{"container_count": "100.5"}], 1),
}
EVENTS = {
    "exact_duplicate_rows": ([{}, {}], 1), "duplicate_event_id": ([{}, {"notes": "x"}, {"notes": "x"}], 3), "missing_event_type": ([{"event_type": ""}], 1),
    "invalid_event_type": ([{"event_type": "berthed"}], 1), "sentinel_vessel_id": ([{"vessel_id": "VSL-9999"}], 1), "unknown_port_code": ([{"port_code": "bbtwo"}], 1),
    "unparseable_timestamp": ([{"event_timestamp": " "}], 1), "out_of_order": ([{"event_timestamp": at(3)}, {}, {"event_timestamp": at(4), "event_id": "E"}], 1),
    "delay_out_of_range": ([{"delay_minutes": "1440.5"}, {"delay_minutes": "", "event_id": "E"}], 2), "delayed_event_without_delay": ([{"event_type": "DELAYED", "delay_minutes": "0"}], 1),
    "notes_contradict_delay": ([{"notes": "Normal operations"}], 1), "missing_notes": ([{"notes": " "}], 1),
}
PORT_ROWS = {
    "missing_field": ([("EEFIV", "Fifth", "Epira", " ", "UTC+3", "0.5")], 1), "duplicate_port_code": ([PORTS[0], PORTS[0]], 2),
    "congestion_out_of_range": ([("EEFIV", "Fifth", "Epira", "NORTH", "UTC+3", "1.01"), ("FFSIX", "Sixth", "Faro", "NORTH", "UTC+3", "high")], 2), "invalid_timezone_format": ([("EEFIV", "Fifth", "Epira", "NORTH", "GMT+3", "0.5")], 1),
}
SOUND = [p for p in PORTS if p[2]]


def counts(source):
    return {r.check: r.rows_affected for r in Q.mask_counts(source).collect() if r.rows_affected}


def test_sound_rows_hit_nothing(spark):
    assert counts(raw(spark, ports=SOUND, blank_null=False)) == {} and len(Q.CHECKS) == 37
    assert {r.rows_total for r in Q.mask_counts(raw(spark, [], [], SOUND)).collect()} == {0, 3}


@pytest.mark.parametrize("name", [*(f"shipments.{n}" for n in SHIPMENTS), *(f"port_events.{n}" for n in EVENTS), *(f"ports.{n}" for n in PORT_ROWS)])
def test_each_check_fires(spark, name):
    table, short = name.split(".")
    if table == "shipments":
        rows, expected = SHIPMENTS[short]
        source = raw(spark, rows, ports=SOUND)
    elif table == "port_events":
        rows, expected = EVENTS[short]
        source = raw(spark, events=rows, ports=SOUND)
    else:
        rows, expected = PORT_ROWS[short]
        source = raw(spark, ports=SOUND + rows)
    c = Q.CHECKS[name]
    assert Q.prepare(source)[c.frame].agg(Q._hits(c).alias("n")).head().n == expected


def test_report_and_gate(spark):
    source = raw(spark, [{"shipment_id": f"SHP-{i:05d}", "weight_tons": "-1"} for i in range(14, 0, -1)], ports=SOUND)
    report = Q.report(source, {"shipments.csv": "abc"})
    by = {c["check_name"]: c for c in report["checks"]}
    bad = by["shipments.weight_non_positive"]
    assert (bad["rows_affected"], bad["rows_total"], bad["pct_affected"], bad["status"]) == (14, 14, 100.0, "fail")
    assert bad["sample_keys"] == [f"SHP-{i:05d}" for i in range(1, 11)] and by["ports.missing_field"]["sample_keys"] == []
    assert report["summary"] == {"pass": 36, "fail": 1, "error": 0, "total": 37, "critical_failures": 0} and report["seconds"] > 0
    base = Q.baseline(report)
    assert Q.gate(report, base) == [] and base["shipments.weight_non_positive"] == 14
    assert Q.gate(report, base | {"shipments.weight_non_positive": 12}) == ["shipments.weight_non_positive: 14 rows after 12"]
    assert Q.gate(report, base | {"shipments.weight_non_positive": 13}) == [] and len(Q.gate(report, {})) == 1
    with pytest.raises(ValueError):
        Q.check("ports.missing_field", "info", "none")(lambda: F.lit(True))


def test_a_broken_check_stops_no_other(spark):
    Q.check("shipments.broken", "info", "none")(lambda: F.col("nowhere") > 1)
    try:
        report = Q.report(raw(spark, [{"cargo_type": ""}], ports=SOUND))
    finally:
        del Q.CHECKS["shipments.broken"]
    by = {c["check_name"]: c for c in report["checks"]}
    assert by["shipments.broken"]["status"] == "error" and by["shipments.cargo_type_missing"]["rows_affected"] == 1 and report["summary"]["error"] == 1
    assert any(x.startswith("shipments.broken: ") for x in Q.gate(report, {}))


def test_no_check_is_left_out(spark):
    """The query showed 13 of the checks, and one whose frame isn't made was passed over and told as passed."""
    assert sorted(r.check for r in QUERIES["dq_mask_counts"](spark, "/root/testdata/sf0.001").collect()) == sorted(Q.CHECKS)
    Q.check("customers.unknown", "info", "none")(lambda: F.lit(True))
    try:
        with pytest.raises(ValueError, match="customers.unknown"):
            Q.mask_counts(raw(spark, ports=SOUND))
        report = Q.report(raw(spark, [{"cargo_type": ""}], ports=SOUND))
    finally:
        del Q.CHECKS["customers.unknown"]
    by = {c["check_name"]: c["status"] for c in report["checks"]}
    assert by["customers.unknown"] == "error" and by["shipments.cargo_type_missing"] == "fail" and report["summary"]["error"] == 1


def test_regressions(spark):
    base = spark.createDataFrame([("a", 100), ("b", 0)], "check string, rows_affected bigint")
    found = lambda *rows: {r.check for r in Q.regressions(spark.createDataFrame(list(rows), "check string, rows_affected bigint"), base).collect()}
    assert found(("a", 109), ("b", 0)) == set()
    assert found(("a", 120), ("b", 1), ("c", 1)) == {"a", "b", "c"}


def test_profiles(spark):
    rows = [(str(i), f"2031-01-{i % 28 + 1:02d} 00:00:00" if i else "soon", "ab"[i % 2], None, "1" if i < 90 else "x") for i in range(100)] + [("7", "2031-01-08 00:00:00", "b", None, "1")] * 2
    df = spark.createDataFrame(rows, "n string, t string, c string, e string, m string")
    p = Q.dataset_profile(df, df.columns)
    kinds = {c: x["inferred_type"] for c, x in p["column_profiles"].items()}
    assert kinds == {"n": "numeric", "t": "timestamp", "c": "string", "e": "empty", "m": "string"} and (p["rows"], p["exact_duplicate_rows"]) == (102, 2)
    assert p["column_profiles"]["t"]["unparseable"] == 1 and p["column_profiles"]["c"]["top_values"] == {"b": 52, "a": 50} and "top_values" not in p["column_profiles"]["n"]
    assert Q.dataset_profile(df.limit(0), ["n"])["column_profiles"]["n"]["inferred_type"] == "empty" and D.MAX_CONTAINERS == 100
