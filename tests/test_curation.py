"""Rules of curation, one case for each, and the contract over their results."""

from __future__ import annotations

from datetime import datetime

import pytest
from builders import PORTS, at, raw
from pyspark.sql import functions as F

from quayline.functions.columns import lax_double, lax_int, minutes_between, strict_timestamp
from quayline.operators import serving as S
from quayline.operators.contract import ContractError, assert_valid, violations
from quayline.operators.curation import curate, lineage
from quayline.operators.fingerprint import fingerprint

#: Case: (rows, {id: reason or None}).
KEPT_OR_NOT = {
    "copies are one row, the first": ([{"shipment_id": "SHP-1"}, {"shipment_id": "SHP-1"}, {"shipment_id": "SHP-1"}], {"SHP-1": [None]}),
    "copies are told before ids are trimmed": ([{"shipment_id": "SHP-2"}, {"shipment_id": " SHP-2 "}], {"SHP-2": [None, "conflicting_duplicate_id"]}),
    "fewest empty fields survive": ([{"shipment_id": "SHP-3", "weight_tons": "", "vessel_id": ""}, {"shipment_id": "SHP-3", "weight_tons": ""}, {"shipment_id": "SHP-3"}], {"SHP-3": [None, "conflicting_duplicate_id", "conflicting_duplicate_id"]}),
    "of equals the first survives": ([{"shipment_id": "SHP-4", "weight_tons": "1"}, {"shipment_id": "SHP-4", "weight_tons": "2"}], {"SHP-4": [None, "conflicting_duplicate_id"]}),
    "a blank status is an empty field": ([{"shipment_id": "SHP-5", "status": "  "}, {"shipment_id": "SHP-5", "cargo_type": "Apparel"}], {"SHP-5": [None, "conflicting_duplicate_id"]}),
    "unknown port": ([{"shipment_id": "SHP-6", "origin_port": "ZZTOP"}, {"shipment_id": "SHP-7", "destination_port": ""}], {"SHP-6": ["unknown_port_code"], "SHP-7": ["unknown_port_code"]}),
    "same port in another case": ([{"shipment_id": "SHP-8", "origin_port": " bbtwo "}], {"SHP-8": ["same_origin_destination"]}),
    "planned times": ([{"shipment_id": "SHP-9", "planned_arrival": ""}, {"shipment_id": "SHP-10", "booking_date": "next week"}], {"SHP-9": ["missing_or_invalid_planned_timestamp"], "SHP-10": ["missing_or_invalid_planned_timestamp"]}),
    "planned order": ([{"shipment_id": "SHP-11", "planned_arrival": at(5)}, {"shipment_id": "SHP-12", "planned_departure": at(-1)}], {"SHP-11": ["invalid_planned_sequence"], "SHP-12": ["invalid_planned_sequence"]}),
    "leaving at the booking is in order": ([{"shipment_id": "SHP-13", "planned_departure": at(0)}], {"SHP-13": [None]}),
    "the first reason counts": ([{"shipment_id": "SHP-14", "origin_port": "ZZTOP", "destination_port": "ZZTOP", "planned_arrival": ""}], {"SHP-14": ["unknown_port_code"]}),
}


def test_what_is_quarantined(spark):
    c = curate(raw(spark, [r for rows, _ in KEPT_OR_NOT.values() for r in rows]))
    got: dict[str, list] = {}
    for r in c.shipments.select("shipment_id").collect():
        got.setdefault(r.shipment_id, []).append(None)
    for r in c.quarantined_shipments.collect():
        got.setdefault(r.shipment_id, []).append(r.quarantine_reason)
    for name, (_, expected) in KEPT_OR_NOT.items():
        assert {i: sorted(got[i], key=str) for i in expected} == {i: sorted(v, key=str) for i, v in expected.items()}, name
    assert {"actual_departure_raw", "weight_tons_raw", "cargo_type_raw"} <= set(c.quarantined_shipments.columns)
    weights = {r.shipment_id: r.weight_tons for r in c.shipments.collect()}
    assert weights["SHP-4"] == 1.0


#: Changes to the plain shipment, and what becomes of it.
REPAIRED = [
    ({}, {"status": "DELIVERED", "on_time_flag": True, "actual_delay_hours": 12.0, "transit_days_planned": 20.0, "transit_days_actual": 20.25, "booking_lead_days": 5.0, "dq_flags": [], "route_key": "AAONE → BBTWO"}),
    ({"actual_arrival": at(26)}, {"status": "DELIVERED", "on_time_flag": True, "actual_delay_hours": 24.0}),
    ({"actual_arrival": at(26, "%Y-%m-%d %H:31:00")}, {"status": "DELAYED", "on_time_flag": False, "dq_flags": []}),
    ({"actual_departure": at(-2)}, {"actual_departure": None, "actual_delay_hours": 12.0, "transit_days_actual": None, "dq_flags": ["actual_departure_before_booking"]}),
    ({"actual_arrival": at(5.25)}, {"actual_departure": None, "actual_arrival": None, "status": "UNKNOWN", "dq_flags": ["actual_arrival_before_departure", "no_observed_outcome"]}),
    ({"status": "cancelled", "actual_arrival": "", "actual_departure": ""}, {"status": "CANCELLED", "actual_delay_hours": None, "on_time_flag": None, "dq_flags": ["status_normalised"]}),
    ({"status": "CANCELED"}, {"status": "UNKNOWN", "actual_delay_hours": 12.0, "dq_flags": ["status_normalised"]}),
    ({"status": "sailing"}, {"status": "DELIVERED", "dq_flags": ["status_missing_or_unmapped"]}),
    ({"status": ""}, {"status": "DELIVERED", "dq_flags": ["status_missing_or_unmapped"]}),
    ({"status": "completed", "actual_arrival": ""}, {"status": "UNKNOWN", "dq_flags": ["status_normalised", "no_observed_outcome"]}),
    ({"cargo_type": ""}, {"cargo_type": "Unknown", "dq_flags": ["cargo_type_missing"]}),
    ({"cargo_type": " food  &  BEVERAGE "}, {"cargo_type": "Food & Beverage", "dq_flags": ["cargo_type_normalised"]}),
    ({"cargo_type": "Spice"}, {"cargo_type": "Unknown", "dq_flags": ["cargo_type_unrecognised"]}),
    ({"weight_tons": "heavy"}, {"weight_tons": None, "dq_flags": ["weight_missing"]}),
    ({"weight_tons": "0"}, {"weight_tons": None, "dq_flags": ["weight_non_positive"]}),
    ({"container_count": ""}, {"container_count": None, "dq_flags": ["container_count_missing"]}),
    ({"container_count": "-3"}, {"container_count": None, "dq_flags": ["container_count_zero"]}),
    ({"container_count": "100"}, {"container_count": 100, "dq_flags": []}),
    ({"container_count": "101"}, {"container_count": None, "dq_flags": ["container_count_outlier"]}),
]


def test_what_is_repaired(spark):
    rows = [changes | {"shipment_id": f"SHP-{80000 + i}"} for i, (changes, _) in enumerate(REPAIRED)]
    source = raw(spark, rows)
    c = curate(source)
    got = {r.shipment_id: r.asDict() for r in c.shipments.collect()}
    for i, (changes, expected) in enumerate(REPAIRED):
        row = got[f"SHP-{80000 + i}"]
        assert {k: row[k] for k in expected} == expected, changes
    back = {r.shipment_id: r.raw.cargo_type for r in lineage(c.shipments, source.shipments).collect()}
    assert back["SHP-80011"] == " food  &  BEVERAGE "


def test_events(spark):
    cases = [{}, {}, {"notes": "another under the same id"}, {"event_id": "E2", "event_timestamp": "?"}, {"event_id": "E3", "event_type": " "}, {"event_id": "E4", "event_type": "SUNK"}, {"event_id": "E5", "vessel_id": " VSL-9999"}, {"event_id": "E6", "port_code": "NOWHR"}, {"event_id": "E7", "event_type": "delayed", "delay_minutes": "0"}, {"event_id": "E8", "event_type": "SUNK", "event_timestamp": ""}, {"event_id": "E9", "notes": ""}, {"event_id": "E9", "port_code": "NOWHR"}]
    c = curate(raw(spark, events=cases))
    assert {r.event_id: r.quarantine_reason for r in c.quarantined_events.collect()} == {"E2": "unparseable_timestamp", "E3": "missing_event_type", "E4": "invalid_event_type", "E5": "sentinel_vessel_id", "E6": "unknown_port_code", "E8": "unparseable_timestamp", "E9": "unknown_port_code"}
    kept = sorted((r.event_id, r.dq_flags, r.notes) for r in c.port_events.collect())
    assert kept == [("E7", ["delayed_event_without_delay"], "Tug late"), ("E9", ["event_id_collision"], None), ("EVT-510001", ["event_id_collision"], "Tug late"), ("EVT-510001", ["event_id_collision"], "another under the same id")]
    assert c.port_events.select("event_key").distinct().count() == 4


def test_ports(spark):
    c = curate(raw(spark, ports=[*PORTS, ("aaone ", "Again", "X", "Y", "Z", "1"), ("DDNUL", None, None, None, None, "n/a")]))
    got = {r.port_code: r for r in c.ports.collect()}
    assert len(got) == 5 and got["AAONE"].port_name == "First Harbour"
    assert (got["BEANR"].country, got["BEANR"].dq_flags) == ("Belgium", ["country_filled_from_fix_list"]) and got["DDNUL"].avg_congestion_score is None


def test_contract(spark):
    source = raw(spark, [{"shipment_id": f"SHP-{i}"} for i in range(10)] + [{"shipment_id": "SHP-99", "origin_port": "ZZTOP"}])
    c = curate(source)
    assert len(assert_valid(source, c)) == 20
    more = raw(spark, [{"shipment_id": "SHP-1"}, {"shipment_id": "SHP-2", "origin_port": "ZZTOP"}])
    with pytest.raises(ContractError, match="quarantine_ratio"):
        assert_valid(more, curate(more))
    assert_valid(more, curate(more), 50)
    none = raw(spark, [])
    counts = {r.rule: r.violations for r in violations(none, curate(none)).collect()}
    assert {k for k, v in counts.items() if v} == {"curated_not_empty"}
    late = raw(spark, [{"status": "CANCELLED"}])  # cancelled, yet it came: no status agrees with its delay
    with pytest.raises(ContractError, match="status_consistent_with_delay"):
        assert_valid(late, curate(late))


def test_serving_is_consistent(spark):
    rows = [{"shipment_id": f"SHP-{i}", "actual_arrival": at(25 + i / 4)} for i in range(6)] + [{"shipment_id": "SHP-10", "origin_port": "CCTRI"}]
    c = curate(raw(spark, rows))
    stats = {r.route_key: r for r in S.route_stats(c.shipments).collect()}
    one = stats["AAONE → BBTWO"]
    assert (one.shipment_count, one.median_delay_hours, one.on_time_rate) == (6, 15.0, 5 / 6)
    assert sum(r.shipment_count for r in S.route_quarterly_stats(c.shipments).collect()) == 7
    empty = S.single_route_stats(c.shipments, "BBTWO", "AAONE").head()
    assert (empty.shipment_count, empty.avg_delay_hours) == (0, None)
    page, total = S.shipment_page(c.shipments, page_size=3, page=3)
    assert page.count() == 1 and total.head().total == 7
    for wrong in (lambda: S.route_rankings(c.shipments, "weight_tons"), lambda: S.shipment_page(c.shipments, {"_source_row": "1"}), lambda: S.shipment_page(c.shipments, page_size=101)):
        with pytest.raises(ValueError):
            wrong()
    assert S.shipment_lookup(c.shipments, c.ports, " shp-10 ").head().origin_region == "SOUTH"
    assert fingerprint(c.shipments) == fingerprint(c.shipments.repartition(5, "status")) != fingerprint(c.shipments.limit(3))


def test_casts(spark):
    rows = spark.createDataFrame([("12.5",), ("1e3",), (" 7 ",), ("1.5d",), ("x",), ("",), (None,), ("99999999999",)], "v string").select(lax_int("v").alias("i"), lax_double("v").alias("d")).collect()
    assert [r.i for r in rows] == [13, 1000, 7, None, None, None, None, None]
    assert [r.d for r in rows][:4] == [12.5, 1000.0, 7.0, None]
    times = spark.createDataFrame([("2031-1-2 3:4:5",), ("2031-01-02T03:04:05",), ("2031-01-02 24:00:00",), ("2031-01-02 03:04:05.1",)], "v string").select(strict_timestamp("v").alias("t")).collect()
    assert [r.t for r in times] == [datetime(2031, 1, 2, 3, 4, 5), None, None, None]
    d = spark.createDataFrame([(datetime(2031, 1, 1, 0, 0, 59), datetime(2031, 1, 1, 0, 1, 0))], "a timestamp_ntz, b timestamp_ntz")
    assert d.select(minutes_between("a", "b").alias("m")).head().m == 1
    assert d.select(F.lit(1)).count() == 1


def test_texts_that_are_numbers(spark):
    texts = ["1.5", " -2 ", "inf", "-Infinity", "NaN", "1.5d", "1_0", "", "x", None, "1e3", "99999999999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(lax_double("t").alias("d"), lax_int("t").alias("i")).collect()
    assert [None if r.d is None else str(r.d) for r in rows] == ["1.5", "-2.0", "inf", "-inf", "nan", None, None, None, None, None, "1000.0", "99999999999.0"]
    assert [r.i for r in rows] == [2, -2, None, None, None, None, None, None, None, None, 1000, None]
