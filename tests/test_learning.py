"""Features, folds, metrics, drift, and a model from training to monitoring."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.operators import drift
from quayline.operators import learning as L
from quayline.operators import training as M
from quayline.operators.point_in_time import as_of, history

PORTS = [("AAONE", "NORTH", 0.31), ("BBTWO", "SOUTH", 0.62)]


@pytest.fixture(scope="module")
def ports(spark):
    return spark.createDataFrame(PORTS, "port_code string, region string, avg_congestion_score double")


@pytest.fixture(scope="module")
def shipments(spark):
    """240 shipments, one a day; those of many containers come late."""
    start = datetime(2031, 1, 1)
    rows = [(f"SHP-{i:05d}", *(("AAONE", "BBTWO") if i % 2 else ("BBTWO", "AAONE")), ["Machinery", "Apparel", "Rare"][0 if i % 2 else 1 if i > 5 else 2], i * 37 % 90 + 1, float(i) if i % 9 else None, start + timedelta(days=i), start + timedelta(days=i + 7), start + timedelta(days=i + 30), 48.0 if i * 37 % 90 > 45 else 2.0, "DELAYED" if i * 37 % 90 > 45 else "DELIVERED", f"V{i % 4}", f"C{i % 7}") for i in range(240)]
    df = spark.createDataFrame(rows, "shipment_id string, origin_port string, destination_port string, cargo_type string, container_count int, weight_tons double, booking_date timestamp_ntz, planned_departure timestamp_ntz, planned_arrival timestamp_ntz, actual_delay_hours double, status string, vessel_id string, customer_id string")
    return df.withColumn("actual_arrival", F.expr("planned_arrival + make_dt_interval(0, cast(actual_delay_hours AS int))")).withColumn("route_key", F.concat("origin_port", F.lit(" → "), "destination_port"))


def test_features(spark, ports):
    b = spark.createDataFrame([("AAONE", "BBTWO", "Electronics", 10, 500.0, datetime(2031, 1, 1), datetime(2031, 1, 8, 12), datetime(2031, 2, 7, 12)), ("AAONE", "ZZ", None, None, None, datetime(2031, 1, 6), datetime(2031, 1, 8), datetime(2031, 2, 7))], "origin_port string, destination_port string, cargo_type string, container_count int, weight_tons double, booking_date timestamp_ntz, planned_departure timestamp_ntz, planned_arrival timestamp_ntz")
    one, two = L.booking_features(b, ports).orderBy(F.desc("booking_lead_days")).collect()
    assert (one.booking_lead_days, one.transit_days_planned, one.region_lane) == (7.5, 30.0, "NORTH->SOUTH")
    assert (two.destination_region, two.destination_congestion, two.cargo_type, two.booking_dayofweek) == ("UNKNOWN", None, "Unknown", 0.0)
    with pytest.raises(ValueError):
        L.booking_features(b.drop("cargo_type"), ports)


def test_folds(spark):
    rows = spark.range(103).select("id", F.expr("TIMESTAMP_NTZ '2031-01-01' + make_dt_interval(cast(id div 3 AS int))").alias("t"))
    placed = {r.id: r.position for r in L.with_position(rows, ["t", "id"]).collect()}
    assert placed == {i: i for i in range(103)}
    folds = L.rolling_folds(rows, ["t", "id"])
    for k in range(4):
        part = {p: sorted(r.id for r in folds.where((F.col("fold") == k) & (F.col("part") == p)).collect()) for p in ("train", "test")}
        assert part["train"] == list(range(part["test"][0])) and part["test"] == list(range(part["test"][0], part["test"][-1] + 1))
    assert [(r.train_rows, r.test_rows) for r in L.fold_sizes(folds).orderBy("fold").collect()] == [(41, 15), (56, 16), (72, 15), (87, 16)]
    with pytest.raises(ValueError):
        L.rolling_folds(rows, ["t"], 0)


def test_metrics(spark):
    scores = spark.createDataFrame([(0, 0.1), (0, 0.6), (1, 0.4), (1, 0.9)], "y int, p double")
    m = L.classification_metrics(scores).head()
    assert (m.precision, m.recall, m.roc_auc) == (0.5, 0.5, 0.75) and m.average_precision == pytest.approx((1 + 2 / 3) / 2)
    nothing = L.classification_metrics(scores.where("p > 2")).head()
    assert nothing.roc_auc is None and nothing.precision == 0
    bands = spark.createDataFrame([(0.5,), (0.35,), (0.34,)], "p double").select(L.risk_band(F.col("p")).alias("b")).collect()
    assert [r.b for r in bands] == ["HIGH", "MEDIUM", "LOW"]
    many = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 37 % 100) / 200 + F.col("id") % 2 * 0.2).alias("p"))
    interval = L.bootstrap_interval(many, 300)
    assert interval == L.bootstrap_interval(many.repartition(7), 300)
    auc = L.classification_metrics(many).head().roc_auc
    assert interval[0] < auc < interval[1] and interval[1] - interval[0] < 0.15


def reference_psi(base: np.ndarray, now: np.ndarray) -> float:
    """PSI by numpy's own histogram."""
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e, a = (np.clip(np.histogram(x, bins=edges)[0] / len(x), 1e-4, None) for x in (base, now))
    e, a = e / e.sum(), a / a.sum()
    return float(((a - e) * np.log(a / e)).sum())


def test_psi_equals_numpy(spark):
    r = np.random.default_rng(3)
    cases = {"smooth": (r.normal(10, 2, 800), r.normal(11, 2, 500)), "zeros": (np.where(r.random(700) < 0.3, 0, r.normal(5, 1, 700)), np.where(r.random(700) < 0.5, 0, r.normal(5, 1, 700))), "months": (r.integers(1, 13, 900).astype(float), r.integers(4, 9, 300).astype(float)), "counts": (r.poisson(2, 600).astype(float), r.poisson(3, 600).astype(float)), "two": (np.array([1.0, 2.0] * 50), np.array([2.0] * 40))}
    for name, (base, now) in cases.items():
        frames = [spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double") for v in (base, now)]
        assert drift.psi_numeric(*frames, "v").head().psi == pytest.approx(reference_psi(base, now), abs=2e-4), name
    k = lambda values: spark.createDataFrame([(x,) for x in values], "v string")
    assert drift.psi_categorical(k(["a"] * 5 + [None] * 5), k(["a"] * 5 + [None] * 5), "v").head().psi == 0
    e, a = np.array([0.5, 0.5, 1e-4]), np.array([1.0, 1e-4, 1e-4])
    e, a = e / e.sum(), a / a.sum()
    assert drift.psi_categorical(k(["a"] * 5 + [None] * 5), k(["a"] * 9), "v").head().psi == pytest.approx(float(((a - e) * np.log(a / e)).sum()), abs=1e-4)
    assert [drift.level(x) for x in (0.1, 0.1001, 0.25, 0.2501)] == ["ok", "warn", "warn", "alert"]


def test_unseen_categories_and_decision(spark):
    base = spark.range(100).select(F.concat(F.lit("c"), F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("departure_month"))
    ref = drift.reference(base, ("departure_month",), ("k",))
    assert len(ref["k"]["shares"]) == 30 and ref["k"]["other"] == pytest.approx(0.2)
    got = drift.feature_drift(ref, base.withColumn("k", F.when(F.col("departure_month") < 50, F.lit(None)).otherwise("c0")).withColumn("departure_month", F.lit(1.0)))
    assert got["k"]["unseen_share"] == 0.5 and got["departure_month"]["level"] == "seasonal"
    report = {"features": got, "prediction": {"psi": 0.3, "level": "alert"}, "performance": {"roc_auc": 0.5, "validated_auc": 0.6, "positive_rate": 0.4, "reference_base_rate": 0.2}}
    assert len(drift.retrain_decision(report)[1]) == 5
    assert drift.drift_report(ref, base)["retrain"] is True and drift.feature_drift(drift.reference(base, (), ("departure_month",), top=100), base)["departure_month"]["psi"] == 0


def test_as_of_sees_only_the_past(spark):
    t = lambda d, s=0: datetime(2031, 1, d, 0, 0, s)
    facts = spark.createDataFrame([("a", t(1), 1.0), ("a", t(5), 3.0), ("a", t(9), 100.0), (None, t(1), 7.0), ("a", None, 7.0)], "key string, ts timestamp_ntz, v double")
    probes = spark.createDataFrame([(1, "a", t(9)), (2, "a", t(1)), (3, "b", t(9)), (4, None, t(9)), (5, "a", t(9, 1)), (6, "a", None)], "id bigint, key string, ts timestamp_ntz")
    got = {r.id: (r.m, r.n, r.s) for r in as_of(probes, facts, {"m": ("avg", "v"), "n": ("count", "v"), "s": ("total", "v")}).collect()}
    assert got == {1: (2.0, 2, 4.0), 2: (None, 0, 0.0), 3: (None, 0, 0.0), 4: (None, 0, 0.0), 5: (104 / 3, 3, 104.0), 6: (None, 0, 0.0)}
    assert {r.id: r.n for r in as_of(probes, facts, {"n": ("count", "v")}, 4).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}


def test_one_busy_key_is_dealt_by_days(spark):
    facts = spark.range(3000).select(F.lit("hot").alias("key"), F.expr("TIMESTAMP_NTZ '2031-01-01' + make_dt_interval(0, cast(id AS int))").alias("ts"), F.lit(1).alias("v"))
    probes = facts.select(F.monotonically_increasing_id().alias("id"), "key", "ts")
    got = as_of(probes, facts, {"n": ("count", "v")}, 2).withColumn("hours", F.timestamp_diff("HOUR", F.lit("2031-01-01").cast("timestamp_ntz"), F.col("ts"))).where("n <> least(hours, 48)")
    assert got.count() == 0


def test_model_from_training_to_monitoring(spark, ports, shipments, tmp_path):
    none = spark.createDataFrame([], "port_code string, event_timestamp timestamp_ntz, delay_minutes int, event_type string")
    rows = L.training_rows(shipments, ports, history(shipments, none)).cache()
    assert rows.count() == 240 and rows.agg(F.avg("label").alias("r")).head().r > 0.4
    few = {n: M.CANDIDATES[n] for n in ("prior", "logistic")}
    model = M.train(rows, few, permutations=0, rounds=50, n_folds=1)
    meta = model.metadata
    for candidate in (M.Candidate("boosted", M.boosted(2)), M.CANDIDATES["logistic_history"]):
        assert M.cross_validate(rows, candidate, n_folds=1)["summary"]["roc_auc"]["mean"] > 0.85
    assert M.permutation_test(rows, few["logistic"], 0.95, 1, 1)["p_value"] == 0.5
    assert model.name == "logistic" and meta["test"]["roc_auc"] > 0.85 and meta["candidates"]["prior"]["roc_auc"]["mean"] == 0.5
    assert meta["permutation"] is None and set(meta["candidates"]) == set(few) and "| logistic |" in M.model_card(meta | {"version": "7"})
    folder = str(tmp_path / "model")
    with pytest.raises(M.ModelError):
        M.load(spark, folder)
    M.save(model, folder, "7")
    back = M.load(spark, folder)
    a, b = (M.predict(m, shipments, ports, ("shipment_id",)).orderBy("shipment_id").drop("model_version").collect() for m in (model, back))
    assert a == b and {r.risk_band for r in a} >= {"HIGH", "LOW"} and all(r.predicted_delayed == (r.risk_band == "HIGH") for r in a)
    report = M.monitor(back, shipments, ports, last_days=60)
    assert report["rows"] == 61 and report["overlaps_training"] and report["labelled"] == 61 and "performance" not in report
    whole = M.monitor(back, shipments, ports, "2031-01-01", "2031-12-31")
    assert whole["performance"]["roc_auc"] > 0.85 and report["model_version"] == "7"
    with pytest.raises(ValueError):
        M.monitor(back, shipments, ports, "2050-01-01")
    part = next(p for p in (tmp_path / "model" / "pipeline").rglob("part-*") if p.is_file() and not p.name.endswith(".crc"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(M.ModelError):
        M.load(spark, folder)
    results = {"logistic": 0.60, "boosted": 0.61, "logistic_history": 0.9, "prior": 0.95}
    summary = lambda v, std=0.02: {"summary": {"average_precision": {"mean": v, "std": std}}}
    assert M.select_candidate({k: summary(v) for k, v in results.items()})[0] == "logistic"
    assert M.select_candidate({k: summary(v) for k, v in (results | {"boosted": 0.7}).items()})[0] == "boosted"
