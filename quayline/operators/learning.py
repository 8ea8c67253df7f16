"""Features known at booking time, temporal folds, and exact classification metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domain as D
from ..functions.columns import seconds_between
from .curation import small

BOOKING_INPUTS = ("origin_port", "destination_port", "cargo_type", "container_count", "weight_tons", "booking_date", "planned_departure", "planned_arrival")
CATEGORICAL = ("origin_port", "destination_port", "cargo_type", "origin_region", "destination_region", "region_lane")
NUMERIC = ("container_count", "weight_tons", "booking_lead_days", "transit_days_planned", "origin_congestion", "destination_congestion", "departure_month", "departure_dayofweek", "booking_dayofweek")
HISTORY = ("hist_vessel_late_rate", "hist_customer_late_rate", "hist_route_late_rate", "hist_origin_late_rate", "hist_origin_event_delay_30d", "hist_origin_delayed_events_30d", "hist_destination_event_delay_30d")
THRESHOLD, FOLDS, FIRST_TRAIN = 0.5, 4, 0.4


def booking_features(bookings: DataFrame, ports: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, then CATEGORICAL and NUMERIC; weekdays count from Monday 0; a port that is not known is of region UNKNOWN."""
    if missing := [c for c in BOOKING_INPUTS if c not in bookings.columns]:
        raise ValueError(f"missing booking-time inputs: {missing}")
    ports, out = small(ports), bookings.select(*keep, *BOOKING_INPUTS)
    for side in ("origin", "destination"):
        p = ports.select(F.col("port_code").alias("_code"), F.col("region").alias(f"_{side}_region"), F.col("avg_congestion_score").cast("double").alias(f"{side}_congestion"))
        out = out.join(p, F.col(f"{side}_port") == F.col("_code"), "left").drop("_code").withColumn(f"{side}_region", F.coalesce(f"_{side}_region", F.lit("UNKNOWN")))
    days = lambda a, b: seconds_between(a, b) / F.lit(86400.0)
    new = {
        "cargo_type": F.coalesce("cargo_type", F.lit(D.UNKNOWN_CARGO)),
        "region_lane": F.concat("origin_region", F.lit("->"), "destination_region"),
        "container_count": F.col("container_count").cast("double"),
        "weight_tons": F.col("weight_tons").cast("double"),
        "booking_lead_days": days("booking_date", "planned_departure"),
        "transit_days_planned": days("planned_departure", "planned_arrival"),
        "departure_month": F.month("planned_departure").cast("double"),
        "departure_dayofweek": F.weekday("planned_departure").cast("double"),
        "booking_dayofweek": F.weekday("booking_date").cast("double"),
    }
    return out.select(*keep, *(new[c].alias(c) if c in new else F.col(c) for c in CATEGORICAL + NUMERIC))


def target(delay_hours: str = "actual_delay_hours") -> Column:
    """1 for more than the on-time hours of delay, 0 for less, null without an arrival."""
    return (F.col(delay_hours) > D.ON_TIME_HOURS).cast("int")


def training_rows(shipments: DataFrame, ports: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """shipment_id, booking_date, label, the features, and those of history if given, of shipments with an outcome."""
    done = shipments.where("actual_delay_hours IS NOT NULL")
    out = booking_features(done.withColumn("label", target()), ports, keep=("shipment_id", "booking_date", "label"))
    return out if history is None else out.join(history.select("shipment_id", *HISTORY), "shipment_id", "left")


def with_position(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows with their position from 0 on in an order whose first column is a time or a number; nulls come first.

    Rows are counted by spans of the first column (days of a time, ranges of 100,000 of a number); the count of all
    earlier spans is added to a row's place within its own, so no task sorts the whole table.
    """
    kind = dict(rows.dtypes)[order[0]]
    span = F.date_trunc("day", order[0]).cast("timestamp_ntz") if kind.startswith(("timestamp", "date")) else F.floor(F.col(order[0]) / 100_000)
    rows = rows.withColumn("_span", span)
    counts = rows.groupBy("_span").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_span").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_span").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return rows.withColumn("_place", place).join(starts, F.col("_span").eqNullSafe(F.col("_of"))).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_span", "_of", "_start", "_place")


#: Rows of a span that one task sorts, and ranges of scores whose draws one task adds up.
SPAN_ROWS, RANGES = 100_000, 200


def with_random_position(rows: DataFrame, by: str, n: int, *seed: int, span_rows: int = SPAN_ROWS) -> DataFrame:
    """rows with position: a permutation of 0 to n - 1, n being their number, drawn from a hash of by and seed.

    Ranges of the hash are spans of about span_rows rows each, however many rows there are; a span's first position is
    the number of rows in the spans before it. Rows with equal hashes are in the order of by, of equal by in no order.
    """
    spans = max(-(-n // span_rows), 1)
    h = F.xxhash64(F.col(by), *(F.lit(s) for s in seed))
    rows = rows.withColumn("_h", h).withColumn("_span", F.floor(F.pmod(F.shiftrightunsigned("_h", 20), F.lit(1 << 44)) / F.lit(float(1 << 44)) * spans))
    counts = rows.groupBy("_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))  # a row a span
    starts = counts.select("_span", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_span").orderBy("_h", by))
    return rows.withColumn("_place", place).join(starts, "_span").withColumn("position", F.col("_start") + F.col("_place") - 1).drop("_h", "_span", "_start", "_place")


def rolling_folds(rows: DataFrame, order: list[str], n_folds: int = FOLDS, first: float = FIRST_TRAIN) -> DataFrame:
    """rows once for each fold that they belong to, with fold and part (train or test).

    The first share of rows, in order, is always trained on; what follows is cut into n_folds tests of equal length, and
    each fold trains on all that comes before its test.
    """
    if n_folds < 1:
        raise ValueError("n_folds must be 1 or more")
    placed = with_position(rows, order)
    n = rows.agg(F.count("*").alias("_all"))
    start = F.floor(F.col("_all") * F.lit(first))
    edge = lambda k: start + F.floor((F.col("_all") - start) * k / n_folds)
    folds = placed.join(F.broadcast(n)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    part = F.when(F.col("position") < edge(F.col("fold")), "train").when(F.col("position") < edge(F.col("fold") + 1), "test")
    return folds.withColumn("part", part).where("part IS NOT NULL").select(*rows.columns, "fold", "part")


def fold_sizes(folds: DataFrame) -> DataFrame:
    """For each fold its number, training rows and test rows."""
    return folds.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"))


def classification_metrics(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: precision, recall, f1, roc_auc, average_precision, brier, positive_rate, predicted_rate from (y, p).

    Exact: scores are grouped by value first; cumulative counts run over the distinct values. They run within ranges
    of the score first and carry a range's totals over, so that no task sorts all values.
    """
    y, p = F.col("y"), F.col("p")
    hit = p >= threshold
    flat = scores.agg(F.count("*").alias("n"), F.sum(y).alias("pos"), F.count_if(hit).alias("pred"), F.sum(F.when(hit, y).otherwise(0)).alias("tp"), F.avg((p - y) * (p - y)).alias("brier"))
    by = scores.groupBy("p").agg(F.sum(y).alias("pos"), (F.count("*") - F.sum(y)).alias("neg")).withColumn("_part", F.floor(F.col("p") * 1000))
    parts = by.groupBy("_part").agg(F.sum("pos").alias("part_pos"), F.sum("neg").alias("part_neg"))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("part_neg").over(above), F.lit(0)).alias("neg_above"))
    within = Window.partitionBy("_part").orderBy(F.desc("p"))
    run = by.join(parts, "_part").select("pos", "neg", (F.col("pos_above") + F.sum("pos").over(within)).alias("tp"), (F.col("neg_above") + F.sum("neg").over(within)).alias("fp"))
    curve = run.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    d = flat.join(F.broadcast(curve))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    precision, recall = ratio(c("tp"), c("pred")), ratio(c("tp"), c("pos"))
    return d.select(
        precision.alias("precision"), recall.alias("recall"), ratio(2 * c("tp"), c("pred") + c("pos")).alias("f1"),
        (c("area") / F.nullif(c("all_pos") * c("all_neg"), F.lit(0))).alias("roc_auc"), (c("ap") / F.nullif(c("all_pos"), F.lit(0))).alias("average_precision"),
        "brier", F.try_divide("pos", "n").alias("positive_rate"), F.try_divide("pred", "n").alias("predicted_rate"),
    )


def threshold_table(scores: DataFrame, thresholds: tuple[float, ...] = tuple(round(0.30 + 0.05 * i, 2) for i in range(9))) -> DataFrame:
    """precision, recall, f1 and predicted_rate at each threshold, in one aggregation."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= t
        aggs += [F.count_if(hit).alias(f"pred{i}"), F.sum(F.when(hit, F.col("y")).otherwise(0)).alias(f"tp{i}")]
    one = scores.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *aggs)
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"pred{i}").alias("pred"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds))))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return one.select("n", "pos", each.alias("x")).select("n", "pos", "x.*").select("threshold", ratio(c("tp"), c("pred")).alias("precision"), ratio(c("tp"), c("pos")).alias("recall"), ratio(2 * c("tp"), c("pred") + c("pos")).alias("f1"), F.try_divide("pred", "n").alias("predicted_rate"))


def calibration_bins(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed share in equal bins, the last one closed; bins without rows are left out."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return scores.groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.avg("p").alias("mean_score"), F.avg("y").alias("observed"))


def risk_band(p: Column, threshold: float = THRESHOLD) -> Column:
    """HIGH from the threshold on, MEDIUM from 0.15 below it on, else LOW."""
    return F.when(p >= threshold, "HIGH").when(p >= round(threshold - 0.15, 10), "MEDIUM").otherwise("LOW")


def _drawn(rows: pa.Table, rounds: int) -> pa.Table:
    """For each round a range's positives, negatives and the area that they make within it; rows: range, p, key, pos, neg."""
    order = np.argsort(-np.asarray(rows.column("p")), kind="stable")
    pos, neg, key = (np.asarray(rows.column(c))[order] for c in ("pos", "neg", "key"))
    above, below, area = np.zeros(rounds), np.zeros(rounds), np.zeros(rounds)
    for p, n, k in zip(pos.tolist(), neg.tolist(), key.tolist(), strict=True):
        draw = np.random.default_rng(k & (2**63 - 1))
        more, fewer = draw.poisson(p, rounds), draw.poisson(n, rounds)
        area += fewer * (above + more / 2)
        above += more
        below += fewer
    return pa.table({"range": np.full(rounds, rows.column("range")[0].as_py(), np.int64), "r": np.arange(rounds), "pos": above, "neg": below, "area": area})


def bootstrap_interval(scores: DataFrame, rounds: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of ROC-AUC by a Poisson bootstrap: rows are counted by (p, y) first, each count is drawn anew.

    Scores are dealt to RANGES ranges of as many distinct ones; a task draws for its range, in all rounds, and hands on
    three sums a round, so what is shuffled are ranges times rounds, whatever the number of scores. A score's draws are
    seeded by it and the seed, so the interval doesn't depend on partitions. Rounds in which one class is missing are
    left out.
    """
    by = scores.groupBy("p").agg(F.sum(F.col("y").cast("bigint")).alias("pos"), (F.count("*") - F.sum(F.col("y").cast("bigint"))).alias("neg"))
    bounds = by.agg(F.array_distinct(F.percentile_approx("p", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 10_000)).alias("_bounds"))
    dealt = by.join(F.broadcast(bounds)).select(F.size(F.filter("_bounds", lambda b: b <= F.col("p"))).cast("bigint").alias("range"), "p", F.xxhash64("p", F.lit(seed)).alias("key"), "pos", "neg")
    parts = dealt.groupBy("range").applyInArrow(lambda t: _drawn(t, rounds), "range bigint, r bigint, pos double, neg double, area double")
    above = F.coalesce(F.sum("pos").over(Window.partitionBy("r").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = parts.select("r", "pos", "neg", (F.col("area") + F.col("neg") * above).alias("area"))
    aucs = run.groupBy("r").agg((F.sum("area") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return tuple(aucs.agg(F.percentile("auc", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).head().q)
