"""The data contract: twenty rules, each a count of violations, fused into one scan for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as D
from ..functions.columns import content_key, minutes_between, truth
from .curation import Curated, Raw, small

SHIPMENT_RULES: dict[str, str] = {
    "pk_shipments_unique": "shipment_id is unique and not null",
    "required_fields_not_null": "planned times, route_key, status and cargo_type are never null",
    "status_domain": "status is canonical or UNKNOWN",
    "cargo_type_domain": "cargo_type is canonical or Unknown",
    "container_count_range": "container_count is null or within bounds",
    "weight_positive": "weight_tons is null or above 0",
    "derived_delay_hours": "actual_delay_hours is the minutes from planned to actual arrival over 60",
    "derived_on_time_flag": "on_time_flag is actual_delay_hours within the threshold",
    "derived_route_key": "route_key joins both ports",
    "derived_transit_days": "transit days are null or above 0",
    "status_consistent_with_delay": "status agrees with the delay",
    "curated_not_empty": "there are curated shipments",
}


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(truth, conditions))


def _shipment_counts(s: DataFrame) -> DataFrame:
    c = F.col
    delay, status = c("actual_delay_hours"), c("status")
    expected = minutes_between("planned_arrival", "actual_arrival") / F.lit(60.0)
    bad = {
        "required_fields_not_null": _any(*(c(x).isNull() for x in ("booking_date", "planned_departure", "planned_arrival", "route_key", "status", "cargo_type"))),
        "status_domain": ~status.isin(*D.STATUSES, D.UNKNOWN_STATUS),
        "cargo_type_domain": ~c("cargo_type").isin(*D.CARGO_TYPES, D.UNKNOWN_CARGO),
        "container_count_range": ~c("container_count").between(1, D.MAX_CONTAINERS),
        "weight_positive": c("weight_tons") <= 0,
        "derived_delay_hours": ~delay.eqNullSafe(expected),
        "derived_on_time_flag": ~c("on_time_flag").eqNullSafe(delay <= D.ON_TIME_HOURS),
        "derived_route_key": c("route_key") != F.concat("origin_port", F.lit(" → "), "destination_port"),
        "derived_transit_days": _any(c("transit_days_planned") <= 0, c("transit_days_actual") <= 0),
        "status_consistent_with_delay": _any(
            (status == "DELAYED") & ~(delay > D.ON_TIME_HOURS),
            (status == "DELIVERED") & ~(delay <= D.ON_TIME_HOURS),
            status.isin("CANCELLED", "UNKNOWN") & delay.isNotNull(),
            status.isin("DELAYED", "DELIVERED") & delay.isNull(),
        ),
    }
    return s.agg(*(F.count_if(x).alias(n) for n, x in bad.items()), (F.count("*") == 0).cast("bigint").alias("curated_not_empty"))


def _repeated_ids(s: DataFrame) -> DataFrame:
    """Rows less the ids among them, rows without an id counted once more. Apart from the other rules, whose counts no id carries."""
    ids = s.groupBy("shipment_id").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ids.agg((zero("n") - F.count("shipment_id") + zero(F.when(F.col("shipment_id").isNull(), F.col("n")))).alias("pk_shipments_unique"))


def _misses(rows: DataFrame, columns: list[str], ports: DataFrame) -> Column | DataFrame:
    """How many rows have a code that no port has; a null code is no miss."""
    codes = small(ports.select("port_code").distinct())
    bad = F.lit(False)
    for i, name in enumerate(columns):
        rows = rows.join(codes.select(F.col("port_code").alias(f"_p{i}")), F.col(name) == F.col(f"_p{i}"), "left")
        bad |= F.col(name).isNotNull() & F.col(f"_p{i}").isNull()
    return rows.agg(F.count_if(bad).alias("n"))


def _long(df: DataFrame) -> DataFrame:
    """One row of counts as rows (rule, violations)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("violations")) for n in df.columns)))
    return df.select(pairs.alias("x")).select("x.*")


def violations(raw: Raw, curated: Curated, max_quarantine_percent: float = D.MAX_QUARANTINE_PERCENT) -> DataFrame:
    """rule, violations for all twenty rules."""
    one = lambda name, df: df.select(F.lit(name).alias("rule"), F.col("n").cast("bigint").alias("violations"))
    s, e, p = curated.shipments, curated.port_events, curated.ports
    ports = p.agg((F.count("*") - F.count_distinct("port_code")).alias("pk_ports_unique"), F.count_if(_any(F.col("country").isNull(), F.col("region").isNull(), F.col("avg_congestion_score").isNull())).alias("ports_complete"))
    events = e.agg((F.count("*") - F.count_distinct("event_key")).alias("pk_events_unique"))
    parts = [_long(_repeated_ids(s)), _long(_shipment_counts(s)), _long(ports), _long(events), one("fk_shipment_ports", _misses(s, ["origin_port", "destination_port"], p)), one("fk_event_ports", _misses(e, ["port_code"], p))]
    count = lambda df, name: df.agg(F.count("*").alias(name))
    for name, rows, columns, kept, bad in (("reconcile_shipments", raw.shipments, D.SHIPMENT_COLUMNS, s, curated.quarantined_shipments), ("reconcile_port_events", raw.port_events, D.EVENT_COLUMNS, e, curated.quarantined_events)):
        sums = count(rows.select(content_key(*columns)).distinct(), "d").join(F.broadcast(count(kept, "k"))).join(F.broadcast(count(bad, "q")))
        parts.append(one(name, sums.select(F.abs(F.col("d") - F.col("k") - F.col("q")).alias("n"))))
    share = count(curated.quarantined_shipments, "q").join(F.broadcast(count(raw.shipments, "n")))
    parts.append(one("quarantine_ratio", share.select(F.when(F.col("q") * 100.0 / F.greatest("n", F.lit(1)) > F.lit(float(max_quarantine_percent)), F.col("q")).otherwise(0).alias("n"))))
    return reduce(DataFrame.unionByName, parts)


class ContractError(ValueError):
    """The contract's violated rules and their counts."""

    def __init__(self, failed: dict[str, int]) -> None:
        super().__init__("; ".join(f"{k}: {v}" for k, v in sorted(failed.items())))
        self.failed = failed


def assert_valid(raw: Raw, curated: Curated, max_quarantine_percent: float = D.MAX_QUARANTINE_PERCENT) -> dict[str, int]:
    counts = {r.rule: r.violations for r in violations(raw, curated, max_quarantine_percent).collect()}  # twenty rows
    if failed := {k: v for k, v in counts.items() if v}:
        raise ContractError(failed)
    return counts
